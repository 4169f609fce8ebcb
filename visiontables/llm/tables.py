"""Tables written to the shared folder between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.session import discard, written  # noqa: F401


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns can't clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def salted_lookup(df: DataFrame, keys: list[str], table: DataFrame, salts: int = 64) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row per key; rows without a match go.

    However many rows share a key, no task gets more than its ``salts``-th:
    keys are first looked up once per salt, then rows by key and salt.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    found = d.select(*keys, "_salt").distinct().join(table, keys)
    return d.join(found, [*keys, "_salt"]).drop("_salt")


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of largest ``count``, at most ``most`` of them.

    Counts are graded by their logarithm, sixteen grades to a doubling; the
    highest grades whose rows fit are taken whole. Only the sizes of grades
    come to the driver, so no task sends it ``most`` rows of its own.
    """
    grade = F.floor(F.log2(F.col(count)) * 16)
    cut, total = None, 0
    for g, n in sorted((tuple(r) for r in df.groupBy(grade.alias("g")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        cut = g
    return df.limit(0) if cut is None else df.where(grade >= cut)
