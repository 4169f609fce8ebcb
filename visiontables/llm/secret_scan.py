"""Secrets in message logs, by a ledger of scanned contents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm import textbytes as B
from visiontables.llm.tables import narrow, written


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``least`` characters are asked of ``group``; shorter matches are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base kinds, in their order, then those this method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 0, False, ("-----BEGIN ",)),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, ("gh",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, False, ("eyJ",)),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False, ("xox",)),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]+@", 0, 0, False, ("://",)),
)
RULES = BASE + ADDED

FOUND = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("found", FOUND)])


def find(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Findings (by rule version) in code points, ordered by start, then by the rules' order."""
    out = []
    for order, rule in enumerate(rules):
        if rule.needs and not any(x in text for x in rule.needs):
            continue
        for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, {"rule": rule.key, "start": m.start(), "end": m.end()}))
    return [x[2] for x in sorted(out, key=lambda x: x[:2])]


def _scan(rules: tuple[Rule, ...]):
    kinds = pa.schema([
        ("blob", pa.string()), ("rules", pa.list_(pa.string())),
        ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, todo = b.column("blob").to_pylist(), b.column("todo").to_pylist()
            found = [find(t.as_py() or "", tuple(r for r in rules if r.key in k)) for t, k in zip(b.column("text"), todo)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((blobs, todo, found), kinds)], schema=kinds)

    return run


def scan_secrets(
    messages: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    message_id: str = "message_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Findings of every message version, and the ledger with what this call scanned.

    Each text is addressed by its SHA-256 (its *blob*). ``ledger`` has a row
    ``(blob, rules, found)`` for each earlier scan, ``rules`` naming rule
    versions (``name@version``). Only pairs of blob and rule version that it
    lacks are scanned, once for all messages and versions that hold the text;
    findings are then joined back to all of them.

    Returns ``(message_id, blob, found)`` with one row per input row, ``found``
    being ``array<struct<rule, start, end>>`` in code points (end exclusive),
    by start and then in the order of ``rules``; and the new ledger.

    A null text counts as empty. Null ids are kept; repeated rows and several
    versions of an id each keep their row. Other columns are ignored. Without
    rows both results are empty.

    Only hashes are grouped; texts move once, spread by message id, so copies
    of one text never meet in one task.
    """
    spark = messages.sparkSession
    known = {r.key for r in rules}
    m = narrow(messages, message_id=message_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    m = m.withColumn("blob", F.sha2(F.col("text"), 256))
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select("blob", "rules", "found")
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    all_keys = F.array(*[F.lit(k) for k in sorted(known)])
    first = m.groupBy("blob").agg(F.min("message_id").alias("message_id")).join(seen, "blob", "left")
    todo = F.array_except(all_keys, F.coalesce("seen", F.array().cast("array<string>")))
    first = first.select(F.col("blob").alias("_blob"), F.col("message_id").alias("_id"), todo.alias("todo")).where(F.size("todo") > 0)
    unseen = m.join(first.hint("shuffle_hash"), m["message_id"].eqNullSafe(first["_id"]) & (m["blob"] == first["_blob"])).select("blob", "text", "todo")
    fresh = unseen.mapInArrow(B.tidy(_scan(rules)), LEDGER).dropDuplicates(["blob"])
    fresh = written(fresh, "secret-ledger")
    ledger = ledger.unionByName(fresh)
    rank = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("f.rule"))
    hits = ledger.where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin(*known)).distinct()
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("f.start", rank.alias("rank"), "f.end", "f.rule"))).alias("f"))
    by_blob = by_blob.select("blob", F.transform("f", lambda x: F.struct(F.substring_index(x["rule"], "@", 1).alias("rule"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    out = m.select("message_id", "blob").join(by_blob, "blob", "left")
    return out.select(F.col("message_id").alias(message_id), "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), ledger


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Findings of the given rules as text: ``rule:start:end``, comma-joined."""
    chosen = F.filter(found, lambda x: x["rule"].isin([r.name for r in rules]))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@F.pandas_udf(T.StringType())
def _masked(texts, found):
    import pandas as pd

    def one(t, spans):
        if t is None or spans is None or not len(spans):
            return t
        out, at = [], 0
        for s in sorted(spans, key=lambda x: x["start"]):
            if s["end"] <= at:
                continue
            if s["start"] >= at:
                out += [t[at : s["start"]], "<secret>"]
            at = s["end"]
        return "".join([*out, t[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, found)])


def mask_secrets(text: Column, found: Column) -> Column:
    """The text with each run of overlapping findings replaced by ``<secret>``."""
    return F.when(F.size(found) > 0, _masked(text, found)).otherwise(text)
