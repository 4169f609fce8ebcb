"""Row numbers within groups of any size and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.session import checkpoint, is_empty


def position_in_order(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos", whole: int = 0) -> DataFrame:
    """1-based position of each row of its group in any sort order.

    Rows are range-partitioned by group and order, so one huge group spreads
    over many tasks; each task numbers its own rows and adds what lies before
    it. The ranges are written out once, for a lost task must not move them.
    Groups of at most ``whole`` rows are numbered each in one task, in one
    shuffle and without being written.
    """
    if whole and keys:
        # as by ranges, rows without a key get no number
        df = df.where(" and ".join(f"`{k}` is not null" for k in keys))
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select(*keys)
        large = checkpoint(large)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
        if is_empty(large):
            return df.withColumn(name, number)
        small, df = (df.join(large, keys, how) for how in ("left_anti", "left_semi"))
        return small.withColumn(name, number).unionByName(position_in_order(df, keys, order, name))
    ranged = df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = checkpoint(ranged)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    j = ranged.withColumn("_rn", inner).join(offsets, [*keys, "_range"])
    return j.withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_range", "_rn", "_off")
