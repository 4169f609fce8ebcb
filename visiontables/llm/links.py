"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.llm.tables import discard, written
from visiontables.session import is_empty


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every id that has a link; the component is its smallest id.

    Each round points every id to the smallest of itself and its neighbours and
    moves the links to where their ends point, until all are loops. Stars end
    after two rounds, chains shrink by halves. Every step is a join or a
    partial aggregation of rows of two ids; nothing is gathered.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = written(edges, "links")
    rounds = []
    while not is_empty(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")), "pointers")
        rounds.append(point)
        left, right = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(left, "u").join(right, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        before, edges = edges, written(moved.where("u < v").distinct(), "links")
        discard(before)
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("component"))
    labels = rounds[0].select(F.col("u").alias("id"), F.col("p").alias("component"))
    for point in rounds[1:]:
        ends = point.select(F.col("u").alias("component"), F.col("p").alias("_p"))
        labels = labels.join(ends, "component", "left").select("id", F.coalesce("_p", "component").alias("component"))
    labels = written(labels, "components")
    discard(edges, *rounds)
    return labels
