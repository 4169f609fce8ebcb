"""Near copies among detection embeddings, by PCA-ordered tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.llm.links import components
from visiontables.llm.tables import narrow, written

TILE = 8_192
_BLOCK = 1_024


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension, the sum of products of unit vectors' coordinates."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for size, x, _ in _by_size(b):
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            total[size] = total.get(size, 0) + unit.T @ unit
    for size, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["size", "moment"])


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lists = b.column("vector")
    size = np.diff(lists.offsets.to_numpy())
    for s in np.unique(size):
        k = np.flatnonzero(size == s)
        yield int(s), np.stack([lists[int(i)].values.to_numpy(zero_copy_only=False) for i in k]).astype(np.float64), k


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_buffer()) for m in table.column("moment"))
    return pa.table({"size": pa.array([key[0].as_py()], pa.int64()), "moment": pa.array([total.tobytes()], pa.binary())})


class _Links:
    """Links found in a pair of tiles: degrees, and the smallest place reachable from each place."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.degree, self.label = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.degree, i, self.copies[j])
        np.add.at(self.degree, j, self.copies[i])
        while True:
            a, b = self.label[i], self.label[j]
            split = a != b
            if not split.any():
                return
            i, j, a, b = i[split], j[split], a[split], b[split]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jump = self.label[self.label]
                if (jump == self.label).all():
                    break
                self.label = jump


def compare(left: np.ndarray, right: np.ndarray, unit: np.ndarray, turned: np.ndarray, least: float, links: _Links) -> None:
    """Link places of ``left`` with those of ``right`` (the same array: each pair once).

    ``turned`` holds the vectors along the principal axes, the largest first.
    Products of the leading coordinates come first; what the others can add is
    at most the product of their norms, so most pairs stop there.
    """
    size = unit.shape[1]
    stages = sorted({max(1, size // 4), max(1, size // 2)})
    rest = {k: np.sqrt(np.maximum(0, 1 - (turned[:, :k] ** 2).sum(axis=1))) for k in stages}
    slack = least - 1e-9
    same = left is right
    for a in range(0, len(left), _BLOCK):
        p = left[a : a + _BLOCK]
        for b in range(a if same else 0, len(right), _BLOCK):
            q = right[b : b + _BLOCK]
            k = stages[0]
            bound = turned[p, :k] @ turned[q, :k].T + rest[k][p][:, None] * rest[k][q]
            i, j = np.nonzero(bound >= slack)
            i, j = p[i], q[j]
            if same and a == b:
                i, j = i[i < j], j[i < j]
            for k in stages[1:]:
                near = np.einsum("ij,ij->i", turned[i, :k], turned[j, :k]) + rest[k][i] * rest[k][j] >= slack
                i, j = i[near], j[near]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            if near.any():
                links.add(i[near], j[near])


def _pair(axes: dict[int, np.ndarray], least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = key[0].as_py()
        x = table.column("vector").combine_chunks()
        x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        unit = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        ids = table.column("first").to_numpy()
        order = np.argsort(ids)
        ids, unit, tile = ids[order], unit[order], table.column("tile").to_numpy()[order]
        links = _Links(table.column("copies").to_numpy()[order])
        left, right = np.flatnonzero(tile == key[1].as_py()), np.flatnonzero(tile == key[2].as_py())
        compare(left, left if key[1] == key[2] else right, unit, unit @ axes[size], least, links)
        k = np.flatnonzero(links.degree)
        return pa.table({"first": ids[k], "links": links.degree[k], "root": ids[links.label[k]]})

    return run


def link_embeddings(detections: DataFrame, least: float = 0.9, tile: int = TILE, det_id: str = "det_id", embedding: str = "embedding") -> DataFrame:
    """Detections whose embeddings have a cosine of ``least`` or more, in double precision.

    Returns per input row ``det_id, n_links`` (other vectors linked with it),
    ``component_id`` (the smallest det_id reachable by links, itself included)
    and ``kept`` (whether that is itself). A null vector, one with null or
    non-finite components, a zero vector and a row without id link with
    nothing; vectors of different lengths do not link. Repeated rows are
    vectors of their own. Other columns are ignored.

    Equal vectors count as one with a number of copies. The distinct ones are
    turned to the principal axes of all vectors, and cut into tiles of about
    ``tile`` along the first axis. A link is at most sqrt(2 - 2 * least) long,
    so tiles further apart are not compared; each pair of others is one group,
    compared in blocks by leading coordinates first (see ``compare``). Groups
    return a degree and the smallest id of its part per vector, never pairs.
    The exact comparison still grows with the number of tile pairs in reach.
    """
    d = narrow(detections, det_id=det_id, vector=embedding)
    good = F.col("det_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    good = good & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(good, F.lit(False))
    d = d.withColumn("vector", F.when(usable, F.col("vector")))
    unique = d.where("vector is not null").groupBy("vector").agg(F.min("det_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    unique = written(unique, "vectors")
    parts = unique.select("vector").mapInArrow(_moments, "size bigint, moment binary")
    parts = written(parts, "moments")
    spread = max(1, int(np.sqrt(parts.count())))
    halves = parts.withColumn("part", F.pmod(F.xxhash64("moment"), F.lit(spread))).groupBy("size", "part").applyInArrow(_added, "size bigint, moment binary")
    axes: dict[int, np.ndarray] = {}
    for size, moment in halves.collect():
        axes[size] = axes.get(size, 0) + np.frombuffer(moment).reshape(size, size)
    axes = {size: np.linalg.eigh(m)[1][:, ::-1].copy() for size, m in axes.items()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9

    found = None
    for size, turn in axes.items():
        v = unique.where(F.size("vector") == size)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        main = F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(t)) for t in turn[:, 0]]), lambda x, t: x.cast("double") * t), F.lit(0.0), lambda a, x: a + x) / norm
        v = v.withColumn("main", main)
        n = v.count()
        tiles = max(1, -(-n // tile))
        cuts = sorted(set(v.approxQuantile("main", [k / tiles for k in range(1, tiles)], 0.1 / tiles))) if tiles > 1 else []
        low, high = [-2.0, *cuts], [*cuts, 2.0]
        bounds = v.sparkSession.createDataFrame(
            [(k, min(j for j in range(len(low)) if high[j] >= low[k] - reach), max(j for j in range(len(low)) if low[j] <= high[k] + reach)) for k in range(len(low))], "tile int, lo int, hi int")
        number = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda a, c: a + (F.col("main") >= c).cast("int")) if cuts else F.lit(0)
        v = v.withColumn("tile", number).join(F.broadcast(bounds), "tile").withColumn("with", F.explode(F.sequence("lo", "hi")))
        v = v.select(F.lit(size).cast("bigint").alias("size"), F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "first", "copies", "vector")
        part = v.groupBy("size", "i", "j").applyInArrow(_pair({size: turn}, least), f"first {d.schema['det_id'].dataType.simpleString()}, links bigint, root {d.schema['det_id'].dataType.simpleString()}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return d.select(F.col("det_id").alias(det_id), F.lit(0).cast("bigint").alias("n_links"), F.col("det_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "embedding-links")
    degree = found.groupBy("first").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("first").alias("a"), F.col("root").alias("b")))
    of_class = unique.select("vector", "first", "copies").join(degree, "first", "left").join(groups.withColumnRenamed("id", "first"), "first", "left")
    of_class = of_class.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = d.join(of_class, "vector", "left")
    component = F.coalesce("component", "det_id")
    return out.select(F.col("det_id").alias(det_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("det_id"), F.lit(True)).alias("kept"))
