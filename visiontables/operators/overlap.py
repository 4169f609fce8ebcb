"""Overlap joins between boxes and between masks.

Both joins add an equality key that only possible partners share, so one busy
image spreads over many tasks and rows far apart never meet.

Boxes: rows of an image meet in square cells. For an IoU threshold t, only
boxes whose sides differ by at most the factor 1/t can match, and only if their
centres lie close: shrinking every box about its centre by (1-t)/(1+t) keeps
matching boxes in touch. So a box enters the cells its shrunken form touches, at
its own size level and the few coarser levels that 1/t spans, and a pair is
tested at the coarser of its two levels, in the one cell that holds the upper
left corner of the common part of the two shrunken boxes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.operators import packed as P
from visiontables.session import checkpoint, is_empty, spread

# rows of a key compared whole in a task
MEET_ROWS = 4096
# keeps whole-number box sizes away from the borders between size levels
_LEVEL_SHIFT = 1.0001234567


def shrink_factor(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    return (1 - threshold) / (1 + threshold) * (1 + 1e-9) + 1e-9


def level_span(threshold: float) -> int:
    """How many coarser levels a match can be away."""
    return math.ceil(math.log2(1 / threshold) + 1e-9)


def core_columns(threshold: float, box=None) -> dict[str, Column]:
    """Shrunken box ``kx1..ky2`` and size level ``lvl`` of each row."""
    x1, y1, x2, y2 = box or B.box_columns()
    a = shrink_factor(threshold)
    cx, cy = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    hw, hh = (x2 - x1) / 2.0 * a, (y2 - y1) / 2.0 * a
    side = F.greatest(x2 - x1, y2 - y1) * _LEVEL_SHIFT
    return {"kx1": cx - hw, "ky1": cy - hh, "kx2": cx + hw, "ky2": cy + hh,
            "lvl": F.ceil(F.log2(side)).cast("int")}


def explode_cells(df: DataFrame, span: int) -> DataFrame:
    """One row per cell: ``cell_lvl, cell_x, cell_y``; ``ncells`` counts them.

    Rows without a positive size match nothing and get no cell.
    """
    df = df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    at = lambda name, size: F.floor(F.col(name) / size)

    def cells_of(size):
        return (at("kx2", size) - at("kx1", size) + 1) * (at("ky2", size) - at("ky1", size) + 1)

    total = sum((cells_of(F.pow(F.lit(2.0), F.col("lvl") + i)) for i in range(1, span + 1)), cells_of(F.pow(F.lit(2.0), F.col("lvl"))))
    df = df.withColumn("ncells", total.cast("int")).select("*", F.explode(F.sequence(F.col("lvl"), F.col("lvl") + span)).alias("cell_lvl"))
    df = df.withColumn("_size", F.pow(F.lit(2.0), F.col("cell_lvl")))
    for axis in "xy":
        lo, hi = at(f"k{axis}1", F.col("_size")), at(f"k{axis}2", F.col("_size"))
        df = df.select("*", F.explode(F.sequence(lo, hi)).alias(f"cell_{axis}"))
    return df.drop("_size")


def iou_join(a: DataFrame, b: DataFrame, threshold: float, keys: list[str], id_a: str, id_b: str,
             strict: bool = False, once: bool = False, carry_a: list[str] = (), carry_b: list[str] = (),
             measure: str = "iou") -> DataFrame:
    """Pairs of boxes of the same key with IoU at or above the threshold.

    ``once`` keeps each unordered pair of a self-join once (id_a < id_b).
    ``strict`` keeps IoU above the threshold only. Output columns: keys,
    ``id_a``, ``id_b``, carried columns and ``iou``.

    Keys of few rows (``MEET_ROWS``) are compared whole in their task, after one
    shuffle of the rows; only those of more, or with boxes that are not finite,
    spread over cells.
    """
    span = level_span(threshold)
    if measure == "iou":
        crowded = _crowded_keys(a, b, keys)
        if is_empty(crowded):
            return _meet_whole(a, b, threshold, keys, id_a, id_b, strict, once, carry_a, carry_b)
        whole, cells = ([df.join(crowded, keys, how) for df in (a, b)] for how in ("left_anti", "left_semi"))
        met = _meet_whole(*(whole if a is not b else whole[:1] * 2), threshold, keys, id_a, id_b, strict, once, carry_a, carry_b)
        a, b = cells
    core = core_columns(threshold)

    def side(df, rid, name, carry, own, other):
        df = df.select(*keys, F.col(rid).alias(name), *B.BOX, *carry).withColumns(core)
        df = explode_cells(df, span).drop("ncells")
        # at a cell's level one of the two must be at home: visitors never meet visitors
        home = F.array(F.lit(0), F.lit(own))
        df = df.select("*", F.explode(F.when(F.col("lvl") == F.col("cell_lvl"), home).otherwise(F.array(F.lit(other)))).alias("_role"))
        ren = {c: f"{name}_{c}" for c in [*B.BOX, "kx1", "ky1", "kx2", "ky2", "lvl"]}
        return df.withColumnsRenamed(ren)

    left, right = side(a, id_a, "_a", carry_a, 1, 2), side(b, id_b, "_b", carry_b, 2, 1)
    j = left.join(right, [*keys, "cell_lvl", "cell_x", "cell_y", "_role"])
    col = lambda p: tuple(F.col(f"{p}_{c}") for c in B.BOX)
    size = F.pow(F.lit(2.0), F.col("cell_lvl"))
    here = (
        (F.floor(F.greatest("_a_kx1", "_b_kx1") / size) == F.col("cell_x"))
        & (F.floor(F.greatest("_a_ky1", "_b_ky1") / size) == F.col("cell_y"))
    )
    if once:
        here = here & (F.col("_a") < F.col("_b"))
    # the common part of the shrunken boxes must exist, or its corner could lie in a cell only one of them fills
    here = here & (F.least("_a_kx2", "_b_kx2") >= F.greatest("_a_kx1", "_b_kx1")) & (
        F.least("_a_ky2", "_b_ky2") >= F.greatest("_a_ky1", "_b_ky1"))
    value = B.iou(col("_a"), col("_b"))
    j = j.where(here).withColumn("iou", value)
    j = j.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)
    extra = {"iou": []}.get(measure)
    if extra is None:
        fn = {"ioa": B.ioa, "giou": B.giou}[measure]
        extra = [fn(col("_a"), col("_b")).alias(measure)]
    j = j.select(*keys, F.col("_a").alias(id_a), F.col("_b").alias(id_b if id_b != id_a else id_b + "_2"),
                 *carry_a, *carry_b, "iou", *extra)
    return met.unionByName(j) if measure == "iou" else j


def _crowded_keys(a: DataFrame, b: DataFrame, keys: list[str], limit: int | None = None, columns: list[str] = B.BOX) -> DataFrame:
    """Keys with more rows than a task compares at once, or with numbers that are not finite."""
    limit = MEET_ROWS if limit is None else limit
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    rows = [df.select(*keys, odd.alias("_odd")) for df in ((a,) if a is b else (a, b))]
    counts = reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_odd").alias("_odd"))
    return checkpoint(counts.where((F.col("_n") > limit) | F.col("_odd")).select(*keys))


def _both_sides(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str, own: bool, columns: list[str],
                carry_a: list[str] = (), carry_b: list[str] = ()) -> DataFrame:
    """Rows of either side, ``_a`` or ``_b`` by ``_left``; a self-join of whole pairs (``own``) has one."""
    def side(df, rid, carry, others, left):
        held = [F.lit(None).cast(o.schema[c].dataType).alias(c) for o, c in others]
        return P.known(df.select(*keys, F.col(rid).alias("_id"), *columns, *carry, *held, F.lit(left).alias("_left")), keys)

    if own:
        return side(a, id_a, (), (), True)
    return side(a, id_a, carry_a, [(b, c) for c in carry_b], True).unionByName(side(b, id_b, carry_b, [(a, c) for c in carry_a], False))


def _meet_whole(a, b, threshold, keys, id_a, id_b, strict, once, carry_a, carry_b) -> DataFrame:
    own = a is b and id_a == id_b and once and not carry_a and not carry_b
    rows = _both_sides(a, b, keys, id_a, id_b, own, B.BOX, carry_a, carry_b)
    out = [*keys, "_a", "_b", *carry_a, *carry_b, "iou"]

    def kernel(table: pa.Table, group: np.ndarray):
        box, null = P.numbers(table, B.BOX)
        box[null.any(axis=1)] = 0.0
        left, ids = np.asarray(table.column("_left")), table.column("_id")
        for i, j, inter in P.box_overlaps(group, box):
            if not own:
                mixed = left[i] != left[j]
                i, j, inter = i[mixed], j[mixed], inter[mixed]
                i, j = np.where(left[i], i, j), np.where(left[i], j, i)
            value = P.box_iou(box[i], box[j], inter)
            hit = value > threshold if strict else value >= threshold
            i, j = pa.array(i[hit]), pa.array(j[hit])
            held = [*[table.column(k).take(i) for k in keys], ids.take(i), ids.take(j),
                    *[table.column(c).take(i) for c in carry_a], *[table.column(c).take(j) for c in carry_b], pa.array(value[hit])]
            yield from pa.table(held, names=out).combine_chunks().to_batches(max_chunksize=1 << 16)

    kind = rows.schema["_id"].dataType.simpleString()
    schema = ", ".join([P.kinds(a, keys), f"_a {kind}, _b {kind}", *[P.kinds(d, list(c)) for d, c in ((a, carry_a), (b, carry_b)) if c], "iou double"])
    pairs = P.by_group(rows, keys, kernel, schema)
    if own:
        pairs = pairs.withColumns({"_a": F.least("_a", "_b"), "_b": F.greatest("_a", "_b")}).where(F.col("_a").isNotNull())
    if once:
        pairs = pairs.where(F.col("_a") < F.col("_b"))
    return pairs.withColumnsRenamed({"_a": id_a, "_b": id_b if id_b != id_a else id_b + "_2"})


def touch_join(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str, cell: float,
               once: bool = False) -> DataFrame:
    """Pairs of boxes of the same key that share any area, with their measures.

    Boxes enter every cell of a fixed size they touch; a pair counts in the cell
    of the upper left corner of its common part.
    """
    def side(df, rid, name):
        df = df.select(*keys, F.col(rid).alias(name), *B.BOX).where(B.nonempty())
        for axis, lo, hi in (("x", "x1", "x2"), ("y", "y1", "y2")):
            df = df.select("*", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))).alias(f"cell_{axis}"))
        return df.withColumnsRenamed({c: f"{name}_{c}" for c in B.BOX})

    j = side(a, id_a, "_a").join(side(b, id_b, "_b"), [*keys, "cell_x", "cell_y"])
    A, C = (tuple(F.col(f"{p}_{c}") for c in B.BOX) for p in ("_a", "_b"))
    keep = ((F.floor(F.greatest("_a_x1", "_b_x1") / cell) == F.col("cell_x"))
            & (F.floor(F.greatest("_a_y1", "_b_y1") / cell) == F.col("cell_y"))
            & (B.intersection(A, C) > 0))
    if once:
        keep = keep & (F.col("_a") < F.col("_b"))
    return j.where(keep).select(
        *keys, F.col("_a").alias(id_a), F.col("_b").alias(id_b if id_b != id_a else id_b + "_2"),
        B.intersection(A, C).alias("inter"), B.iou(A, C).alias("iou"), B.ioa(A, C).alias("ioa"), B.giou(A, C).alias("giou"))


def matched_iou(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """IoU of two boxes of the same row, and their giou."""
    a, b = [F.col(c) for c in left], [F.col(c) for c in right]
    return df.withColumns({"iou": B.iou(a, b), "giou": B.giou(a, b)})


# ---- masks --------------------------------------------------------------------

def split_bands(runs: DataFrame, band: int) -> DataFrame:
    """Cut runs at multiples of ``band`` rows; pieces of different bands never meet."""
    lo = F.floor(F.col("ys") / band)
    hi = F.floor((F.col("ye") - 1) / band)
    r = runs.where(F.col("ye") > F.col("ys")).select("*", F.explode(F.sequence(lo, hi)).alias("band"))
    return r.withColumns({"ys": F.greatest(F.col("ys"), F.col("band") * band),
                          "ye": F.least(F.col("ye"), (F.col("band") + 1) * band)})


def mask_areas(runs: DataFrame, keys: list[str], name: str = "area") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("ye") - F.col("ys")).alias(name))


def mask_intersections(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str,
                       once: bool = False, stripe: int = 128, band: int = 1024) -> DataFrame:
    """Shared pixels of every pair of masks of the same key that meet.

    Masks meet as packs in rectangles of ``stripe`` columns and ``band`` rows,
    whose pairs are added up where they are found; only packs and pairs are
    shuffled. A task holds the runs of one such rectangle at a time.
    """
    own = a is b and id_a == id_b and once

    def side(df, rid, name, other, kind):
        r = split_bands(df.select(*keys, F.col(rid).alias(name), "x", "ys", "ye"), band)
        r = r.where(reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in [*keys, name, "x"]]))
        r = r.withColumn("_stripe", F.floor(F.col("x") / stripe))
        r = r if other is None else r.withColumn(other, F.lit(None).cast(kind))
        return P.pack(r, [*keys, "_stripe", "band", *(["_a"] if own else ["_a", "_b"])])

    kind_a, kind_b = a.schema[id_a].dataType, b.schema[id_b].dataType
    if own:
        packs = side(a, id_a, "_a", None, None)
    else:
        packs = side(a, id_a, "_a", "_b", kind_b).unionByName(side(b, id_b, "_b", "_a", kind_a))

    def kernel(table: pa.Table, group: np.ndarray):
        row, x, ys, ye = P.flat_runs(table)
        column = group[row] * np.int64(stripe) + x % stripe
        first = table.column("_a")
        second = first if own else table.column("_b")
        left = np.asarray(first.is_valid())
        for one, two, n in P.shared_pixels(column, ys, ye, row, table.num_rows):
            if not own:
                mixed = left[one] != left[two]
                one, two, n = one[mixed], two[mixed], n[mixed]
                one, two = np.where(left[one], one, two), np.where(left[one], two, one)
            held = [table.column(k).take(pa.array(one)) for k in keys]
            out = pa.table([*held, first.take(pa.array(one)), second.take(pa.array(two)), pa.array(n, pa.int64())], names=[*keys, "_a", "_b", "inter"])
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    schema = f"{P.kinds(a, keys)}, _a {kind_a.simpleString()}, _b {kind_b.simpleString()}, inter bigint"
    pairs = P.by_group(packs, [*keys, "_stripe", "band"], kernel, schema)
    if own:
        pairs = pairs.select(*keys, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"), "inter")
    if once:
        pairs = pairs.where(F.col("_a") < F.col("_b"))
    # dealt out as the join with the areas of the first wants them, so that pairs are shuffled once less
    return spread(pairs, *keys, "_a").groupBy(*keys, "_a", "_b").agg(F.sum("inter").alias("inter"))


def mask_overlap_join(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str,
                      once: bool = False, threshold: float | None = None) -> DataFrame:
    """Mask intersection, IoU and intersection over the smaller mask.

    The areas join the finished pairs, which are far fewer than the runs. Sizes
    are guessed from the tables before their masks are unrolled, so no side is
    left to be broadcast.
    """
    pairs = mask_intersections(a, b, keys, id_a, id_b, once)
    area_a = mask_areas(a, [*keys, id_a], "area_a").withColumnRenamed(id_a, "_a")
    area_b = mask_areas(b, [*keys, id_b], "area_b").withColumnRenamed(id_b, "_b")
    j = pairs.join(area_a.hint("merge"), [*keys, "_a"]).join(area_b.hint("merge"), [*keys, "_b"])
    one = F.lit(1)
    union = F.greatest(F.col("area_a") + F.col("area_b") - F.col("inter"), one)
    small = F.greatest(F.least("area_a", "area_b"), one)
    out = j.withColumns({"iou": F.col("inter") / union, "iom": F.col("inter") / (small + 1e-8)})
    if threshold is not None:
        out = out.where(F.col("iou") >= threshold)
    return out.withColumnsRenamed({"_a": id_a, "_b": id_b if id_b != id_a else id_b + "_2"})
