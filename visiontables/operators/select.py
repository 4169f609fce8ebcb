"""Absolute and relative spatial selection within each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions.boxes import center_x, center_y

# The thirteen selection words (fixed values).
CRITERIA = (
    "leftmost", "rightmost", "topmost", "bottommost", "center",
    "second_from_left", "second_from_right", "third_from_left", "third_from_right",
    "left_of_all", "right_of_all", "above_all", "below_all",
)
# Relation names (fixed values).
RELATIONS = ("left_of", "right_of", "above", "below", "near", "far_from")


def centroids(dets: DataFrame, images: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """Add ``px, py``; boxes are relative when ``images`` gives the sizes."""
    if images is None:
        return dets.withColumns({"px": center_x(), "py": center_y()})
    j = dets.join(images.select(key, "w", "h"), key)
    return j.withColumns({"px": center_x() * F.col("w"), "py": center_y() * F.col("h")}).drop("w", "h")


def select_spatial(dets: DataFrame, criterion: str, w: Column | None = None, h: Column | None = None,
                   key: str = "image_id", order: str = "det_id") -> DataFrame:
    """Rows of each image that meet the criterion; boxes in pixels.

    The ``*_of_all`` and ``*_all`` words keep every tie. The others keep one
    row: the first on ties when counting from the left or top and for the
    extremes, the last when counting from the right.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion}")
    x, y = center_x(), center_y()
    if criterion.endswith("_all"):
        value = x if criterion in ("left_of_all", "right_of_all") else y
        low = criterion in ("left_of_all", "above_all")
        scored = dets.withColumn("_v", value)
        best = scored.groupBy(key).agg((F.min if low else F.max)("_v").alias("_v"))
        return scored.join(best, [key, "_v"], "left_semi").drop("_v")
    if criterion == "center":
        dx, dy = x - w / 2.0, y - h / 2.0
        value, nth = F.sqrt(dx * dx + dy * dy), 1
    else:
        value, nth = {
            "leftmost": (x, 1), "rightmost": (-x, 1), "topmost": (y, 1), "bottommost": (-y, 1),
            "second_from_left": (x, 2), "second_from_right": (-x, 2),
            "third_from_left": (x, 3), "third_from_right": (-x, 3),
        }[criterion]
    scored = dets.withColumn("_v", value)
    if nth == 1:
        rest = [c for c in dets.columns if c not in (key,)]
        best = scored.groupBy(key).agg(F.min(F.struct("_v", order, *[c for c in rest if c != order])).alias("_b"))
        return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*dets.columns)
    tie = F.col(order).desc() if criterion.endswith("right") else F.col(order).asc()
    ranked = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_v", tie)))
    top = ranked.where(F.col("_rn") <= nth)
    # with fewer than nth rows the last of them stands in
    return top.withColumn("_last", F.max("_rn").over(Window.partitionBy(key))).where(
        F.col("_rn") == F.col("_last")).drop("_v", "_rn", "_last")


def select_relative(dets: DataFrame, relation: str, refs: DataFrame, diagonal: Column, distance: float = 0.2,
                    key: str = "image_id", row: str = "det_id") -> DataFrame:
    """Rows standing in the relation to any reference row of their image.

    ``refs`` names reference rows by (key, row); they are not returned. The
    four directions compare with one aggregate per image. The two distances
    compare with the references that can matter: ``near`` only those in the
    row's own or a neighbouring cell of the threshold's size, ``far_from`` only
    the outermost references, one pair per distinct coordinate.
    """
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    pts = dets.withColumns({"_x": center_x(), "_y": center_y(), "_d": diagonal * distance})
    ids = refs.select(key, row).distinct()
    ref = pts.join(ids, [key, row], "left_semi").select(key, F.col("_x").alias("_rx"), F.col("_y").alias("_ry"), "_d")
    others = pts.join(ids, [key, row], "left_anti")
    if relation in ("left_of", "right_of", "above", "below"):
        c = "x" if relation in ("left_of", "right_of") else "y"
        least = relation in ("right_of", "below")
        edge = ref.groupBy(key).agg((F.min if least else F.max)(f"_r{c}").alias("_edge"))
        j = others.join(edge, key)
        keep = F.col(f"_{c}") > F.col("_edge") if least else F.col(f"_{c}") < F.col("_edge")
        return j.where(keep).select(*dets.columns)
    dx, dy = F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry")
    dist = F.sqrt(dx * dx + dy * dy)
    if relation == "near":
        cell = lambda v: F.floor(F.col(v) / F.greatest(F.col("_d"), F.lit(1e-9)))
        around = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
        spots = (ref.distinct().withColumns({"_cx": cell("_rx"), "_cy": cell("_ry")})
                 .withColumn("_ox", F.explode(around)).withColumn("_oy", F.explode(around))
                 .select(key, "_rx", "_ry", (F.col("_cx") + F.col("_ox")).alias("_cx"), (F.col("_cy") + F.col("_oy")).alias("_cy")))
        left = others.withColumns({"_cx": cell("_x"), "_cy": cell("_y")}).alias("a")
        cond = ((F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._cx") == F.col("b._cx"))
                & (F.col("a._cy") == F.col("b._cy")) & (dist <= F.col("_d")))
        return left.join(spots.alias("b"), cond, "left_semi").select(*dets.columns)
    return others.alias("a").join(
        outermost(ref, key).alias("b"),
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (dist > F.col("_d")), "left_semi").select(*dets.columns)


def unknown_references(dets: DataFrame, refs: DataFrame, key: str = "image_id", row: str = "det_id") -> DataFrame:
    """References that name no row of their image, with what is wrong; an image with one has no valid answer.

    ``select_relative`` passes over them. References are matched from the side
    of the (few) references; nothing but their own rows is read of ``dets``.
    """
    ids = refs.select(key, row).distinct()
    known = dets.select(key, row).join(ids, [key, row], "left_semi").distinct().withColumn("_known", F.lit(True))
    sizes = dets.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    lost = ids.join(known, [key, row], "left").where(F.col("_known").isNull()).drop("_known").join(sizes, key, "left")
    rows = F.coalesce("rows", F.lit(0).cast("bigint"))
    return lost.select(key, row, rows.alias("rows"), F.format_string("reference %s is none of %s rows", F.coalesce(F.col(row).cast("string"), F.lit("null")), rows.cast("string")).alias("error"))


def outermost(ref: DataFrame, key: str) -> DataFrame:
    """References that can be the farthest from some point: for one x only the
    lowest and highest y count, and the same the other way round."""
    for along, across in (("_rx", "_ry"), ("_ry", "_rx")):
        ends = ref.groupBy(key, along).agg(F.min(across).alias("_lo"), F.max(across).alias("_hi"))
        ref = ends.select(key, along, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(across))
    return ref


def point_box_distance(points: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Signed distances from each point to the four edges of each box of its image."""
    j = points.join(boxes, key)
    return j.withColumns({"left": F.col("px") - F.col("x1"), "top": F.col("py") - F.col("y1"),
                          "right": F.col("x2") - F.col("px"), "bottom": F.col("y2") - F.col("py")})


def top_k(df: DataFrame, k, key: str = "image_id", by: str = "score", order: str = "det_id") -> DataFrame:
    """Best ``k`` rows per key; Spark trims each task to ``k`` before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(order))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def within_capacity(new: DataFrame, tracked: DataFrame, capacity: int, key: str = "video_id",
                    by: str = "score", order: str = "det_id") -> DataFrame:
    """New rows limited to the room their key has left, best scores first."""
    used = tracked.groupBy(key).agg(F.count(F.lit(1)).alias("_used"))
    ranked = top_k(new, capacity, key, by, order)
    j = ranked.join(used, key, "left")
    return j.where(F.col("rank") <= capacity - F.coalesce(F.col("_used"), F.lit(0))).drop("_used")


def position_in_group(df: DataFrame, keys: list[str], order: str, span: int, name: str = "pos") -> DataFrame:
    """1-based position of each row in its group by an integer column.

    A group is cut into blocks of ``span`` order values, so that a single huge
    group is numbered by many tasks: block sizes are summed up first, then each
    block counts on from the rows before it.
    """
    from pyspark.sql import Window as W

    cut = df.withColumn("_block", F.floor(F.col(order) / span))
    sizes = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(order))
    return (cut.withColumn("_rn", inner).join(offsets, [*keys, "_block"])
            .withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_block", "_rn", "_off"))


def assign_ids(new: DataFrame, tracked: DataFrame, key: str = "video_id", order: str = "det_id", span: int = 1 << 20) -> DataFrame:
    """New object ids count on from the highest id the key has used."""
    top = tracked.groupBy(key).agg(F.max("obj_id").alias("_top"))
    placed = position_in_group(new, [key], order, span, "_pos")
    return placed.join(top, key, "left").withColumn(
        "obj_id", (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_pos")).cast("bigint")).drop("_top", "_pos")
