"""Counts, areas, colours and other summaries per image or object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.operators import overlap as O
from visiontables.operators import packed as P


def _null0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def count_objects(images: DataFrame, dets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; keys without any row count zero."""
    n = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("objects"))
    return images.select(*keys).distinct().join(n, keys, "left").select(*keys, _null0("objects").alias("objects"))


def mask_area(runs: DataFrame, keys: list[str]) -> DataFrame:
    return O.mask_areas(runs, keys, "area")


def mask_bbox(objects: DataFrame, runs: DataFrame, keys: list[str], convention: str = "exclusive",
              w: Column | None = None, h: Column | None = None, held: Column | None = None) -> DataFrame:
    """Box around each mask; with ``held``, a condition on the objects, masks of keys without such an object count as empty.

    ``exclusive``: upper corner one past the last pixel; ``inclusive``: the last
    pixel; both give zeros for an empty mask. ``inverted``: inclusive, an empty
    mask gives (w, h, 0, 0). ``xywh``: first pixel and size.
    """
    b = runs.where(F.col("ye") > F.col("ys")).groupBy(*keys).agg(
        F.min("x").alias("_x1"), F.min("ys").alias("_y1"), F.max("x").alias("_x2"), F.max(F.col("ye") - 1).alias("_y2"))
    more = [w.alias("_w"), h.alias("_h")] if w is not None else []
    if held is None:
        j = objects.select(*keys, *more).join(b, keys, "left")
    else:
        # boxes meet the objects once, and no runs do
        j = objects.select(*keys, *more, held.alias("_held")).withColumn("_held", F.max("_held").over(Window.partitionBy(*keys)))
        j = j.join(b, keys, "left").withColumns({c: F.when(F.col("_held"), F.col(c)) for c in ("_x1", "_y1", "_x2", "_y2")})
    zero = F.lit(0).cast("bigint")
    low = [F.col("_w"), F.col("_h")] if convention == "inverted" else [zero, zero]
    if convention in ("inclusive", "inverted"):
        vals = {"x1": F.coalesce("_x1", low[0]), "y1": F.coalesce("_y1", low[1]), "x2": F.coalesce("_x2", zero), "y2": F.coalesce("_y2", zero)}
    elif convention == "exclusive":
        vals = {"x1": F.coalesce("_x1", zero), "y1": F.coalesce("_y1", zero), "x2": F.coalesce(F.col("_x2") + 1, zero), "y2": F.coalesce(F.col("_y2") + 1, zero)}
    elif convention == "xywh":
        vals = {"x": F.coalesce("_x1", zero), "y": F.coalesce("_y1", zero),
                "w": F.coalesce(F.col("_x2") - F.col("_x1") + 1, zero), "h": F.coalesce(F.col("_y2") - F.col("_y1") + 1, zero)}
    else:
        raise ValueError(f"unknown convention {convention}")
    return j.select(*keys, *[e.alias(n) for n, e in vals.items()])


def measure_area(dets: DataFrame, areas: DataFrame, images: DataFrame, key: str = "image_id", row: str = "det_id") -> DataFrame:
    """Pixel and real area of each object; objects without area are left out.

    ``areas`` holds mask areas by (key, row); the truncated box area stands in
    for a missing mask. ``images`` brings ``gsd`` in metres per pixel; images
    without a positive one are errors, see ``gsd_errors``.
    """
    ok = images.where(F.col("gsd") > 0).select(key, "gsd")
    box = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("bigint")
    j = dets.join(areas.select(key, row, "area"), [key, row], "left").join(ok, key)
    j = j.withColumn("pixel_area", F.coalesce(F.col("area"), box)).where(F.col("pixel_area") > 0)
    return j.withColumn("real_area", F.round(F.col("pixel_area") * F.col("gsd") * F.col("gsd"), 4)).drop("area", "gsd")


def gsd_errors(images: DataFrame, key: str = "image_id") -> DataFrame:
    return images.where(F.col("gsd").isNull() | (F.col("gsd") <= 0)).select(key)


def area_totals(objects: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Totals per image; overlaps between objects count twice in the coverage."""
    t = objects.groupBy(key).agg(F.count(F.lit(1)).alias("objects"), F.sum("pixel_area").alias("_px"))
    j = images.where(F.col("gsd") > 0).join(t, key, "left")
    px, whole = _null0("_px"), F.col("w") * F.col("h")
    return j.select(key, _null0("objects").alias("objects"), px.alias("pixel_area"),
                    F.round(px * F.col("gsd") * F.col("gsd"), 4).alias("real_area"),
                    F.when(whole > 0, F.round(px / whole * 100, 4)).otherwise(0.0).alias("coverage"))


def verification_summary(attempts: DataFrame, keys: list[str], verified: Column) -> DataFrame:
    """Raw, verified and rejected rows per attempt; input has one row per candidate."""
    n = F.count("det_id")
    return attempts.groupBy(*keys, "attempt").agg(
        n.alias("raw"), F.count_if(verified).alias("verified"), (n - F.count_if(verified)).alias("rejected"))


def verification_totals(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.max_by("verified", "attempt").alias("verified"), F.sum("rejected").alias("rejected"),
                                      F.count(F.lit(1)).alias("attempts"))


def confidence_histogram(df: DataFrame, keys: list[str], label: str = "confidence") -> DataFrame:
    """Rows per confidence word; rows without one count as MEDIUM."""
    c = F.coalesce(F.upper(label), F.lit("MEDIUM"))
    return df.groupBy(*keys).agg(*[F.count_if(c == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")])


def frame_stats(frames: DataFrame, dropped: Column, keys: list[str] = ("video_id", "frame_idx")) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count_if(~dropped).alias("tracked"), F.count_if(dropped).alias("dropped"))


def mean_color(objects: DataFrame, runs: DataFrame, pixels: DataFrame, keys: list[str], image: str = "image_id", stripe: int = 64) -> DataFrame:
    """Truncated mean RGB over the masked pixels, black where there are none.

    Masks and pixels are shuffled as packs and meet by stripes of ``stripe``
    image columns. Every column has running sums of its pixels; a run is the
    difference of two of them, and no row is made per covered pixel.
    """
    m = P.colour_sums(runs, pixels, keys, image, stripe).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "r", "g", "b")]).where("n > 0")
    m = m.select(*keys, *[F.floor(F.col(c) / F.col("n")).alias(c) for c in "rgb"])
    return objects.select(*keys).join(m, keys, "left").select(*keys, *[_null0(c).alias(c) for c in "rgb"])


def farthest_palette_color(pixels: DataFrame, palette: dict[str, tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """Palette entry with the largest mean distance; the first entry wins ties.

    The palette is a fixed list in the plan, and each entry's mean is one
    aggregate of a single pass over the pixels.
    """
    means = []
    for i, (_, rgb) in enumerate(palette.items()):
        sq = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", rgb)), F.lit(0).cast("bigint"))
        means.append(F.avg(F.sqrt(sq)).alias(f"_m{i}"))
    g = pixels.groupBy(*keys).agg(*means)
    entries = F.array(*[F.struct(F.round(f"_m{i}", 9).alias("d"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(palette)])
    best = F.array_max(entries)
    return g.select(*keys, best["name"].alias("color"), best["d"].alias("distance"))


def segment_histogram(labels: DataFrame, keys: list[str], divisor: int, things: list[int], least: int = 0) -> DataFrame:
    """Pixels per segment of a label image; -1 marks pixels without a segment."""
    s = labels.where(F.col("label") != -1).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"))
    s = s.withColumn("category", F.floor(F.col("label") / divisor))
    return s.where(F.col("area") >= least).withColumn("is_thing", F.col("category").isin(things))


def keypoint_bins(points: DataFrame, size: int) -> DataFrame:
    """Linear heat map bin of points (px, py, visible) in their RoI x1..y2.

    Points on the right or lower edge fall into the last bin; invalid points
    get bin 0 and valid 0.
    """
    def axis(p, lo, hi):
        b = F.floor((F.col(p) - F.col(lo)) * (size / (F.col(hi) - F.col(lo))))
        return F.when(F.col(p) == F.col(hi), F.lit(size - 1)).otherwise(b)

    bx, by = axis("px", "x1", "x2"), axis("py", "y1", "y2")
    valid = ((bx >= 0) & (by >= 0) & (bx < size) & (by < size) & (F.col("visible") > 0)).cast("bigint")
    return points.withColumns({"bin": ((by * size + bx) * valid).cast("bigint"), "valid": valid})


def heatmap_peak(maps: DataFrame, values: str, width: int) -> DataFrame:
    """Peak cell of each row-major heat map array and its softmax share."""
    v = F.transform(values, lambda x: x.cast("double"))
    top = F.array_max(v)
    pos = F.array_position(v, top) - 1
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return maps.withColumns({"peak_x": (pos % width).cast("bigint"), "peak_y": F.floor(pos / width).cast("bigint"),
                             "peak": top, "share": 1.0 / total})


def stability_score(logits: Column, delta: float) -> Column:
    """Area above delta over area above -delta, 1.0 when the latter is empty."""
    above = F.size(F.filter(logits, lambda v: v > delta))
    wide = F.size(F.filter(logits, lambda v: v > -delta))
    return F.when(wide > 0, above / wide).otherwise(F.lit(1.0))


def choose_candidate(cands: DataFrame, keys: list[str], stable: float = 0.98) -> DataFrame:
    """Candidate 0 where it is stable enough, else the best-scoring other one.

    Input rows: keys, ``cand``, ``score``, ``stability``.
    """
    single = F.col("cand") == 0
    alt = F.max_by(F.col("cand"), F.when(~single, F.struct(F.col("score"), -F.col("cand"))))
    g = cands.groupBy(*keys).agg(F.max(F.when(single, F.col("stability"))).alias("_s"), alt.alias("_alt"))
    return g.select(*keys, F.when(F.col("_s") >= stable, F.lit(0).cast("bigint")).otherwise(F.col("_alt")).alias("cand"))


def best_by_logit(cands: DataFrame, keys: list[str]) -> DataFrame:
    return cands.groupBy(*keys).agg(F.max_by("cand", F.struct(F.col("score"), -F.col("cand"))).alias("cand"))


def prompt_summary(dets: DataFrame, keys: list[str], strong: Column) -> DataFrame:
    """Rows per prompt and whether none of them is strong."""
    n = F.count_if(strong)
    return dets.groupBy(*keys, "prompt").agg(F.count(F.lit(1)).alias("found"), n.alias("strong"), (n == 0).alias("failed"))


def failed_prompts(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The failed prompts of each key in one text."""
    return summary.where("failed").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("prompt")), ", ").alias("failed"), F.count(F.lit(1)).alias("failures"))
