"""Row filters on detection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.functions import boxes as B

# Named colours and their RGB values (fixed values).
NAMED_COLORS = {
    "red": (255, 0, 0),
    "green": (0, 255, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "orange": (255, 165, 0),
    "purple": (128, 0, 128),
    "pink": (255, 192, 203),
    "brown": (165, 42, 42),
    "black": (0, 0, 0),
    "white": (255, 255, 255),
    "gray": (128, 128, 128),
    "grey": (128, 128, 128),
    "cyan": (0, 255, 255),
    "magenta": (255, 0, 255),
}


def by_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """Final detections; ``candidates`` gives the wider set verification sees."""
    return df.where(F.col("score") >= threshold)


def candidates(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("score") > max(0.1, 0.5 * threshold))


def drop_degenerate(df: DataFrame) -> DataFrame:
    return df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def drop_near_boundary(df: DataFrame, w: str = "w", h: str = "h", margin: float = 0.025) -> DataFrame:
    """Keep boxes whose relative centre lies strictly within the margin."""
    cx, cy = B.center_x() / F.col(w), B.center_y() / F.col(h)
    return df.where((cx > margin) & (cx < 1.0 - margin) & (cy > margin) & (cy < 1.0 - margin))


def color_match(r: Column, g: Column, b: Column, name: str, tolerance: float = 0.3) -> Column:
    """Largest channel difference within the tolerance; unknown names match nothing."""
    want = NAMED_COLORS.get(name.lower())
    if want is None:
        return F.lit(False)
    off = F.greatest(*[F.abs(c - v) / 255.0 for c, v in zip((r, g, b), want)])
    return off <= tolerance


def attribute_checks(color: str | None = None, min_size: float | None = None, max_size: float | None = None,
                     aspect: tuple[float, float] | None = None, tolerance: float = 0.3) -> dict[str, Column]:
    """The asked-for checks by name, over columns r, g, b, size_ratio, aspect."""
    if color is None and min_size is None and max_size is None and aspect is None:
        raise ValueError("give at least one attribute")
    if min_size is not None and max_size is not None and min_size > max_size:
        raise ValueError("min_size is above max_size")
    if aspect is not None and aspect[0] > aspect[1]:
        raise ValueError("aspect range is reversed")
    checks = {}
    if color is not None:
        checks["color"] = color_match(F.col("r"), F.col("g"), F.col("b"), color, tolerance)
    if min_size is not None:
        checks["too small"] = F.col("size_ratio") >= min_size
    if max_size is not None:
        checks["too large"] = F.col("size_ratio") <= max_size
    if aspect is not None:
        checks["aspect"] = F.col("aspect").between(*aspect)
    return checks


def by_attributes(df: DataFrame, **want) -> DataFrame:
    keep = F.lit(True)
    for check in attribute_checks(**want).values():
        keep = keep & check
    return df.where(keep)


def reject_reason(**want) -> Column:
    """Why a row fails, NULL when it passes; the first failed check names it."""
    chain = None
    for reason, check in attribute_checks(**want).items():
        chain = F.when(~check, F.lit(reason)) if chain is None else chain.when(~check, F.lit(reason))
    return chain


def filter_report(df: DataFrame, keys: list[str], reason: str = "reason", order: str = "det_id", shown: int = 3) -> DataFrame:
    """Rows kept per key, and the first rejections with a count of the rest.

    Only the first ``shown`` rejects of a key reach the string: they come from
    a row-limited window, which Spark trims before the shuffle.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*keys).agg(F.count_if(F.col(reason).isNull()).alias("kept"),
                                   F.count_if(F.col(reason).isNotNull()).alias("rejected"))
    first = df.where(F.col(reason).isNotNull()).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_rn") <= shown)
    lines = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", reason))).alias("_first"))
    text = F.concat_ws("; ", F.transform("_first", lambda s: s[reason]))
    more = F.when(F.col("rejected") > shown, F.concat(F.lit(" + "), (F.col("rejected") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return counts.join(lines, keys, "left").select(
        *keys, "kept", "rejected", F.when(F.col("rejected") > 0, F.concat(text, more)).otherwise("").alias("report"))


def valid_mask_text(df: DataFrame, counts: str = "counts", least: int = 4) -> DataFrame:
    """Drop masks whose run text is too short to hold a run."""
    return df.where(F.length(counts) > least)


def with_runs(df: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Keep rows that have at least one mask run."""
    return df.join(runs.select(*keys).distinct(), keys, "left_semi")


def select_by_index(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows named by ``wanted``; repeated and unknown names do no harm."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def gate_new_detections(dets: DataFrame, prompts: DataFrame, key: str = "video_id") -> DataFrame:
    """Admit detections only where the video has a text or a box prompt."""
    prompted = prompts.where(F.col("text").isNotNull() | F.col("has_box")).select(key).distinct()
    return dets.join(prompted, key, "left_semi")


def accept_verdicts(df: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an Accept verdict. Other texts than Accept or Reject are errors;
    they are dropped here and listed by ``verdict_errors``."""
    return df.join(verdicts.where(F.col("verdict") == "Accept").select(*keys), keys, "left_semi")


def verdict_errors(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict").isNull() | ~F.col("verdict").isin("Accept", "Reject"))


def accept_yes_no(reply: Column, policy: str = "lenient") -> Column:
    """A reply with "yes" and no early "no". ``lenient`` looks for "no" in the
    first ten characters and accepts a missing reply; ``strict`` looks at five
    and rejects it."""
    if policy not in ("lenient", "strict"):
        raise ValueError(f"unknown policy {policy}")
    low = F.lower(F.trim(reply) if policy == "lenient" else reply)
    head = F.left(low, F.lit(10 if policy == "lenient" else 5))
    return F.coalesce(low.contains("yes") & ~head.contains("no"), F.lit(policy == "lenient"))
