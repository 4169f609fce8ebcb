"""What users run on videos and annotation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.operators import filters as FL
from visiontables.operators import nms as N
from visiontables.operators import overlap as O
from visiontables.operators import runs as R
from visiontables.streaming.lifecycle import TrackerConfig, track_batch

FRAME = ["video_id", "frame_idx"]


def track_video(dets: DataFrame, videos: DataFrame, config: TrackerConfig = TrackerConfig(), score: float = 0.5, iou: float = 0.1) -> DataFrame:
    """Tracked objects with boxes relative to the frame (x, y, w, h).

    ``videos`` brings the frame size ``w, h`` per video.
    """
    clean = N.nms(FL.by_confidence(dets, score), FRAME, iou, strict=True)
    frames = dets.select(*FRAME).distinct()
    # frames without a detection left still count as frames
    rows = frames.join(clean, FRAME, "left")
    out = track_batch(rows, config).join(videos.select("video_id", "w", "h"), "video_id")
    return out.select(*FRAME, "obj_id", "prob", "tracker_prob", "confirmed",
                      (F.col("x1") / F.col("w")).alias("x"), (F.col("y1") / F.col("h")).alias("y"),
                      ((F.col("x2") - F.col("x1")) / F.col("w")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("h")).alias("h"))


def separate_masks(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Masks of a frame made disjoint: the better-scored object keeps a pixel."""
    scored = runs.join(scores.select(*FRAME, "obj_id", "score"), [*FRAME, "obj_id"])
    return R.resolve_overlaps(scored, FRAME, "obj_id", [-F.col("score")])


def review_annotations(truth: DataFrame, predicted: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Truth and predicted masks compared per phrase: matches, misses, extras.

    Both are run tables (keys, obj_id, x, ys, ye). A truth object is matched
    when its best prediction reaches the threshold.
    """
    pairs = O.mask_overlap_join(truth.withColumnRenamed("obj_id", "truth_id"), predicted.withColumnRenamed("obj_id", "pred_id"), keys, "truth_id", "pred_id")
    best = pairs.where(F.col("iou") >= threshold)
    # rows of unrolled masks are more than their table's size lets expect: nothing here may be broadcast
    n = lambda df, rid, name: df.select(*keys, rid).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).hint("merge")
    parts = [n(truth, "obj_id", "truth"), n(predicted, "obj_id", "predicted"), n(best, "truth_id", "matched"), n(best, "pred_id", "used")]
    j = parts[0].join(parts[1], keys, "full").join(parts[2], keys, "left").join(parts[3], keys, "left").na.fill(0)
    return j.select(*keys, "truth", "predicted", "matched", (F.col("truth") - F.col("matched")).alias("missed"), (F.col("predicted") - F.col("used")).alias("extra"))
