"""Detections against tracks, and per-object histories over video frames.

Histories are ordered by frame. A track may be very long, so running values are
computed in blocks of ``span`` frames (``prefix``): totals per block first, then
each block continues from the blocks before it. No window ever holds more than a
block of one key or one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.operators import overlap as O
from visiontables.operators.select import position_in_group
from visiontables.session import checkpoint

OBJ = ["video_id", "obj_id"]
FRAME = ["video_id", "frame_idx"]
SPAN = 4096


def prefix(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]],
           ties: list[Column] = (), span: int = SPAN) -> DataFrame:
    """Running ``sum`` or ``max`` up to and including each row, by frame order.

    ``values`` maps a new column to (kind, expression).
    """
    fn = {"sum": F.sum, "max": F.max}
    cut = df.withColumns({"_block": F.floor(F.col(order) / span), **{f"_in_{n}": e for n, (_, e) in values.items()}})
    blocks = cut.groupBy(*keys, "_block").agg(*[fn[k](f"_in_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *[fn[k](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (k, _) in values.items()])
    inner = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumns({f"_r_{n}": fn[k](f"_in_{n}").over(inner) for n, (k, _) in values.items()})
    j = cut.join(blocks, [*keys, "_block"])
    out = {}
    for n, (k, _) in values.items():
        run, prior = F.col(f"_r_{n}"), F.col(f"_p_{n}")
        out[n] = run + F.coalesce(prior, F.lit(0)) if k == "sum" else F.greatest(run, prior)
    return j.withColumns(out).select(*df.columns, *values)


def count_before(queries: DataFrame, points: DataFrame, keys: list[str], at: str, strict: bool, name: str = "before",
                 span: int = SPAN) -> DataFrame:
    """For each query row, how many points of its key lie before its place.

    Points and queries run through one ordered pass; at equal places points
    count only when ``strict`` is false.
    """
    q = queries.select(*keys, F.col(at), F.lit(0).alias("_point"), F.lit(1 if not strict else 0).alias("_tie")).distinct()
    p = points.select(*keys, F.col(at), F.lit(1).alias("_point"), F.lit(0 if not strict else 1).alias("_tie"))
    run = prefix(q.unionByName(p), keys, at, {name: ("sum", F.col("_point"))}, [F.col("_tie")], span)
    return run.where("_point = 0").select(*keys, at, name)


# ---- association ------------------------------------------------------------------

def box_pairs(dets: DataFrame, tracks: DataFrame, least: float) -> DataFrame:
    """IoU of detections and track boxes of the same frame."""
    return O.iou_join(dets, tracks, least, FRAME, "det_id", "obj_id")


def mask_pairs(det_runs: DataFrame, track_runs: DataFrame) -> DataFrame:
    """The same by masks."""
    return O.mask_overlap_join(det_runs, track_runs, FRAME, "det_id", "obj_id").select(*FRAME, "det_id", "obj_id", "iou")


def matches(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    return pairs.where(F.col("iou") >= threshold)


def new_detections(dets: DataFrame, tracks: DataFrame, pairs: DataFrame, threshold: float = 0.1, new_score: float = 0.7) -> DataFrame:
    """Detections that open a track: a good score and no match, or any
    detection of a frame without tracks."""
    lone = dets.join(tracks.select(*FRAME).distinct().withColumn("_t", F.lit(True)), FRAME, "left")
    lone = lone.where(F.col("_t").isNull() | (F.col("score") >= new_score)).drop("_t")
    return lone.join(matches(pairs, threshold).select(*FRAME, "det_id"), [*FRAME, "det_id"], "left_anti")


def unmatched_tracks(tracks: DataFrame, pairs: DataFrame, threshold: float = 0.5, filled: Column | None = None) -> DataFrame:
    """Tracks with some area that no detection meets at the track threshold."""
    filled = B.nonempty() if filled is None else filled
    return tracks.where(filled).join(pairs.where(F.col("iou") >= threshold).select(*FRAME, "obj_id"), [*FRAME, "obj_id"], "left_anti")


def empty_tracks(tracks: DataFrame, filled: Column | None = None) -> DataFrame:
    filled = B.nonempty() if filled is None else filled
    return tracks.where(~filled)


def confident_matches(dets: DataFrame, pairs: DataFrame, score: float = 0.8, iou: float = 0.8) -> DataFrame:
    """One detection per track: detections of high score go to the track they
    overlap most, if by enough; the last detection of a track wins."""
    good = dets.where(F.col("score") >= score).select(*FRAME, "det_id", "score")
    best = pairs.groupBy(*FRAME, "det_id").agg(F.max(F.struct("iou", (-F.col("obj_id")).alias("o"))).alias("_b"))
    best = best.select(*FRAME, "det_id", (-F.col("_b.o")).alias("obj_id"), F.col("_b.iou").alias("iou")).where(F.col("iou") >= iou)
    j = good.join(best, [*FRAME, "det_id"])
    g = j.groupBy(*FRAME, "obj_id").agg(F.max(F.struct("det_id", "score", "iou")).alias("_d"))
    return g.select(*FRAME, "obj_id", "_d.*")


def recondition_candidates(confident: DataFrame, dets: DataFrame, tracks: DataFrame, box_iou: float, score: float, every: int) -> DataFrame:
    """Tracks to refresh: their box drifted from a good detection, or the frame
    is a refresh frame."""
    d = dets.select(*FRAME, "det_id", *B.BOX)
    t = tracks.select(*FRAME, "obj_id", *[F.col(c).alias("t" + c) for c in B.BOX]).where(
        (F.col("tx2") > F.col("tx1")) & (F.col("ty2") > F.col("ty1")))
    j = confident.join(d, [*FRAME, "det_id"]).join(t, [*FRAME, "obj_id"])
    drift = B.iou(B.box_columns(), [F.col("t" + c) for c in B.BOX])
    off = (drift < box_iou) & (F.col("score") >= score)
    turn = (F.col("frame_idx") % every == 0) if every > 0 else F.lit(False)
    return j.where(off | turn).select(*FRAME, "obj_id", "det_id", off.alias("drifted"), turn.alias("periodic"))


def best_gt_match(truth: DataFrame, cands: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate with the highest mask IoU for each truth row; where none
    overlaps, the best-scoring candidate."""
    mine = lambda rows, name: runs.join(rows.select(*keys, "det_id"), [*keys, "det_id"], "left_semi").withColumnRenamed("det_id", name)
    pairs = O.mask_overlap_join(mine(truth, "truth_id"), mine(cands, "cand_id"), keys, "truth_id", "cand_id")
    best = pairs.groupBy(*keys, "truth_id").agg(F.max(F.struct("iou", (-F.col("cand_id")).alias("c"))).alias("_b"))
    best = best.select(*keys, F.col("truth_id").alias("det_id"), F.col("_b.iou").alias("_iou"), (-F.col("_b.c")).alias("_c"))
    top = cands.groupBy(*keys).agg(F.max_by("det_id", F.struct(F.col("score"), -F.col("det_id"))).alias("_top"))
    j = truth.select(*keys, "det_id").join(best, [*keys, "det_id"], "left").join(top, keys, "left")
    return j.select(*keys, "det_id", F.coalesce("_c", "_top").alias("candidate"), F.coalesce("_iou", F.lit(0.0)).alias("iou"))


# ---- lookups in time -----------------------------------------------------------------

def nearest_keyframes(queries: DataFrame, keyframes: DataFrame, k: int, keep_first: bool = False, span: int = SPAN) -> DataFrame:
    """Up to ``k`` keyframes for each frame: the nearest before, the nearest at
    or after, then the closest others; with ``keep_first`` also the first one.

    Keyframes are numbered, so a frame joins only the ``k`` on either side.
    """
    if k == -1:
        return queries.join(keyframes.select("video_id", F.col("frame_idx").alias("key_frame")), "video_id")
    if k < 2:
        raise ValueError("k must be -1 or at least 2")
    keys = position_in_group(keyframes.select(*FRAME).distinct(), ["video_id"], "frame_idx", span, "_pos")
    q = queries.select(*FRAME).distinct()
    q = q.join(count_before(q, keyframes.select(*FRAME).distinct(), ["video_id"], "frame_idx", True, "_p", span), FRAME)
    ends = keys.groupBy("video_id").agg(F.max("_pos").alias("_n"), F.max("frame_idx").alias("_last"))
    q = q.join(ends, "video_id")
    first = F.when(F.col("_p") >= 1, F.lit(1)).when(F.col("_last") > F.col("frame_idx"), F.col("_n")) if keep_first else F.lit(None).cast("bigint")
    q = q.withColumn("_first", first.cast("bigint"))
    near = F.sequence(F.greatest(F.col("_p") - (k - 1), F.lit(1)), F.greatest(F.least(F.col("_p") + k, F.col("_n")), F.lit(1)))
    spots = F.array_distinct(F.array_compact(F.concat(near, F.array("_first"))))
    j = q.select(*FRAME, "_p", "_first", F.explode(spots).alias("_pos"))
    j = j.join(keys.select("video_id", "_pos", F.col("frame_idx").alias("key_frame")), ["video_id", "_pos"])
    group = (F.when(F.col("_pos") == F.col("_first"), 0).when(F.col("_pos") == F.col("_p"), 1)
             .when(F.col("_pos") == F.col("_p") + 1, 2).otherwise(3))
    away = F.abs(F.col("key_frame") - F.col("frame_idx"))
    w = Window.partitionBy(*FRAME).orderBy("_class", "_away", "key_frame")
    j = j.withColumns({"_class": group, "_away": away}).withColumn("_rn", F.row_number().over(w))
    return j.where((F.col("_rn") <= k) | (F.col("_class") < 3)).select(*FRAME, "key_frame")


def recent_good_frames(frames: DataFrame, scores: DataFrame, step: int, most: int, threshold: float, span: int = SPAN) -> DataFrame:
    """Good frames to look back on: every ``step``-th frame before, above the
    threshold, the most recent ``most - 1``; always the frame just before."""
    good = scores.where((F.col("score") > threshold) & (F.col("frame_idx") > 0)).select(
        "video_id", "frame_idx", (F.col("frame_idx") % step).alias("_lane")).distinct()
    lane = ["video_id", "_lane"]
    keys = position_in_group(good, lane, "frame_idx", span, "_pos")
    q = frames.where(F.col("frame_idx") > 0).select("video_id", F.col("frame_idx").alias("_at"), (F.col("frame_idx") - 1).alias("frame_idx"))
    q = q.withColumn("_lane", F.col("frame_idx") % step).distinct()
    n = count_before(q, good, lane, "frame_idx", False, "_p", span)
    q = q.join(n, [*lane, "frame_idx"])
    want = max(most - 1, 1)
    back = q.where("_p > 0").select(*lane, "_at", F.explode(F.sequence(F.greatest(F.col("_p") - (want - 1), F.lit(1)), F.col("_p"))).alias("_pos"))
    found = back.join(keys.select(*lane, "_pos", "frame_idx"), [*lane, "_pos"]).select(
        "video_id", F.col("_at"), F.col("frame_idx").alias("memory_frame"))
    always = q.select("video_id", "_at", F.col("frame_idx").alias("memory_frame"))
    return found.unionByName(always).distinct().withColumnRenamed("_at", "frame_idx")


def frame_annotations(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per annotation and frame of its video, empty where no mask is given."""
    names = videos.select("video_id", F.posexplode("file_names").alias("frame_idx", "file_name"))
    masks = annotations.select("video_id", "noun_phrase", F.posexplode("segmentations").alias("frame_idx", "segmentation"))
    j = masks.join(names, FRAME)
    return j.withColumn("segmentation", F.coalesce("segmentation", F.lit("")))


def video_reference_errors(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """Annotated videos that are not listed exactly once."""
    n = videos.groupBy("video_id").agg(F.count(F.lit(1)).alias("listed"))
    j = annotations.select("video_id").distinct().join(n, "video_id", "left")
    return j.withColumn("listed", F.coalesce("listed", F.lit(0).cast("bigint"))).where(F.col("listed") != 1)


# ---- output shaping -------------------------------------------------------------------

def densify_tracks(rows: DataFrame, frames: DataFrame, fill: dict) -> DataFrame:
    """A row for every object and frame of its video; ``frames`` brings the
    frame count ``n`` per video, ``fill`` the values of missing rows."""
    grid = rows.select(*OBJ).distinct().join(frames.select("video_id", "n"), "video_id")
    grid = grid.select(*OBJ, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame_idx"))
    j = grid.join(rows, [*OBJ, "frame_idx"], "left")
    return j.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in fill.items()})


def hide_objects(frames: DataFrame, removed: DataFrame, suppressed: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """Drop objects removed for good, and those hidden on single frames."""
    hidden = suppressed.select(*FRAME, "obj_id").unionByName(unconfirmed.select(*FRAME, "obj_id"))
    return frames.join(removed.select(*OBJ), OBJ, "left_anti").join(hidden, [*FRAME, "obj_id"], "left_anti")


def override_masks(base: DataFrame, refined: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Refined rows win over base rows and may add new ones."""
    r = refined.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_r"))
    j = base.select(*keys, *values).join(r, keys, "full")
    return j.select(*keys, *[F.when(F.col("_r"), F.col(f"_r_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def remove_object(frames: DataFrame, removed: DataFrame) -> DataFrame:
    return frames.join(removed.select(*OBJ), OBJ, "left_anti")


def merge_confidence(rows: DataFrame, first: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """The later assessment, else the first, else LOW."""
    a = first.select(*keys, F.col("confidence").alias("_first"))
    b = again.select(*keys, F.col("confidence").alias("_again"))
    return rows.join(a, keys, "left").join(b, keys, "left").withColumn(
        "confidence", F.coalesce("_again", "_first", F.lit("LOW"))).drop("_first", "_again")


# ---- histories ---------------------------------------------------------------------------

UNCONFIRMED, CONFIRMED = 1, 2


def confirmation_streak(history: DataFrame, n: int = 3, span: int = SPAN) -> DataFrame:
    """Consecutive matched frames and the sticky status of each object.

    ``history`` has one row per object and frame with ``matched``; the frame an
    object is new on counts as matched.
    """
    miss = ~F.col("matched")
    h = prefix(history, OBJ, "frame_idx", {"_pos": ("sum", F.lit(1))}, span=span)
    h = prefix(h, OBJ, "frame_idx", {"_miss": ("max", F.when(miss, F.col("_pos")))}, span=span)
    h = h.withColumn("streak", F.col("_pos") - F.coalesce(F.col("_miss"), F.lit(0)))
    since = h.where(F.col("streak") >= n).groupBy(*OBJ).agg(F.min("frame_idx").alias("_since"))
    h = h.join(since, OBJ, "left")
    status = F.when(F.col("frame_idx") >= F.col("_since"), CONFIRMED).otherwise(UNCONFIRMED)
    return h.withColumn("status", status).drop("_pos", "_miss", "_since")


def confirmed_lookahead(history: DataFrame, frames: DataFrame, n: int = 3, reverse: bool = False) -> DataFrame:
    """Objects to hide on each frame: unconfirmed n-1 frames later in the pass.

    ``frames`` brings the frame count ``n`` per video; the later frame is kept
    within the video.
    """
    later = F.col("frame_idx") + (-(n - 1) if reverse else n - 1)
    at = history.select(*FRAME).distinct().join(frames.select("video_id", "n"), "video_id")
    at = at.select(*FRAME, F.greatest(F.lit(0).cast("bigint"), F.least(later, F.col("n") - 1)).alias("_at"))
    hidden = history.where(F.col("status") == UNCONFIRMED).select("video_id", F.col("frame_idx").alias("_at"), "obj_id")
    return at.join(hidden, ["video_id", "_at"]).select(*FRAME, "obj_id")


def first_seen(history: DataFrame, reverse: bool = False) -> DataFrame:
    f = F.max if reverse else F.min
    return history.groupBy(*OBJ).agg(f("frame_idx").alias("first_frame"))


def earliest_match(matched: DataFrame, first: DataFrame, reverse: bool = False) -> DataFrame:
    """Among the objects matched to one detection, the one seen first (last in
    a reverse pass); lowest id on ties."""
    j = matched.select(*FRAME, "det_id", "obj_id").join(first, OBJ)
    rank = F.struct(-F.col("first_frame") if reverse else F.col("first_frame"), F.col("obj_id"))
    return j.groupBy(*FRAME, "det_id").agg(F.min_by("obj_id", rank).alias("first_obj"), F.count(F.lit(1)).alias("objects"))


def unmatched_removals(history: DataFrame, first: DataFrame, threshold: int = 8, delay: int = 15, span: int = SPAN) -> DataFrame:
    """Objects dropped for missing detections while they are new.

    The count of unmatched frames is never reset. An object goes on the frame
    the count reaches the threshold, if that lies within ``delay`` frames of its
    first one.
    """
    h = prefix(history, OBJ, "frame_idx", {"misses": ("sum", F.when(F.col("matched"), 0).otherwise(1))}, span=span)
    at = h.where(F.col("misses") >= threshold).groupBy(*OBJ).agg(F.min("frame_idx").alias("removed_at"))
    return at.join(first, OBJ).where(F.col("first_frame") > F.col("removed_at") - delay).select(*OBJ, "removed_at")


def duplicate_removals(matched: DataFrame, first: DataFrame, threshold: int = 8, delay: int = 15, span: int = SPAN) -> DataFrame:
    """Objects dropped for sharing detections with an earlier object.

    Each detection pairs its earliest object with each other one, so the pairs
    grow with the matches.
    """
    lead = earliest_match(matched, first).where(F.col("objects") > 1)
    pairs = matched.select(*FRAME, "det_id", "obj_id").join(lead, [*FRAME, "det_id"]).where(F.col("obj_id") != F.col("first_obj"))
    per_frame = pairs.groupBy(*OBJ, "first_obj", "frame_idx").agg(F.count(F.lit(1)).alias("_n"))
    run = prefix(per_frame, [*OBJ, "first_obj"], "frame_idx", {"shared": ("sum", F.col("_n"))}, span=span)
    hit = run.where(F.col("shared") >= threshold).join(first, OBJ).where(F.col("first_frame") > F.col("frame_idx") - delay)
    return hit.groupBy(*OBJ).agg(F.min("frame_idx").alias("removed_at"))


def duplicate_pairs(matched: DataFrame, first: DataFrame) -> DataFrame:
    """Frames shared by each (earlier, later) pair of objects."""
    lead = earliest_match(matched, first).where(F.col("objects") > 1)
    pairs = matched.select(*FRAME, "det_id", "obj_id").join(lead, [*FRAME, "det_id"]).where(F.col("obj_id") != F.col("first_obj"))
    return pairs.groupBy(*OBJ, "first_obj").agg(F.count(F.lit(1)).alias("shared"))


def keep_alive(history: DataFrame, start: int = 30, cap: int = 30, floor: int = -1, span: int = 64) -> DataFrame:
    """Counter that gains one per matched and loses one per missed frame,
    held between ``floor`` and ``cap``."""
    met = F.coalesce(F.col("matched"), F.lit(False))
    return clamped_counter(history, OBJ, "frame_idx", start, cap, floor, "alive", met, ~met, span)


def clamped_counter(rows: DataFrame, keys: list[str], order: str, start: int, cap: int, floor: int, name: str = "alive",
                    gain: Column | None = None, loss: Column | None = None, span: int = 64) -> DataFrame:
    """``keys, order`` and a counter that gains one, at most to ``cap``, where ``gain`` (``matched``) holds and then
    loses one, at least to ``floor``, where ``loss`` (``missed``) holds.

    Such a step is "add d, then keep within lo and hi", and so is any run of
    them. Runs of ``span`` rows are summed up, their runs in turn, and so on
    until one is left; then every run starts from where the one before ended.
    No array holds more than ``span`` rows of an object.
    """
    up = F.col("matched") if gain is None else gain
    down = F.col("missed") if loss is None else loss
    big = lambda v: F.lit(v).cast("bigint")
    step = rows.select(
        *keys, F.col(order).cast("bigint").alias(order), (F.when(up, big(1)).otherwise(big(0)) - F.when(down, big(1)).otherwise(big(0))).alias("d"),
        big(floor).alias("lo"), F.when(up & down, big(max(floor, cap - 1))).otherwise(big(cap)).alias("hi"))
    return _clamped(step, keys, order, start, span).select(*keys, order, F.col("_after").alias(name))


def _clamped(steps: DataFrame, keys: list[str], order: str, start: int, span: int) -> DataFrame:
    """``steps`` (keys, order, d, lo, hi) with the value before (``_before``) and after (``_after``) each."""
    within = lambda s, x: F.least(s["hi"], F.greatest(s["lo"], x + s["d"]))
    low, high = steps.agg(F.min(order), F.max(order)).first()
    run = F.floor((F.col(order) - (low or 0)) / span)
    runs = checkpoint(steps.withColumn("_run", run).groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(order, "d", "lo", "hi"))).alias("_s")))
    both = lambda a, s: F.struct((a["d"] + s["d"]).alias("d"), within(s, a["lo"]).alias("lo"), within(s, a["hi"]).alias("hi"))
    zero = F.struct(F.get("_s", 0)["d"].alias("d"), F.get("_s", 0)["lo"].alias("lo"), F.get("_s", 0)["hi"].alias("hi"))
    total = F.aggregate(F.slice("_s", 2, span), zero, both)
    begin = F.lit(start).cast("bigint")
    if low is not None and high - low >= span:
        whole = runs.select(*keys, F.col("_run").alias("_at"), total.alias("_t")).select(*keys, "_at", "_t.*")
        opened = _clamped(whole, keys, "_at", start, span).select(*keys, F.col("_at").alias("_run"), F.col("_before").alias("_x"))
        runs = runs.join(opened, [*keys, "_run"])
    else:
        runs = runs.withColumn("_x", begin)
    kind = f"array<struct<{order}:bigint,_before:bigint,_after:bigint>>"
    out = lambda a, s: F.struct(within(s, a["x"]).alias("x"), F.concat(a["out"], F.array(F.struct(s[order].alias(order), a["x"].alias("_before"), within(s, a["x"]).alias("_after")))).alias("out"))
    ran = F.aggregate("_s", F.struct(F.col("_x").alias("x"), F.array().cast(kind).alias("out")), out, lambda a: a["out"])
    return runs.select(*keys, F.inline(ran))


def processing_order(videos: DataFrame, most: int | None, reverse: bool) -> DataFrame:
    """Frames of a pass: ``start`` to ``start + most``, both included and kept
    inside the video; backwards from the frame before ``start``. Without
    ``most`` a pass goes to the end of the video."""
    v = videos.where(F.col("start").isNotNull())
    if reverse:
        v = v.where(F.col("start") > 0)
        lo, hi = F.lit(0).cast("bigint") if most is None else F.greatest(F.col("start") - most, F.lit(0)), F.col("start") - 1
    else:
        lo, hi = F.col("start"), F.col("n") - 1 if most is None else F.least(F.col("start") + most, F.col("n") - 1)
    v = v.select("video_id", F.lit(not reverse).alias("forward"), "start", F.explode(F.sequence(lo, hi)).alias("frame_idx"))
    step = F.col("start") - 1 - F.col("frame_idx") if reverse else F.col("frame_idx") - F.col("start")
    return v.select("video_id", "forward", "frame_idx", step.alias("step"))


def delayed_emit(frames: DataFrame, removals: DataFrame, last: DataFrame, delay: int) -> DataFrame:
    """Rows shown when each frame leaves a buffer of ``delay`` frames.

    A frame leaves once ``delay`` frames are held, or at the end of the video;
    objects removed by then are hidden on it. Without a delay nothing removed
    is hidden. ``last`` brings the last frame ``last`` per video.
    """
    if delay == 0:
        return frames.withColumn("emitted_at", F.col("frame_idx"))
    j = frames.join(last.select("video_id", "last"), "video_id")
    j = j.withColumn("emitted_at", F.least(F.col("frame_idx") + delay - 1, F.col("last")))
    r = removals.select(*OBJ, "removed_at")
    return j.join(r, OBJ, "left").where(F.col("removed_at").isNull() | (F.col("removed_at") > F.col("emitted_at"))).drop("removed_at", "last")


def tombstones(scores: DataFrame, removed: DataFrame, log: DataFrame) -> DataFrame:
    """Keep removed objects as rows marked so, with the score that hides them,
    and whether the object was ever added or refined by hand."""
    r = removed.select(*OBJ).distinct().withColumn("removed", F.lit(True))
    touched = log.where(F.col("type").isin("add", "refine")).select(F.col("session_id").alias("video_id"), "obj_id").distinct().withColumn("refined", F.lit(True))
    j = scores.join(r, OBJ, "left").join(touched, OBJ, "left")
    gone = F.coalesce("removed", F.lit(False))
    return j.withColumns({"removed": gone, "refined": F.coalesce("refined", F.lit(False)),
                          "score": F.when(gone, F.lit(-1e4)).otherwise(F.col("score"))})


def propagation_plan(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """What each session should run next, from its action log.

    ``actions``: session_id, seq, type, frame_idx, obj_id. ``sessions``:
    session_id and its frame count ``n``. Only the last two actions and the
    edits since the last propagation matter, and all three are aggregates.
    """
    row = F.struct("seq", "type", "frame_idx", "obj_id")
    is_prop = F.col("type").startswith("propagation")
    last = actions.groupBy("session_id").agg(F.max(row).alias("_last"), F.max(F.when(is_prop, F.col("seq"))).alias("_prop"))
    prev = actions.join(last.select("session_id", F.col("_last.seq").alias("_ls")), "session_id").where(F.col("seq") < F.col("_ls"))
    prev = prev.groupBy("session_id").agg(F.max_by("type", "seq").alias("_prev"))
    edits = actions.join(last.select("session_id", "_prop"), "session_id").where(
        F.col("type").isin("add", "refine") & (F.col("_prop").isNull() | (F.col("seq") > F.col("_prop"))))
    edits = edits.select("session_id", "obj_id").distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("obj_id")).alias("_ids"))
    j = sessions.join(last, "session_id", "left").join(prev, "session_id", "left").join(edits, "session_id", "left")
    ran = lambda c: F.coalesce(F.col(c).isin("propagation_full", "propagation_partial"), F.lit(False))
    at_end = F.col("_last.frame_idx").isin(0) | (F.col("_last.frame_idx") == F.col("n") - 1)
    plan = (F.when(F.col("_last").isNull(), "propagation_full")
            .when(F.col("_last.type") == "propagation_fetch", "propagation_fetch")
            .when(ran("_last.type") & (ran("_prev") | at_end), "propagation_fetch")
            .when(ran("_last.type"), F.col("_last.type"))
            .when(F.col("_ids").isNotNull(), "propagation_partial").otherwise("propagation_fetch"))
    again = ran("_last.type") & ~ran("_prev") & ~at_end
    ids = F.when(again, F.array("_last.obj_id")).when(plan == "propagation_partial", F.col("_ids"))
    return j.select("session_id", plan.alias("plan"), ids.alias("obj_ids"))
