"""The object lifecycle over tables of frames, as one plan.

The stream (``streaming.lifecycle``) makes its own boxes and keeps a state per
video. Here the tracker's boxes are given, a row per object and frame, and all
counters are running values of an object's rows: they are taken in blocks of
frames, so one long video spreads over many tasks. What objects do to each
other (sharing detections, hiding one another) looks back in time only, so it
is settled by rounds: each round is right for at least one more frame, and the
rounds end when nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.operators import filters as FL
from visiontables.operators import overlap as O
from visiontables.operators import tracks as K
from visiontables.operators.numbering import position_in_order
from visiontables.operators.select import within_capacity
from visiontables.operators.tracks import clamped_counter
from visiontables.session import checkpoint, is_empty

FRAME, OBJ = K.FRAME, K.OBJ
NEVER = -1


@dataclass(frozen=True)
class Lifecycle:
    """``states``: a row per object and frame up to its removal. ``opened``: detections that open objects, with their ids."""

    states: DataFrame
    opened: DataFrame

    def shown(self) -> DataFrame:
        return self.states.where("shown")


def lifecycle_batch(dets: DataFrame, tracks: DataFrame, config, span: int = K.SPAN) -> Lifecycle:
    """What becomes of every tracked object on every frame.

    ``dets``: video_id, frame_idx, det_id, box, score (``det_id`` null: an empty
    frame). ``tracks``: video_id, frame_idx, obj_id, box, tracker_score, the
    tracker's box of each object on each frame; an object without a row on a
    frame is not there. ``config`` is a ``TrackerConfig``.

    On the frame an object is first seen on it counts as matched. Later it is
    matched if a detection meets its box by ``assoc_iou``, and missed if its
    box has area and none meets it by ``track_iou``. ``states`` holds

    * ``misses``, never reset, ``alive``, the keep-alive counter, ``streak`` and
      ``confirmed``;
    * ``removed_at``: the frame on which misses reach ``unmatched``, or the
      detections shared with an object seen earlier reach ``duplicates``, while
      the object is new (less than ``delay`` frames old). Removed objects take
      part in nothing later;
    * ``occluded``: the box is empty, or covers one of another object by
      ``overlap``, both were occluded before and this one more recently (an
      object on its removal, and never occluded, counts as the most recent);
    * ``emitted_at``: the frame on which the row leaves the buffer of ``delay``
      frames, and ``shown``: not removed until then, not empty or occluded,
      confirmed by the frame looked ahead to, and alive if that is asked for.

    ``opened`` are detections that no live object meets and that score
    ``new_score`` (any, on a frame without live objects), away from the
    ``boundary`` and within ``most_objects``; ids count on from the video's
    highest, in order of frames and detections.
    """
    c = config
    dets = dets.where("det_id is not null").select(*FRAME, "det_id", *B.BOX, "score")
    tracks = tracks.select(*FRAME, "obj_id", *B.BOX, "tracker_score")
    pairs = checkpoint(K.box_pairs(dets, tracks.where(B.nonempty()), min(c.assoc_iou, c.track_iou)))
    history = checkpoint(_history(tracks, pairs, c, span))
    removed = checkpoint(removals(history, pairs, c, span))
    live = lambda df: df.join(removed, OBJ, "left").where("removed_at is null or frame_idx <= removed_at")
    states = live(history)
    states = states.join(
        clamped_counter(states, ["video_id", "obj_id"], "frame_idx", c.alive_start, c.alive_cap, c.alive_floor), [*OBJ, "frame_idx"])
    states = states.join(occluded(states, c, span), [*FRAME, "obj_id"], "left").withColumn("occluded", F.coalesce("occluded", ~F.col("filled")))
    last = dets.select(*FRAME).unionByName(tracks.select(*FRAME)).groupBy("video_id").agg(F.max("frame_idx").alias("last"))
    states = states.join(last, "video_id").withColumn("emitted_at", F.least(F.col("frame_idx") + max(c.delay - 1, 0), F.col("last")))
    gone = F.coalesce(F.col("removed_at") <= F.col("emitted_at"), F.lit(False))
    shown = F.col("filled") & ~F.col("occluded") & ~gone
    if not c.suppress_only_when_new:
        shown = shown & ~((F.col("misses") > 0) & (F.col("alive") <= 0))
    states = checkpoint(states.withColumn("shown", shown))
    if c.confirm is not None:
        status = states.withColumn("status", F.when(F.col("confirmed"), K.CONFIRMED).otherwise(K.UNCONFIRMED))
        status = status.where("removed_at is null or frame_idx < removed_at")
        early = K.confirmed_lookahead(status, last.select("video_id", (F.col("last") + 1).alias("n")), c.confirm).distinct()
        states = states.join(early.withColumn("_early", F.lit(True)), [*FRAME, "obj_id"], "left").withColumn("shown", F.col("shown") & F.col("_early").isNull())
    out = states.select(*FRAME, "obj_id", *B.BOX, "tracker_score", "matched", "misses", "alive", "streak", "confirmed", "occluded", "removed_at", "emitted_at", "shown")
    return Lifecycle(out, _opened(dets, live(tracks), tracks, pairs, c))


def _history(tracks: DataFrame, pairs: DataFrame, c, span: int) -> DataFrame:
    """Every track row with what its own detections tell: matched, missed, running misses, streak."""
    best = pairs.groupBy(*FRAME, "obj_id").agg(F.max("iou").alias("_best"))
    first = tracks.groupBy(*OBJ).agg(F.min("frame_idx").alias("first_frame"))
    h = tracks.join(best, [*FRAME, "obj_id"], "left").join(first, OBJ)
    born, by = F.col("frame_idx") == F.col("first_frame"), lambda least: F.coalesce(F.col("_best") >= least, F.lit(False))
    h = h.withColumns({"filled": B.nonempty(), "matched": born | by(c.assoc_iou), "missed": ~born & B.nonempty() & ~by(c.track_iou)}).drop("_best")
    h = K.prefix(h, OBJ, "frame_idx", {"misses": ("sum", F.col("missed").cast("bigint"))}, span=span)
    h = K.confirmation_streak(h, c.confirm if c.confirm is not None else 1, span)
    confirmed = F.col("status") == K.CONFIRMED if c.confirm is not None else F.lit(False)
    return h.withColumn("confirmed", confirmed).drop("status")


def removals(history: DataFrame, pairs: DataFrame, c, span: int = K.SPAN) -> DataFrame:
    """``video_id, obj_id, removed_at`` of the objects removed while new.

    An object's leader on a detection is the earliest live object there, so
    removing one may change who shares with whom on later frames; rounds go on
    until no removal changes.
    """
    new = F.col("first_frame") > F.col("frame_idx") - c.delay
    missed = checkpoint(history.where((F.col("misses") >= c.unmatched) & new).groupBy(*OBJ).agg(F.min("frame_idx").alias("removed_at")))
    first = history.select(*FRAME, "obj_id", "first_frame").where("frame_idx > first_frame")
    hits = pairs.where(F.col("iou") >= c.assoc_iou).select(*FRAME, "det_id", "obj_id").join(first, [*FRAME, "obj_id"])
    several = hits.groupBy(*FRAME, "det_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    shared = checkpoint(hits.join(several, [*FRAME, "det_id"], "left_semi"))
    removed = missed
    if is_empty(shared):
        return removed
    while True:
        here = shared.join(removed, OBJ, "left").where("removed_at is null or frame_idx <= removed_at").drop("removed_at")
        lead = here.groupBy(*FRAME, "det_id").agg(F.min(F.struct("first_frame", "obj_id"))["obj_id"].alias("lead"))
        met = here.join(lead, [*FRAME, "det_id"]).where("obj_id <> lead").groupBy(*OBJ, "lead", "frame_idx", "first_frame").agg(F.count(F.lit(1)).alias("_n"))
        run = K.prefix(met, [*OBJ, "lead"], "frame_idx", {"_shared": ("sum", F.col("_n"))}, span=span)
        twice = run.where((F.col("_shared") >= c.duplicates) & new).groupBy(*OBJ).agg(F.min("frame_idx").alias("removed_at"))
        now = checkpoint(missed.unionByName(twice).groupBy(*OBJ).agg(F.min("removed_at").alias("removed_at")))
        if is_empty(now.exceptAll(removed)) and is_empty(removed.exceptAll(now)):
            return now
        removed = now


def occluded(states: DataFrame, c, span: int = K.SPAN) -> DataFrame:
    """``occluded`` of the rows of objects that ever lie on another one; the others are occluded where empty."""
    if c.overlap <= 0:
        return states.where("false").select(*FRAME, "obj_id", (~F.col("filled")).alias("occluded"))
    filled = states.where("filled").select(*FRAME, "obj_id", *B.BOX)
    close = O.iou_join(filled, filled, c.overlap, FRAME, "obj_id", "obj_id", once=True).select(*FRAME, F.col("obj_id").alias("a"), F.col("obj_id_2").alias("b"))
    close = checkpoint(close.unionByName(close.select(*FRAME, F.col("b").alias("a"), F.col("a").alias("b"))))
    some = close.select("video_id", F.col("a").alias("obj_id")).distinct()
    rows = states.select(*FRAME, "obj_id", "filled", F.coalesce(F.col("removed_at") == F.col("frame_idx"), F.lit(False)).alias("_out"))
    rows = checkpoint(rows.join(some, OBJ, "left_semi").withColumn("occluded", ~F.col("filled")))
    while not is_empty(close):
        seen = K.prefix(rows, OBJ, "frame_idx", {"_upto": ("max", F.when(F.col("occluded"), F.col("frame_idx")))}, span=span)
        # the newest occlusion before this frame: place rows by number and take the one before
        seen = _previous(seen, span)
        rank = F.when(F.col("_out") & F.col("_seen").isNull(), F.lit(1 << 62)).otherwise(F.coalesce("_seen", F.lit(NEVER))).cast("bigint")
        seen = checkpoint(seen.select(*FRAME, "obj_id", "filled", "_out", "occluded", rank.alias("_rank")))
        of = lambda n: seen.select(*FRAME, F.col("obj_id").alias(n), F.col("_rank").alias(f"_{n}"))
        hidden = close.join(of("a"), [*FRAME, "a"]).join(of("b"), [*FRAME, "b"]).where((F.col("_a") > F.col("_b")) & (F.col("_b") > NEVER))
        hidden = hidden.select(*FRAME, F.col("a").alias("obj_id")).distinct().withColumn("_hidden", F.lit(True))
        now = seen.join(hidden, [*FRAME, "obj_id"], "left").withColumn("_now", ~F.col("filled") | F.coalesce("_hidden", F.lit(False)))
        now = checkpoint(now)
        settled = is_empty(now.where("_now <> occluded"))
        rows = now.select(*FRAME, "obj_id", "filled", "_out", F.col("_now").alias("occluded"))
        if settled:
            break
    return rows.select(*FRAME, "obj_id", "occluded")


def _previous(rows: DataFrame, span: int) -> DataFrame:
    """``_upto`` of the object's row before, as ``_seen``."""
    own = K.prefix(rows, OBJ, "frame_idx", {"_pos": ("sum", F.lit(1))}, span=span)
    before = own.where("_upto is not null").select(*OBJ, (F.col("_pos") + 1).alias("_pos"), F.col("_upto").alias("_seen"))
    return own.drop("_upto").join(before, [*OBJ, "_pos"], "left").drop("_pos")


def _opened(dets: DataFrame, live: DataFrame, tracks: DataFrame, pairs: DataFrame, c) -> DataFrame:
    live = live.select(*FRAME, "obj_id")
    met = pairs.join(live, [*FRAME, "obj_id"], "left_semi")
    new = K.new_detections(dets, live, met, c.assoc_iou, c.new_score)
    if c.boundary is not None:
        new = FL.drop_near_boundary(new.withColumns({"_w": F.lit(c.width), "_h": F.lit(c.height)}), "_w", "_h", c.boundary)
    if c.most_objects is not None:
        new = within_capacity(new, live, c.most_objects, FRAME)
    top = tracks.groupBy("video_id").agg(F.max("obj_id").alias("_top"))
    placed = position_in_order(new.select(*FRAME, "det_id", *B.BOX, "score"), ["video_id"], [F.asc("frame_idx"), F.asc("det_id")], "_pos")
    placed = placed.join(top, "video_id", "left").withColumn("obj_id", F.coalesce("_top", F.lit(0)) + F.col("_pos"))
    return placed.select(*FRAME, "det_id", "obj_id", *B.BOX, "score")
