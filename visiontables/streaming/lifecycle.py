"""Object lifecycle over the frames of a video.

``VideoTracker`` takes one frame of detections at a time: it matches them with
the live objects, opens and drops objects, keeps their counters, and holds each
frame back for ``delay`` frames so that objects dropped meanwhile never show.
Its state is the live objects and the frames held back, whatever the length of
the video. The stream keeps that state per video in the state store
and drops it when the video ends; the batch form runs the same steps over frames sorted within each partition, reading row
by row without gathering a video.

A live object's mask is the box of its last matched detection.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, MutableMapping
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = ("video_id bigint, frame_idx bigint, obj_id bigint, x1 double, y1 double, x2 double, y2 double,"
          " prob double, tracker_prob double, confirmed boolean")
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
# A removed object counts as hidden after all others.
REMOVED_OCCLUSION = math.inf
NEVER = -1


@dataclass(frozen=True)
class TrackerConfig:
    """Thresholds of the lifecycle (fixed default values)."""

    assoc_iou: float = 0.1
    track_iou: float = 0.5
    new_score: float = 0.7
    delay: int = 15
    unmatched: int = 8
    duplicates: int = 8
    alive_start: int = 30
    alive_cap: int = 30
    alive_floor: int = -1
    suppress_only_when_new: bool = True
    overlap: float = 0.7
    most_objects: int | None = None
    boundary: float | None = None
    width: float = 1.0
    height: float = 1.0
    confirm: int | None = None
    # a pass that goes on before another one's first frame: objects of its later frames get negative ids
    continues: bool = False


@dataclass
class Track:
    obj_id: int
    box: list[float]
    score: float
    first: int
    tracker_score: float = 0.0
    misses: int = 0
    alive: int = 30
    streak: int = 0
    confirmed: bool = False
    occluded: int = NEVER
    shared: dict[int, int] = field(default_factory=dict)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    wh = np.maximum(hi - lo, 0.0)
    inter = wh[..., 0] * wh[..., 1]
    size = lambda m: (m[:, 2] - m[:, 0]) * (m[:, 3] - m[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


class VideoTracker:
    def __init__(self, config: TrackerConfig, state: str | None = None):
        self.config = config
        s = json.loads(state) if state else {}
        by_frame = lambda name: {int(k): v for k, v in s.get(name, {}).items()}
        self.frame = s.get("frame", -1)
        self.top = s.get("top", 0)
        self.late = s.get("late", 0)
        self.tracks = [Track(**{**t, "shared": {int(k): n for k, n in t["shared"].items()}}) for t in s.get("tracks", [])]
        # dictionaries by frame: rows still coming in, rows held back with the ids hidden on that frame
        # only, and ids unconfirmed, kept while a held frame may look ahead to them
        self.coming, self.held, self.unsure = by_frame("coming"), by_frame("held"), by_frame("unsure")
        # objects dropped while frames that show them are held
        self.dropped = by_frame("dropped")

    def dump(self) -> str:
        return json.dumps({
            "frame": self.frame, "top": self.top, "late": self.late, "tracks": [asdict(t) for t in self.tracks],
            "coming": dict(self.coming), "held": dict(self.held), "unsure": dict(self.unsure), "dropped": dict(self.dropped)})

    # ---- input --------------------------------------------------------------------------
    def take(self, rows: list[tuple]) -> list[tuple]:
        """Keep rows (frame, det_id, x1, y1, x2, y2, score), det_id NULL for an
        empty frame, until their frame runs. Returns the detections that are
        late: their frame has run."""
        new: dict[int, list] = {}
        late = []
        for r in rows:
            if r[0] > self.frame:
                new.setdefault(r[0], []).append(r)
            else:
                self.late += 1
                if r[1] is not None:
                    late.append(r)
        for f, some in new.items():
            self.coming[f] = [*self.coming.get(f, []), *some]
        return late

    def run(self, ended: bool) -> Iterator[list[tuple]]:
        """What leaves the buffer as frames run, in order. Frames are those
        with a row; one runs once a later one shows up, or the video has ended."""
        ready = sorted(self.coming)
        for f in ready if ended else ready[:-1]:
            rows = sorted((r for r in self.coming[f] if r[1] is not None), key=lambda r: r[1])
            del self.coming[f]
            yield self.step(f, rows)
        if ended:
            last = self.frame
            for f in sorted(self.held):
                yield self.show(f, last)

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.take(rows)
        return [r for some in self.run(False) for r in some]

    def finish(self) -> list[tuple]:
        return [r for some in self.run(True) for r in some]

    # ---- one frame ---------------------------------------------------------------------------
    def step(self, f: int, rows: list) -> list[tuple]:
        c = self.config
        boxes = np.array([r[2:6] for r in rows], float).reshape(-1, 4)
        scores = np.array([r[6] for r in rows], float)
        live = list(self.tracks)
        tboxes = np.array([t.box for t in live], float).reshape(-1, 4)
        filled = (tboxes[:, 2] > tboxes[:, 0]) & (tboxes[:, 3] > tboxes[:, 1])
        iou = iou_matrix(boxes, tboxes)
        hit = iou >= c.assoc_iou
        new = np.ones(len(rows), bool) if not live else (scores >= c.new_score) & ~hit.any(axis=1)
        opened = self.admit(np.flatnonzero(new), boxes, scores, len(live))
        matched = hit.any(axis=0)
        unmatched = filled & ~(iou >= c.track_iou).any(axis=0) if len(rows) else filled
        for t, m, u in zip(live, matched, unmatched):
            if m:
                t.alive = min(c.alive_cap, t.alive + 1)
            if u:
                t.misses += 1
                t.alive = max(c.alive_floor, t.alive - 1)
        sign = -1 if c.continues and self.frame >= 0 else 1
        for d in opened:
            self.top += 1
            self.tracks.append(Track(sign * self.top, boxes[d].tolist(), float(scores[d]), f, float(scores[d]), alive=c.alive_start))
        removed = {t.obj_id for t in live if t.misses >= c.unmatched and t.first > f - c.delay}
        faded = {t.obj_id for t in live if t.misses and t.alive <= 0 and t.obj_id not in removed} if not c.suppress_only_when_new else set()
        removed |= self.duplicates(f, live, hit, removed)
        self.occlude(f, live, tboxes, filled, removed)
        self.tracks = [t for t in self.tracks if t.obj_id not in removed]
        ids = {t.obj_id for t in self.tracks[len(self.tracks) - len(opened):]} if opened else set()
        for t, m, col in zip(live, matched, iou.T if len(rows) else [None] * len(live)):
            t.streak = t.streak + 1 if m else 0
            if m:
                d = int(np.argmax(col))
                t.box, t.tracker_score = boxes[d].tolist(), float(col[d])
        for t in self.tracks:
            if t.obj_id in ids:
                t.streak = 1
            t.confirmed = t.confirmed or (c.confirm is not None and t.streak >= c.confirm)
        self.frame = f
        shown = [[t.obj_id, *t.box, t.score, t.tracker_score, t.confirmed] for t in self.tracks
                 if t.box[2] > t.box[0] and t.box[3] > t.box[1] and t.occluded != f]
        if c.confirm is not None:
            self.unsure[f] = [t.obj_id for t in self.tracks if not t.confirmed]
        if c.delay <= 0:
            return [(f, *r) for r in shown if r[0] not in faded]
        # an object dropped now disappears from every frame still held
        for i in removed:
            self.dropped[i] = f
        self.held[f] = [shown, sorted(faded)]
        if len(self.held) < c.delay:
            return []
        return self.show(min(self.held), f)

    def show(self, f: int, last: int) -> list[tuple]:
        c = self.config
        rows, hidden = self.held[f]
        del self.held[f]
        gone = {*hidden, *self.dropped}
        for i in [i for i, g in self.dropped.items() if g <= f]:
            del self.dropped[i]
        if c.confirm is not None:
            gone |= set(self.unsure.get(min(f + c.confirm - 1, last), ()))
            for k in [k for k in self.unsure if k < f]:
                del self.unsure[k]
        return [(f, *r) for r in rows if r[0] not in gone]

    def admit(self, new: np.ndarray, boxes: np.ndarray, scores: np.ndarray, used: int) -> list[int]:
        c = self.config
        if c.boundary is not None:
            x = (boxes[new, 0] + boxes[new, 2]) / 2 / c.width
            y = (boxes[new, 1] + boxes[new, 3]) / 2 / c.height
            m = c.boundary
            new = new[(x > m) & (x < 1 - m) & (y > m) & (y < 1 - m)]
        if c.most_objects is not None and len(new) > (room := max(c.most_objects - used, 0)):
            new = np.sort(new[np.argsort(-scores[new], kind="stable")[:room]])
        return new.tolist()

    def duplicates(self, f: int, live: list[Track], hit: np.ndarray, removed: set) -> set:
        """Objects that shared enough detections with an earlier one while new."""
        for row in hit:
            sharing = [live[i] for i in np.flatnonzero(row)]
            if len(sharing) > 1:
                first = min(sharing, key=lambda t: t.first)
                for t in sharing:
                    if t is not first:
                        t.shared[first.obj_id] = t.shared.get(first.obj_id, 0) + 1
        return {t.obj_id for t in live if t.obj_id not in removed and t.first > f - self.config.delay
                and any(n >= self.config.duplicates for n in t.shared.values())}

    def occlude(self, f: int, live: list[Track], tboxes: np.ndarray, filled: np.ndarray, removed: set) -> None:
        """Of two objects on the same place, hide the one hidden more recently,
        provided the other has been hidden before."""
        if not live or self.config.overlap <= 0:
            return
        seen = np.array([REMOVED_OCCLUSION if t.obj_id in removed and t.occluded == NEVER else t.occluded for t in live])
        close = iou_matrix(tboxes, tboxes) >= self.config.overlap
        np.fill_diagonal(close, False)
        hide = (close & (seen[:, None] > seen[None, :]) & (seen[None, :] > NEVER)).any(axis=1)
        for t, out in zip(live, hide | ~filled):
            t.occluded = f if out else t.occluded


# ---- Spark ---------------------------------------------------------------------------------------

_OUT_ROWS = 4096
_FEED = ["frame_idx", "det_id", "x1", "y1", "x2", "y2", "score"]


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    num = lambda v: None if pd.isna(v) else float(v)
    return [(int(f), None if pd.isna(d) else int(d), *map(num, rest)) for f, d, *rest in pdf[_FEED].itertuples(index=False)]


def _frame_out(video, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(video, *r) for r in rows], columns=_NAMES)


def track_batch(dets: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Tracked objects of every video in one pass over sorted frames."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracker = None, None
        for pdf in batches:
            for v, part in pdf.groupby("video_id", sort=False):
                if v != video:
                    if tracker is not None:
                        yield _frame_out(video, tracker.finish())
                    video, tracker = v, VideoTracker(config)
                yield _frame_out(video, tracker.feed(_rows(part)))
        if tracker is not None:
            yield _frame_out(video, tracker.finish())

    ordered = dets.select("video_id", *_FEED).repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "det_id")
    return ordered.mapInPandas(run, OUTPUT)


_META = "frame bigint, top bigint, late bigint"
_TRACK = ("x1 double, y1 double, x2 double, y2 double, score double, first bigint, tracker_score double,"
          " misses bigint, alive bigint, streak bigint, confirmed boolean, occluded bigint")
_ROWS = "rows array<struct<obj_id:bigint,x1:double,y1:double,x2:double,y2:double,prob:double,tracker_prob:double,confirmed:boolean>>, hidden array<bigint>"
_DETS = "rows array<struct<frame_idx:bigint,det_id:bigint,x1:double,y1:double,x2:double,y2:double,score:double>>"


class _Kept(MutableMapping):
    """A map state as a dictionary: entries are read when asked for, and only those that changed are written back.

    The state of a ``fresh`` video has no entries. Entries that come and go
    between two writes never reach the state.
    """

    def __init__(self, state, load, store, fresh: bool = False):
        self.state, self.load, self.store = state, load, store
        self.read: dict = {}
        self.changed: set = set()
        self.names: set = set() if fresh else {k[0] for k in state.keys()}
        self.stored: set = set(self.names)

    def __getitem__(self, key):
        if key not in self.names:
            raise KeyError(key)
        if key not in self.read:
            self.read[key] = self.load(self.state.getValue((key,)))
        return self.read[key]

    def __setitem__(self, key, value) -> None:
        self.names.add(key)
        self.read[key] = value
        self.changed.add(key)

    def __delitem__(self, key) -> None:
        self.names.remove(key)
        self.read.pop(key, None)
        self.changed.add(key)

    def __iter__(self):
        return iter(sorted(self.names))

    def __len__(self) -> int:
        return len(self.names)

    def flush(self) -> int:
        for key in self.changed:
            if key in self.names:
                self.state.updateValue((key,), self.store(self.read[key]))
            elif key in self.stored:
                self.state.removeKey((key,))
        self.stored = set(self.names)
        return len(self.changed)


class _Lifecycle(StatefulProcessor):
    """One video's state: an entry per object, per held frame, and per frame still coming in."""

    def __init__(self, config: TrackerConfig, idle: int | None, ttl: int | None):
        self.config, self.idle, self.ttl = config, idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        by = lambda name, key, value: handle.getMapState(name, f"{key} bigint", value, self.ttl)
        self.meta = handle.getValueState("meta", _META, self.ttl)
        self.maps = {
            "objects": by("objects", "obj_id", _TRACK), "shared": by("shared", "obj_id", "leads array<struct<lead:bigint,n:bigint>>"), "held": by("held", "frame_idx", _ROWS),
            "coming": by("coming", "frame_idx", _DETS), "dropped": by("dropped", "obj_id", "frame bigint"), "unsure": by("unsure", "frame_idx", "ids array<bigint>")}

    def _open(self) -> tuple[VideoTracker, dict[str, _Kept]]:
        one = (lambda v: v[0]), (lambda v: (v,))
        codecs = {
            "objects": (tuple, tuple), "shared": (lambda v: {r[0]: r[1] for r in v[0]}, lambda v: (list(v.items()),)), "held": (lambda v: [[tuple(r) for r in v[0]], list(v[1])], lambda v: ([tuple(r) for r in v[0]], list(v[1]))),
            "coming": (lambda v: [tuple(r) for r in v[0]], lambda v: (v,)), "dropped": one, "unsure": (lambda v: list(v[0]), lambda v: (list(v),))}
        # every close writes meta, so there are no entries without it
        known = self.meta.exists()
        kept = {n: _Kept(s, *codecs[n], fresh=not known) for n, s in self.maps.items()}
        tracker = VideoTracker(self.config)
        if known:
            tracker.frame, tracker.top, tracker.late = self.meta.get()
        tracker.tracks = [Track(i, list(v[:4]), *v[4:], shared=dict(kept["shared"].get(i, {}))) for i, v in sorted(kept["objects"].items(), key=lambda x: (x[1][5], abs(x[0])))]
        tracker.held, tracker.coming, tracker.dropped, tracker.unsure = (kept[n] for n in ("held", "coming", "dropped", "unsure"))
        return tracker, kept

    def _close(self, tracker: VideoTracker, kept: dict[str, _Kept]) -> None:
        live = {t.obj_id: t for t in tracker.tracks}
        for i in [i for i in kept["objects"] if i not in live]:
            del kept["objects"][i]
        for i in [i for i in kept["shared"] if i not in live]:
            del kept["shared"][i]
        for i, t in live.items():
            now = (*t.box, t.score, t.first, t.tracker_score, t.misses, t.alive, t.streak, t.confirmed, t.occluded)
            if kept["objects"].get(i) != now:
                kept["objects"][i] = now
            if t.shared and kept["shared"].get(i) != t.shared:
                kept["shared"][i] = dict(t.shared)
        for k in kept.values():
            k.flush()
        self.meta.update((tracker.frame, tracker.top, tracker.late))

    def _forget(self) -> None:
        self.meta.clear()
        for s in self.maps.values():
            s.clear()

    def _wait(self, timerValues) -> None:
        if self.idle is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if timerValues is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker, kept = self._open()
        ended = False
        for pdf in rows:
            ended = ended or bool(pdf["end_of_video"].any())
            late = tracker.take(_rows(pdf[~pdf["end_of_video"]]))
            if late:
                yield _late_out(key[0], late)
        yield from _stream_out(key[0], tracker.run(ended))
        if ended:
            self._forget()
            self._wait(None)
        else:
            self._close(tracker, kept)
            self._wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker, _ = self._open()
        yield from _stream_out(key[0], tracker.run(True))
        self._forget()

    def close(self) -> None:
        pass


def _stream_out(video, frames: Iterator[list[tuple]]) -> Iterator[pd.DataFrame]:
    """Rows of many frames at a time: a table per frame costs more than the frame."""
    rows: list[tuple] = []
    for some in frames:
        rows += some
        if len(rows) >= _OUT_ROWS:
            yield _frame_out(video, rows).assign(late=False)
            rows = []
    if rows:
        yield _frame_out(video, rows).assign(late=False)


def _late_out(video, rows: list[tuple]) -> pd.DataFrame:
    """Detections of frames that have run: without object, the score as probability."""
    return pd.DataFrame([(video, f, None, *box, s, None, None, True) for f, _, *box, s in rows], columns=[*_NAMES, "late"])


def frame_stream(spark, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Detection rows as they arrive as Parquet files in ``path`` and the folders in it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def track_stream(dets: DataFrame, config: TrackerConfig = TrackerConfig(), idle: int | None = None, ttl: int | None = None) -> DataFrame:
    """The same over a stream; a row with ``end_of_video`` closes its video.

    With ``idle``, a video without such a row is closed once no row of it has
    come for so many milliseconds. State is dropped when a video closes; ``ttl``
    (milliseconds) lets entries go that were not written for so long, whatever
    happens. Both go by the clock, so they are for streams that run on: a
    stream that is to end with its input (``availableNow``) would wait for the
    clock for ever. A micro-batch reads and writes the entries it changes: live
    objects, the frames coming in and those leaving the buffer, not the whole
    video.

    Adds ``late``: a detection of a frame that has run comes out as a row with
    ``late`` true, its box and score, and no object.

    Needs the RocksDB state store (``use_rocksdb``).
    """
    rows = dets.select("video_id", *_FEED, F.coalesce("end_of_video", F.lit(False)).alias("end_of_video"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(config, idle, ttl), outputStructType=OUTPUT + ", late boolean", outputMode="Update",
        timeMode="None" if idle is None and ttl is None else "ProcessingTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bidirectional(dets: DataFrame, starts: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """A forward pass from each video's start and a backward pass before it.

    The backward pass runs over mirrored frame numbers. It takes the start
    frame too, where it opens the same objects with the same ids; objects that
    only it meets get negative ids. Each frame is shown by one pass, so the
    union has one set of ids.
    """
    j = dets.join(starts.select("video_id", "start"), "video_id")
    ahead = track_batch(j.where("frame_idx >= start"), config)
    mirrored = j.where("frame_idx <= start").withColumn("frame_idx", F.col("start") - F.col("frame_idx"))
    back = track_batch(mirrored, replace(config, continues=True)).where("frame_idx > 0").join(starts.select("video_id", "start"), "video_id")
    back = back.withColumn("frame_idx", F.col("start") - F.col("frame_idx")).drop("start")
    return ahead.withColumn("forward", F.lit(True)).unionByName(back.withColumn("forward", F.lit(False)))
