"""The lifecycle over tables against a plain pass frame by frame."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from visiontables.operators import lifecycle as L
from visiontables.streaming.lifecycle import TrackerConfig

DETS = "video_id bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double"
TRACKS = "video_id bigint, frame_idx bigint, obj_id bigint, x1 double, y1 double, x2 double, y2 double, tracker_score double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = size(a) + size(b) - inter
    return inter / union if union > 0 else 0


def plain(dets, tracks, c):
    """States and opened detections of one video, one frame after the other."""
    last = max([d[0] for d in dets] + [t[0] for t in tracks])
    first, misses, alive, streak, confirmed, removed, seen, shared = {}, defaultdict(int), {}, defaultdict(int), set(), {}, {}, defaultdict(int)
    states, opened, unsure = [], [], defaultdict(set)
    top, n = max([t[1] for t in tracks], default=0), 0
    for f in range(last + 1):
        here = {t[1]: t[2] for t in tracks if t[0] == f and t[1] not in removed}
        found = [d for d in dets if d[0] == f]
        filled = {o: b[2] > b[0] and b[3] > b[1] for o, b in here.items()}
        hit = {(d[1], o): iou(d[2], b) for d in found for o, b in here.items() if filled[o]}
        met = {d for (d, _), v in hit.items() if v >= c.assoc_iou}
        new = [d for d in found if d[1] not in met and (not here or d[3] >= c.new_score)]
        for d in sorted(new, key=lambda d: d[1]):
            n += 1
            opened.append((f, d[1], top + n))
        born = {o for o in here if first.setdefault(o, f) == f}
        match = {o: o in born or any(v >= c.assoc_iou for (_, x), v in hit.items() if x == o) for o in here}
        miss = {o: o not in born and filled[o] and not any(v >= c.track_iou for (_, x), v in hit.items() if x == o) for o in here}
        gone = set()
        for o in here:
            misses[o] += miss[o]
            a = alive.get(o, c.alive_start)
            a = min(c.alive_cap, a + 1) if match[o] else a
            alive[o] = max(c.alive_floor, a - 1) if miss[o] else a
            streak[o] = streak[o] + 1 if match[o] else 0
            if c.confirm is not None and streak[o] >= c.confirm:
                confirmed.add(o)
            if misses[o] >= c.unmatched and first[o] > f - c.delay:
                gone.add(o)
        for d in found:
            sharing = [o for o in here if o not in born and hit.get((d[1], o), 0) >= c.assoc_iou]
            if len(sharing) > 1:
                lead = min(sharing, key=lambda o: (first[o], o))
                for o in sharing:
                    if o != lead:
                        shared[o, lead] += 1
                        if shared[o, lead] >= c.duplicates and first[o] > f - c.delay:
                            gone.add(o)
        rank = {o: 1 << 62 if o in gone and o not in seen else seen.get(o, -1) for o in here}
        hidden = {a for a in here for b in here if a != b and filled[a] and filled[b] and iou(here[a], here[b]) >= c.overlap and rank[a] > rank[b] > -1}
        for o in here:
            out = o in hidden or not filled[o]
            if out:
                seen[o] = f
            if c.confirm is not None and o not in confirmed and o not in gone:
                unsure[f].add(o)
            states.append([f, o, match[o], misses[o], alive[o], streak[o], c.confirm is not None and o in confirmed, out, None, min(f + max(c.delay - 1, 0), last), filled[o]])
        removed |= {o: f for o in gone}
    for s in states:
        f, o = s[:2]
        s[8] = removed.get(o)
        faded = not c.suppress_only_when_new and s[3] > 0 and s[4] <= 0
        early = c.confirm is not None and o in unsure[min(f + c.confirm - 1, last)]
        s[10] = s[10] and not s[7] and not (s[8] is not None and s[8] <= s[9]) and not faded and not early
    return [tuple(s) for s in states], opened


def scene(rng, frames, objects):
    dets, tracks, k = [], [], 0
    for o in range(1, objects + 1):
        x, begin, end = rng.choice([0, 4, 8, 60]), rng.randrange(frames), frames
        for f in range(begin, end):
            if rng.random() < 0.1:
                continue
            x += rng.choice([-1, 0, 1])
            flat = rng.random() < 0.12
            tracks.append((f, o, (float(x), 0.0, float(x + 20), 0.0 if flat else 20.0), rng.random()))
    for f in range(frames):
        for _ in range(rng.randrange(4)):
            k += 1
            x = rng.choice([0, 3, 8, 62, 200]) + rng.randrange(4)
            dets.append((f, k, (float(x), 0.0, float(x + 20), 20.0), rng.random()))
    return dets, tracks


def as_rows(videos):
    dets = [(v, f, i, *b, s) for v, (ds, _) in videos.items() for f, i, b, s in ds]
    tracks = [(v, f, o, *b, s) for v, (_, ts) in videos.items() for f, o, b, s in ts]
    return dets, tracks


@pytest.mark.parametrize("config,span", [
    (TrackerConfig(delay=12, unmatched=4, duplicates=3, alive_start=2, alive_cap=4, suppress_only_when_new=False, confirm=2, overlap=0.5), 7),
    (TrackerConfig(delay=30, unmatched=9, duplicates=2, overlap=0.4), 4096)])
def test_states_and_opened_objects(spark, config, span):
    rng = random.Random(5)
    videos = {v: scene(rng, 34, 7) for v in range(8)}
    dets, tracks = as_rows(videos)
    dets.append((3, 40, None, None, None, None, None, None))  # an empty frame
    dets, tracks = spark.createDataFrame(dets, DETS), spark.createDataFrame(tracks, TRACKS)
    got = L.lifecycle_batch(dets, tracks, config, span)
    columns = ["frame_idx", "obj_id", "matched", "misses", "alive", "streak", "confirmed", "occluded", "removed_at", "emitted_at", "shown"]
    states, opened = got.states.collect(), got.opened.collect()
    some = lambda name: sum(bool(r[name]) for r in states)
    assert some("removed_at") and some("occluded") and some("shown")
    for v, (ds, ts) in videos.items():
        want, new = plain(ds, ts, config)
        key = lambda r: (r[0], r[1])
        assert sorted((tuple(r[c] for c in columns[:8]) + tuple(r[c] for c in columns[8:]) for r in states if r["video_id"] == v), key=key) == sorted(want, key=key), v
        assert sorted((r["frame_idx"], r["det_id"], r["obj_id"]) for r in opened if r["video_id"] == v) == sorted(new)


def test_capacity_and_boundary(spark):
    dets = spark.createDataFrame([(1, 0, i, x, 40.0, x + 10, 60.0, s) for i, x, s in [(1, 0.0, 0.9), (2, 40.0, 0.8), (3, 60.0, 0.95), (4, 80.0, 0.85)]], DETS)
    tracks = spark.createDataFrame([(1, 0, 7, 200.0, 0.0, 210.0, 10.0, 0.5)], TRACKS)
    config = TrackerConfig(most_objects=3, boundary=0.1, width=100.0, height=100.0)
    got = L.lifecycle_batch(dets, tracks, config).opened.select("det_id", "obj_id").collect()
    assert sorted(map(tuple, got)) == [(3, 8), (4, 9)]


def test_a_video_without_tracks_and_empty_tables(spark):
    dets = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 9.0, 9.0, 0.2), (1, 2, 2, 0.0, 0.0, 9.0, 9.0, 0.2)], DETS)
    none = spark.createDataFrame([], TRACKS)
    got = L.lifecycle_batch(dets, none, TrackerConfig())
    assert got.states.count() == 0 and sorted(map(tuple, got.opened.select("det_id", "obj_id").collect())) == [(1, 1), (2, 2)]
    assert L.lifecycle_batch(dets.limit(0), none, TrackerConfig()).opened.count() == 0


def test_clamped_counter_over_runs_of_runs(spark):
    rng = random.Random(9)
    rows = [(o, f * 3 - 50, rng.random() < 0.5, rng.random() < 0.55) for o in range(3) for f in range(400)]
    df = spark.createDataFrame(rows, "obj_id bigint, frame_idx bigint, matched boolean, missed boolean")
    got = {(r[0], r[1]): r[2] for r in L.clamped_counter(df, ["obj_id"], "frame_idx", 2, 5, -1, span=5).collect()}
    for o in range(3):
        x = 2
        for _, f, up, down in sorted(r for r in rows if r[0] == o):
            x = min(5, x + 1) if up else x
            x = max(-1, x - 1) if down else x
            assert got[o, f] == x


def test_one_long_video_is_many_tasks(spark):
    """Every shuffle of the histories has the block of frames in its key."""
    history = spark.createDataFrame([(1, 1, f, True, False) for f in range(3000)], "video_id bigint, obj_id bigint, frame_idx bigint, matched boolean, missed boolean")
    runs = L.clamped_counter(history, ["video_id", "obj_id"], "frame_idx", 30, 30, -1, span=64)
    assert runs.count() == 3000 and runs.select(F.max("alive")).first()[0] == 30
