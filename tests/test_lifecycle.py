"""The object lifecycle: hand-made videos, and stream against batch."""

import os

from pyspark.sql import functions as F

from visiontables.streaming.lifecycle import TrackerConfig, VideoTracker, bidirectional, frame_stream, track_batch, track_stream, use_rocksdb


def box(i, x, score=0.9, y=0.0, w=10.0):
    return (i, x, y, x + w, y + 10.0, score)


def play(frames, config):
    t = VideoTracker(config)
    out = []
    for f, dets in enumerate(frames):
        rows = [(f, *d) for d in dets] or [(f, None, None, None, None, None, None)]
        out += t.feed(rows)
        t = VideoTracker(config, t.dump())
    return out + t.finish()


def seen(out):
    return sorted({(r[0], r[1]) for r in out})


def test_new_object_and_ids():
    out = play([[box(1, 0)], [box(2, 1), box(3, 50)], [box(4, 2), box(5, 51)]], TrackerConfig(delay=2))
    assert seen(out) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_low_score_opens_only_without_tracks():
    out = play([[box(1, 0, 0.3)], [box(2, 0, 0.3), box(3, 50, 0.3)]], TrackerConfig(delay=1))
    assert seen(out) == [(0, 1), (1, 1)]


def test_unmatched_new_object_is_hidden_from_held_frames():
    c = TrackerConfig(delay=5, unmatched=3)
    frames = [[box(1, 0), box(2, 50)]] + [[box(10 + f, 0)] for f in range(1, 8)]
    assert {i for _, i in seen(play(frames, c))} == {1}
    # one miss fewer than the threshold, then matched again: it stays
    frames = [[box(1, 0), box(2, 50)], [box(3, 0)], [box(4, 0)], *[[box(10 + f, 0), box(20 + f, 50)] for f in range(4)]]
    assert {i for _, i in seen(play(frames, c))} == {1, 2}


def test_misses_are_never_reset():
    c = TrackerConfig(delay=20, unmatched=3)
    frames = [[box(1, 0), box(2, 50)]] + [[box(10 + f, 0)] + ([box(30 + f, 50)] if f % 2 else []) for f in range(1, 7)]
    assert {i for _, i in seen(play(frames, c))} == {1}


def test_removal_after_frames_left_the_buffer():
    # outside the early period nothing is removed
    frames = [[box(1, 0), box(2, 50)]] + [[box(10 + f, 0), box(40 + f, 50)] for f in range(1, 6)] + [[box(60 + f, 0)] for f in range(6, 12)]
    assert {i for _, i in seen(play(frames, TrackerConfig(delay=3, unmatched=3)))} == {1, 2}


def test_duplicate_pair():
    c = TrackerConfig(delay=20, duplicates=3)
    # two objects drift onto one detection
    frames = [[box(1, 0, w=20.0), box(2, 30, w=20.0)]] + [[box(10 + f, 15, w=20.0)] for f in range(1, 8)]
    assert {i for _, i in seen(play(frames, c))} == {1}


def test_short_video_flushes_all():
    out = play([[box(1, 0)], [box(2, 0)]], TrackerConfig(delay=15))
    assert seen(out) == [(0, 1), (1, 1)]


def test_confirmation_looks_ahead():
    c = TrackerConfig(delay=5, confirm=3)
    frames = [[box(f, 0)] for f in range(2)] + [[]] + [[box(10 + f, 0)] for f in range(4)]
    out = seen(play(frames, c))
    # the first two matches do not reach three in a row; frames 3.. do
    assert (0, 1) not in out and (3, 1) in out


def test_late_rows_are_counted():
    t = VideoTracker(TrackerConfig(delay=1))
    t.feed([(0, *box(1, 0)), (1, *box(2, 0)), (2, *box(3, 0))])
    t.feed([(0, *box(9, 90))])
    assert t.late == 1 and all(tr.obj_id == 1 for tr in t.tracks)


def test_stream_equals_batch(spark, tmp_path):
    from visiontables.fixtures import Tables

    obs = Tables(spark, "/root/testdata/sf0.001").track_obs().withColumn("end_of_video", F.lit(False))
    ends = obs.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("frame_idx")).withColumn("end_of_video", F.lit(True))
    rows = obs.unionByName(ends, allowMissingColumns=True)
    config = TrackerConfig(delay=4, confirm=2)
    want = sorted(map(tuple, track_batch(obs, config).collect()))
    folder = str(tmp_path / "in")
    for part in range(4):
        # frames arrive in order, cut in the middle of a frame's rows
        lo, hi = part * 27, part * 27 + 27
        cut = rows.where(f"frame_idx * 4 + coalesce(slot, 0) >= {lo * 4 - 2} and frame_idx * 4 + coalesce(slot, 0) < {hi * 4 - 2 if part < 3 else 10**9}")
        cut.coalesce(1).write.parquet(os.path.join(folder, f"p{part}"))
    use_rocksdb(spark)
    schema = rows.schema
    stream = frame_stream(spark, folder, schema, files_per_batch=1)
    q = (track_stream(stream, config).writeStream.format("memory").queryName("tracked").outputMode("update")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("select * from tracked")
    assert got.where("late").count() == 0
    got = sorted(map(tuple, got.drop("late").collect()))
    assert got == want and len(got) > 100


_ROWS = "video_id bigint, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double, end_of_video boolean"


def run_stream(spark, tmp_path, name, parts, config, until, **options):
    """Rows out of a stream that runs on until ``until(rows)``, its input arriving part by part."""
    import time

    folder = str(tmp_path / "in")
    os.makedirs(folder)
    use_rocksdb(spark)
    q = (track_stream(frame_stream(spark, folder, _ROWS, 1), config, **options).writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start())
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, _ROWS).coalesce(1).write.parquet(os.path.join(folder, f"p{k}"))
            q.processAllAvailable() if not options else time.sleep(3)
        for _ in range(200):
            got = spark.sql(f"select * from {name}").collect()
            if until(got):
                return got
            time.sleep(0.3)
        raise AssertionError(got)
    finally:
        q.stop()


def test_late_rows_come_out_marked(spark, tmp_path):
    at = lambda f, i, x: (1, f, i, x, 0.0, x + 10, 10.0, 0.9, False)
    parts = [[at(0, 1, 0.0), at(1, 2, 1.0)], [at(2, 3, 2.0)], [at(0, 9, 90.0), at(3, 4, 3.0)], [(1, 4, None, None, None, None, None, None, True)]]
    got = run_stream(spark, tmp_path, "late_rows", parts, TrackerConfig(delay=2), lambda rows: sum(not r["late"] for r in rows) == 4)
    assert [(r["frame_idx"], r["obj_id"], r["x1"], r["prob"]) for r in got if r["late"]] == [(0, None, 90.0, 0.9)]
    assert sorted((r["frame_idx"], r["obj_id"]) for r in got if not r["late"]) == [(f, 1) for f in range(4)]


def test_an_idle_video_is_closed_by_its_timer(spark, tmp_path):
    at = lambda v, f, i: (v, f, i, float(f), 0.0, f + 10.0, 10.0, 0.9, False)
    parts = [[at(1, 0, 1), at(1, 1, 2), at(1, 2, 3)]]
    got = run_stream(spark, tmp_path, "idle_videos", parts, TrackerConfig(delay=15), lambda rows: len(rows) >= 3, idle=1500)
    assert sorted((r["frame_idx"], r["obj_id"]) for r in got) == [(0, 1), (1, 1), (2, 1)]


def test_state_not_written_for_long_goes(spark, tmp_path):
    at = lambda f, i: (1, f, i, 0.0, 0.0, 10.0, 10.0, 0.9, False)
    end = (1, 9, None, None, None, None, None, None, True)
    # by the time the end comes, the entries of the first frames have gone: nothing is left to show
    parts = [[at(0, 1), at(1, 2)], [at(5, 3), at(6, 4)], [end]]
    got = run_stream(spark, tmp_path, "ttl", parts, TrackerConfig(delay=15), lambda rows: True, ttl=1000)
    assert {r["frame_idx"] for r in got} <= {5, 6}


def test_a_micro_batch_writes_what_it_changes():
    from visiontables.streaming.lifecycle import _Kept

    class Store(dict):
        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self.written = [*getattr(self, "written", []), key]
            self[key] = value

        containsKey = dict.__contains__

        def removeKey(self, key):
            del self[key]

    store = Store({(1,): ("a",), (2,): ("b",), (3,): ("c",)})
    kept = _Kept(store, lambda v: v[0], lambda v: (v,))
    assert list(kept) == [1, 2, 3] and kept[1] == "a" and 9 not in kept and kept.get(9) is None
    kept[2] = "x"
    kept[4] = "new"
    del kept[3]
    del kept[4]
    assert kept.flush() == 3 and store == {(1,): ("a",), (2,): ("x",)} and store.written == [(2,)]


def test_an_empty_last_frame_shows_what_is_carried():
    out = play([[box(1, 0)], [], [box(2, 1)], []], TrackerConfig(delay=2))
    assert seen(out) == [(f, 1) for f in range(4)]


def test_frames_are_those_with_rows():
    t = VideoTracker(TrackerConfig(delay=0))
    out = t.feed([(0, *box(1, 0)), (10**9, *box(2, 1))]) + t.finish()
    assert seen(out) == [(0, 1), (10**9, 1)]


def test_no_limit_on_objects():
    many = [box(i, 20.0 * i) for i in range(10_050)]
    assert len(play([many], TrackerConfig(delay=0))) == 10_050
    assert len(play([many], TrackerConfig(delay=0, most_objects=7))) == 7


def test_passes_share_ids(spark):
    rows = [(1, f, 10 * f + k, *box(0, 50.0 * k + f)[1:5], 0.9) for f in range(5) for k in range(2)]
    rows += [(1, f, 10 * f + 5, 300.0, 0.0, 310.0, 10.0, 0.9) for f in (0, 1)] + [(1, 4, 45, 400.0, 0.0, 410.0, 10.0, 0.9)]
    dets = spark.createDataFrame(rows, "video_id long, frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double, score double")
    starts = spark.createDataFrame([(1, 2)], "video_id long, start long")
    out = bidirectional(dets, starts, TrackerConfig(delay=1)).collect()
    ids = {(r.frame_idx, r.obj_id) for r in out}
    assert {i for f, i in ids if i in (1, 2)} == {1, 2} and all({(f, 1), (f, 2)} <= ids for f in range(5))
    assert {i for f, i in ids if f < 2} - {1, 2} == {-3} and {i for f, i in ids if f >= 2} - {1, 2} == {3}
