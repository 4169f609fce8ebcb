"""Boxes of a key compared whole in their task, against the ways that hold for any key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiontables.fixtures import Tables
from visiontables.operators import assignment as A
from visiontables.operators import components as C
from visiontables.operators import nms as N
from visiontables.operators import overlap as O

BOXES = "image_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
FIELDS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"


def boxes(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for image in (1, 2, None):
        for i in range(n):
            x, y = rng.randrange(0, 50), rng.randrange(0, 50)
            rows.append((image, i, rng.randrange(0, 9) / 9, float(x), float(y), float(x + rng.randrange(0, 25)), float(y + rng.randrange(1, 25))))
    return [*rows, rows[3], rows[3], (1, 900, 0.5, None, 1.0, 9.0, 9.0), (1, 901, None, 1.0, 1.0, 9.0, 9.0)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_boxes_are_those_of_the_cells(spark, monkeypatch):
    a, b = spark.createDataFrame(boxes(1), BOXES), spark.createDataFrame(boxes(2), BOXES)
    run = lambda: [sorted(O.iou_join(*x).collect()) for x in (
        (a, a, 0.3, ["image_id"], "det_id", "det_id", False, True), (a, b, 0.4, ["image_id"], "det_id", "det_id", True, False, ["score"]))]
    whole = run()
    _, physical = plan(O.iou_join(a, a, 0.3, ["image_id"], "det_id", "det_id", once=True))
    assert physical.count("Exchange") == 1 and "Join" not in physical
    monkeypatch.setattr(O, "MEET_ROWS", 20)
    assert whole == run() and all(whole)


def test_boxes_that_are_not_finite_meet_as_before(spark, monkeypatch):
    rows = [(1, 1, 0.9, 0.0, 0.0, 4.0, 4.0), (1, 2, 0.8, 0.0, 0.0, 4.0, 4.0), (1, 3, 0.7, 0.0, 0.0, float("nan"), 4.0)]
    d = spark.createDataFrame(rows, BOXES)
    # NaN counts as above every threshold
    assert {r.det_id for r in N.nms(d, ["image_id"], 0.5).collect()} == {1}


def test_rotated_pairs_are_those_of_the_cells(spark, monkeypatch):
    d = spark.createDataFrame(boxes(3, 30), BOXES).selectExpr(
        "image_id", "det_id", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy", "x2 - x1 as w", "y2 - y1 as h", "cast(det_id % 181 as double) as angle")
    e = d.where("det_id % 3 = 0")
    run = lambda: [sorted((*r[:3], round(r[3], 9)) for r in df.collect()) for df in (
        C.rotated_iou_join(d, d, ["image_id"], "det_id", "det_id", 16.0, 0.1, True), C.rotated_iou_join(d, e, ["image_id"], "det_id", "det_id", 16.0))]
    whole = run()
    _, physical = plan(C.rotated_iou_join(d, d, ["image_id"], "det_id", "det_id", 16.0, 0.1, True))
    assert physical.count("Exchange") == 1 and "Join" not in physical
    monkeypatch.setattr(O, "MEET_ROWS", 10)
    assert whole == run() and all(whole)


def test_greedy_passes_take_one_shuffle(spark):
    d = spark.createDataFrame(boxes(4), BOXES)
    for df in (N.nms(d, ["image_id"], 0.5), N.leader_cluster(d, ["image_id"])):
        _, physical = plan(df)
        assert physical.count("Exchange") == 1 and "Join" not in physical and "collect_list" not in physical


def test_rows_of_one_id_get_each_others_leaders(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 5, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 5, 0.9, 90.0, 90.0, 99.0, 99.0)]
    got = sorted((r.det_id, r.x1, r.leader) for r in N.leader_cluster(spark.createDataFrame(rows, BOXES), ["image_id"]).collect())
    assert got == [(1, 0.0, 1), (5, 0.0, 1), (5, 0.0, 5), (5, 90.0, 1), (5, 90.0, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_many_small_assignments_are_the_best_ones(seed):
    rng = np.random.default_rng(seed)
    for n, m in ((1, 3), (2, 2), (3, 4), (4, 4), (4, 7)):
        gain = np.round(rng.random((50, n, m)) * (rng.random((50, n, m)) < 0.6), 1)
        for g, columns in zip(gain, A._best_of_shape(gain)):
            want = A.best_assignment(g)
            assert g[np.arange(n), columns].sum() == pytest.approx(g[np.arange(n), want].sum()) and len(set(columns.tolist())) == n


def test_frames_are_assigned_alike_whole_and_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(v, f, 100 * f + d, o, rng.random()) for v in range(3) for f in range(8) for d in range(6) for o in range(5) if rng.random() < 0.4]
    d = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, det_id bigint, obj_id bigint, iou double")
    whole = A.assign_one_to_one(d)
    assert "FlatMapGroups" not in plan(whole)[1]
    monkeypatch.setattr(A, "FRAME_PAIRS", 5)
    assert sorted(whole.collect()) == sorted(A.assign_one_to_one(d).collect())


def test_corners_are_not_worked_out_to_filter_at_the_scan(spark, tmp_path):
    from visiontables.catalog import QUERIES

    rows = [(16 * i, 1, i, i + 1, 3.0 + i, 10.0) for i in range(6)]
    spark.createDataFrame(rows, FIELDS).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES["obb_polygons"](spark, str(tmp_path))
    assert not [line for line in plan(df)[0].split("\n") if "Filter" in line and "md5" in line]
    assert df.count() == 24


def test_the_stream_hands_out_many_frames_at_once():
    from visiontables.streaming import lifecycle as S

    rows = lambda f: [(f, 1, 0.0, 0.0, 1.0, 1.0, 0.5, 0.5, True)] * 3
    tables = list(S._stream_out(7, (rows(f) for f in range(100))))
    assert [len(t) for t in tables] == [300] and tables[0]["frame_idx"].tolist() == [f for f in range(100) for _ in range(3)]


def test_entries_that_come_and_go_never_reach_the_state():
    from visiontables.streaming import lifecycle as S

    class State(dict):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    state = State({(1,): ("a",), (2,): ("b",)})
    state.getValue = state.__getitem__
    kept = S._Kept(state, lambda v: v[0], lambda v: (v,))
    for k in range(10, 110):
        kept[k] = "x"
        del kept[k]
    del kept[1]
    kept[3] = "c"
    kept.flush()
    assert state == {(2,): ("b",), (3,): ("c",)} and state.calls == 2
