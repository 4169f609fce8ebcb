"""One-to-one assignments against enumeration."""

import itertools
import random

import numpy as np
import pytest

from visiontables.operators import assignment as A

PAIRS = "video_id bigint, frame_idx bigint, det_id bigint, obj_id bigint, iou double"


def best(gain):
    n, m = gain.shape
    return max(sum(gain[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("seed", range(40))
def test_largest_total(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 6)
    gain = np.round(rng.random((n, n + rng.integers(0, 3))) * (rng.random((n, 1)) < 0.9), rng.integers(1, 4))
    columns = A.best_assignment(gain)
    assert len(set(columns.tolist())) == n and gain[np.arange(n), columns].sum() == pytest.approx(best(gain))


def test_a_large_assignment_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    gain = rng.random((200, 230))
    columns = A.best_assignment(gain)
    left, greedy = gain.copy(), 0.0
    for _ in range(200):
        i, j = np.unravel_index(np.argmax(left), left.shape)
        greedy, left[i, :], left[:, j] = greedy + left[i, j], -1, -1
    assert sorted(set(columns.tolist())) == sorted(columns.tolist()) and gain[np.arange(200), columns].sum() >= greedy


def test_pairs_of_each_frame(spark):
    rng = random.Random(4)
    rows = [(v, f, 100 * f + d, o, round(rng.random(), 2)) for v in range(3) for f in range(6) for d in range(4) for o in range(5) if rng.random() < 0.4]
    rows += [(9, 0, d, d + k, 0.5 + 0.001 * k) for d in range(40) for k in (0, 1)]  # one long chain
    rows += [(9, 1, 1, 1, 0.0)]
    got = A.assign_one_to_one(spark.createDataFrame(rows, PAIRS)).collect()
    for v, f in {(r[0], r[1]) for r in rows} - {(9, 0), (9, 1)}:
        given = {(r[2], r[3]): r[4] for r in rows if r[:2] == (v, f)}
        mine = [r for r in got if (r["video_id"], r["frame_idx"]) == (v, f)]
        assert all(given[r["det_id"], r["obj_id"]] == r["iou"] for r in mine)
        assert len({r["det_id"] for r in mine}) == len({r["obj_id"] for r in mine}) == len(mine)
        dets, objs = sorted({d for d, _ in given}), sorted({o for _, o in given})
        gain = np.array([[given.get((d, o), 0.0) for o in objs] for d in dets])
        assert sum(r["iou"] for r in mine) == pytest.approx(best(gain if len(dets) <= len(objs) else gain.T))
    chain = [r for r in got if (r["video_id"], r["frame_idx"]) == (9, 0)]
    assert len(chain) == 40 and sum(r["iou"] for r in chain) == pytest.approx(40 * 0.501)
    assert not [r for r in got if (r["video_id"], r["frame_idx"]) == (9, 1)]


def test_parts_of_a_frame(spark):
    rows = [(1, 0, d, d + k, 0.5) for d in (1, 2, 3, 10, 11) for k in (0, 1)] + [(1, 1, 1, 3, 0.5), (2, 0, 1, 3, 0.5)]
    parts = {}
    for r in A.overlap_parts(spark.createDataFrame(rows, PAIRS)).collect():
        parts.setdefault((r["video_id"], r["frame_idx"], r["part"]), set()).add(r["obj_id"])
    assert sorted((k[:2], sorted(v)) for k, v in parts.items()) == [((1, 0), [1, 2, 3, 4]), ((1, 0), [10, 11, 12]), ((1, 1), [3]), ((2, 0), [3])]


def test_what_every_detection_and_track_is(spark):
    dets = spark.createDataFrame([(1, 0, 1, 0.9), (1, 0, 2, 0.9), (1, 0, 3, 0.2), (1, 1, 4, 0.1)], "video_id bigint, frame_idx bigint, det_id bigint, score double")
    tracks = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (1, 2, 7)], "video_id bigint, frame_idx bigint, obj_id bigint")
    pairs = spark.createDataFrame([(1, 0, 1, 7, 0.9), (1, 0, 1, 8, 0.95)], PAIRS)
    got = sorted(tuple(r) for r in A.associate_one_to_one(dets, tracks, pairs).select("frame_idx", "kind", "det_id", "obj_id").na.fill(-1).collect())
    # the shared detection goes to one of the two; a frame without detections leaves none unmatched
    assert got == [(0, "matched", 1, 8), (0, "new", 2, -1), (0, "unmatched", -1, 7), (1, "new", 4, -1)]


def test_references_that_name_no_row(spark):
    from visiontables.operators.select import unknown_references

    dets = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "image_id bigint, det_id bigint")
    refs = spark.createDataFrame([(1, 2), (1, 5), (1, 5), (3, 1), (2, 1), (2, None)], "image_id bigint, det_id bigint")
    got = unknown_references(dets, refs).collect()
    assert {(r["image_id"], r["det_id"], r["rows"]) for r in got} == {(1, 5, 2), (3, 1, 0), (2, None, 1)} and all("reference" in r["error"] for r in got)
