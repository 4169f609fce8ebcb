"""Mask operators against dense-grid restatements."""

import math
import random

import numpy as np
import pytest

from visiontables.operators import components as C
from visiontables.operators import runs as R

SCHEMA = "k long, x long, ys long, ye long"


def grid_runs(k, g):
    h, w = g.shape
    out = []
    for x in range(w):
        y = 0
        while y < h:
            if g[y, x]:
                s = y
                while y < h and g[y, x]:
                    y += 1
                out.append((k, x, s, y))
            else:
                y += 1
    return out


def to_grid(rows, h, w):
    g = np.zeros((h, w), bool)
    for r in rows:
        g[r.ys:r.ye, r.x] = True
    return g


def flood(g):
    """Parts of a grid, corners included, as sets of pixels."""
    left = {(int(x), int(y)) for y, x in np.argwhere(g)}
    parts = []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    p = (x + dx, y + dy)
                    if p in left:
                        left.remove(p)
                        part.add(p)
                        todo.append(p)
        parts.append(part)
    return parts


def random_grids(n, h, w, seed, fill=0.55):
    rng = np.random.default_rng(seed)
    return [rng.random((h, w)) < fill for _ in range(n)]


@pytest.fixture(scope="module")
def grids():
    gs = random_grids(8, 9, 12, 3)
    ring = np.zeros((9, 12), bool)
    ring[2:7, 3:9] = True
    ring[4, 5] = False
    corner = np.zeros((9, 12), bool)
    corner[0, 0] = corner[1, 1] = corner[5, 5] = True
    return [*gs, ring, corner, np.ones((9, 12), bool)]


def run_table(spark, gs):
    return spark.createDataFrame([r for k, g in enumerate(gs) for r in grid_runs(k, g)], SCHEMA)


@pytest.mark.parametrize("local", [4096, 0])
def test_components(spark, grids, local):
    if local == 0:
        grids = grids[:2] + grids[-3:]
    got = C.label_components(run_table(spark, grids), ["k"], local).collect()
    for k, g in enumerate(grids):
        parts = {}
        for r in got:
            if r.k == k:
                parts.setdefault(r.label, set()).update((r.x, y) for y in range(r.ys, r.ye))
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, flood(g)))


def test_clean(spark, grids):
    h, w = grids[0].shape
    for most in (3, 40):
        got = C.clean_masks(run_table(spark, grids), ["k"], w, h, most).collect()
        for k, g in enumerate(grids):
            want = g.copy()
            for part in flood(~g):
                if len(part) <= most:
                    for x, y in part:
                        want[y, x] = True
            limit = min(most, int(want.sum()) // 2)
            for part in flood(want.copy()):
                if len(part) <= limit:
                    for x, y in part:
                        want[y, x] = False
            assert (to_grid([r for r in got if r.k == k], h, w) == want).all(), (k, most)


def test_clean_shuffles_packs(spark):
    # each mask is cleaned whole, so a mask's runs are shuffled as a pack, without windows or joins of runs
    runs = spark.createDataFrame([(k, x, ys, ye) for k in (1, 2, None) for x, ys, ye in ((3, 2, 9), (4, 2, 4), (4, 5, 9), (5, 2, 9), (9, 1, 2))], "k int, x bigint, ys bigint, ye bigint")
    got = C.clean_masks(runs, ["k"], 20, 12, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1, plan
    cleaned = [(3, 2, 9), (4, 2, 9), (5, 2, 9)]
    as_it_was = [(3, 2, 9), (4, 2, 4), (4, 5, 9), (5, 2, 9), (9, 1, 2)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, *r) for k in (1, 2) for r in cleaned] + [(None, *r) for r in as_it_was], key=str)


def test_clean_odd_masks_as_large(spark):
    # empty columns, runs outside the image and overlapping runs: whole in a task or by joins, the rows are the same
    rng = np.random.default_rng(3)
    rows = [(int(k), int(x), int(a), int(a + n)) for k in range(30) for x in rng.integers(-3, 24, 18) for a, n in [rng.integers(-2, 16, 2)]]
    runs = spark.createDataFrame(rows + [(99, 2, None, 3), (98, 30, 40, 41)], "k int, x bigint, ys bigint, ye bigint")
    for most in (2, 60):
        small, large = (C.clean_masks(runs, ["k"], 21, 17, most, n).collect() for n in (4096, 0))
        assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and small


def test_boxes_of_held_masks(spark):
    from pyspark.sql import functions as F

    from visiontables.operators import measure as M

    objects = spark.createDataFrame([(1, .5), (1, .95), (2, .95), (3, .2), (3, .2), (4, .1), (5, None), (None, .1)], "k int, score double")
    runs = spark.createDataFrame([(k, x, k, k + x) for k in (1, 2, 3, 5, 6) for x in (2, 3)] + [(None, 1, 1, 2), (4, 1, 5, 5)], "k int, x bigint, ys bigint, ye bigint")
    for conv, size in (("inclusive", {}), ("xywh", {}), ("exclusive", {}), ("inverted", {"w": F.lit(50).cast("bigint"), "h": F.lit(60).cast("bigint")})):
        got = M.mask_bbox(objects, runs, ["k"], conv, held=F.expr("score < 0.9"), **size)
        some = runs.join(objects.where("score < 0.9").select("k"), "k", "left_semi")
        want = M.mask_bbox(objects, some, ["k"], conv, **size)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.schema == want.schema
    # the runs are reduced to boxes before they meet the objects
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("Aggregate"), plan


def test_counts_round_trip(spark, grids):
    from pyspark.sql import functions as F

    h, w = grids[0].shape
    runs = run_table(spark, grids)
    counts = R.encode_counts(runs, ["k"], F.lit(h), F.lit(w))
    for r in counts.collect():
        assert sum(r.counts) == h * w
        flat = grids[r.k].T.reshape(-1)
        want, value, n = [], False, 0
        for v in flat:
            if v == value:
                n += 1
            else:
                want.append(n)
                value, n = v, 1
        want.append(n)
        assert list(r.counts) == want
    text = R.encode_coco_counts(counts).drop("counts")
    back = R.decode_runs(R.decode_coco_counts(text, "text"), ["k"], F.lit(h))
    assert sorted(map(tuple, back.select("k", "x", "ys", "ye").collect())) == sorted(map(tuple, runs.collect()))


def test_error_center(spark):
    gs = random_grids(6, 11, 13, 8, 0.75)
    other = random_grids(6, 11, 13, 9, 0.3)
    got = {r.k: r for r in C.error_center_points(run_table(spark, gs), run_table(spark, other), ["k"]).collect()}
    for k, (p, t) in enumerate(zip(gs, other)):
        def deepest(m):
            pad = np.pad(m, 1)
            outside = np.argwhere(~pad)
            best = (0, 0, 0)
            for y, x in np.argwhere(m):
                d = int(((outside - [y + 1, x + 1]) ** 2).sum(1).min())
                if d > best[0]:
                    best = (d, x, y)
            return best
        fp, fn = deepest(p & ~t), deepest(t & ~p)
        want = (*fn, 1) if fn[0] > fp[0] else (*fp, 0)
        assert (got[k].depth2, got[k].x, got[k].y, got[k].label) == want


def test_inclusive_boxes(spark):
    """Boxes of known masks in the inclusive convention."""
    from visiontables.operators.measure import mask_bbox

    boxes = [(127, 2, 165, 40), (2, 50, 44, 92), (56, 63, 98, 100), (139, 68, 175, 104)]
    runs = [(k, x, y1, y2 + 1) for k, (x1, y1, x2, y2) in enumerate(boxes) for x in range(x1, x2 + 1)]
    df = spark.createDataFrame(runs, SCHEMA)
    keys = spark.createDataFrame([(k,) for k in range(len(boxes) + 1)], "k long")
    got = {r.k: (r.x1, r.y1, r.x2, r.y2) for r in mask_bbox(keys, df, ["k"], "inclusive").collect()}
    assert got == {**dict(enumerate(boxes)), 4: (0, 0, 0, 0)}


def test_rotated_intersection():
    rng = random.Random(4)
    for _ in range(30):
        a = [rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(2, 8), rng.uniform(2, 8), rng.uniform(-90, 90)]
        b = [rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(2, 8), rng.uniform(2, 8), rng.choice([a[4], rng.uniform(-90, 90)])]
        n, hits = 400, 0
        t, u = math.radians(a[4]), math.radians(b[4])
        g = (np.arange(n) + 0.5) / n - 0.5
        lx, ly = np.meshgrid(g * a[2], g * a[3])
        px = a[0] + lx * math.cos(t) - ly * math.sin(t) - b[0]
        py = a[1] + lx * math.sin(t) + ly * math.cos(t) - b[1]
        qx, qy = px * math.cos(u) + py * math.sin(u), -px * math.sin(u) + py * math.cos(u)
        hits = ((np.abs(qx) <= b[2] / 2) & (np.abs(qy) <= b[3] / 2)).mean() * a[2] * a[3]
        assert C.rotated_intersection(np.array([a]), np.array([b]))[0] == pytest.approx(hits, abs=0.15)
    same = np.array([[3.0, 4.0, 5.0, 2.0, 30.0]])
    assert C.rotated_intersection(same, same)[0] == pytest.approx(10.0)


def test_min_area_rect():
    t = math.radians(30)
    pts = np.array([(10 + u * math.cos(t) - v * math.sin(t), 20 + u * math.sin(t) + v * math.cos(t)) for u in (-8, 8, 0) for v in (-3, 3, 1)])
    cx, cy, w, h, angle = C.min_area_rect(pts)
    assert (cx, cy) == (pytest.approx(10), pytest.approx(20))
    assert sorted((w, h)) == [pytest.approx(6), pytest.approx(16)]


def test_random_points_lie_in_errors(spark):
    gs, other = random_grids(3, 7, 8, 1), random_grids(3, 7, 8, 2)
    other[2] = gs[2].copy()
    for seed in (1, 2):
        got = {r.k: r for r in C.error_random_points(run_table(spark, gs), run_table(spark, other), ["k"], seed, 8, 7).collect()}
        for k, (p, t) in enumerate(zip(gs, other)):
            r = got[k]
            if k == 2:
                assert not t[r.y, r.x] and r.label == 0
            else:
                assert p[r.y, r.x] != t[r.y, r.x] and r.label == int(t[r.y, r.x])


def test_jitter_bounds(spark):
    from visiontables.functions.boxes import jitter_boxes

    rows = [(i, 10.0, 10.0, 10.0 + i * 20, 60.0, 400, 100) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "i long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    a = {r.i: r for r in jitter_boxes(df, ["i"], 3).collect()}
    assert a == {r.i: r for r in jitter_boxes(df.repartition(3), ["i"], 3).collect()}
    for i, x1, y1, x2, y2, _, _ in rows:
        most = min((x2 - x1) * 0.1, 20.0)
        assert abs(a[i].x1 - x1) <= most and abs(a[i].x2 - x2) <= most and abs(a[i].y1 - y1) <= 5.0 and a[i].y2 != y2


@pytest.mark.parametrize("seed", range(5))
def test_labels_of_many_masks_at_once(seed):
    """Against merging touching runs one by one."""
    import random

    from visiontables.operators.components import _SHIFT, _labels_of

    rng = random.Random(seed)
    masks = []
    for _ in range(30):
        rows = []
        for x in rng.sample(range(15), rng.randrange(0, 12)):
            at = rng.randrange(4)
            while at < 30:
                rows.append((x, at, at + rng.randrange(1, 6)))
                at = rows[-1][2] + rng.randrange(1, 6)
        masks.append(sorted(rows))
    want = []
    for rows in masks:
        label = list(range(len(rows)))
        for i, (x, a, b) in enumerate(rows):
            for j, (y, c, d) in enumerate(rows[:i]):
                if y == x - 1 and c <= b and a <= d and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if k == high else k for k in label]
        want.append([rows[k][0] * _SHIFT + rows[k][1] for k in label])
    got = _labels_of([tuple(np.array([r[k] for r in rows], np.int64) for k in range(3)) for rows in masks])
    assert [g.tolist() for g in got] == want
