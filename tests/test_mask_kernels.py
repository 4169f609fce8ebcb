"""Masks in bulk: unions, polygons, texts, oriented boxes, centre points and colours from packs."""

import random

import numpy as np
import pytest

from tests.test_shapes import grid_runs, random_grids, run_table, to_grid
from visiontables.operators import components as C
from visiontables.operators import measure as M
from visiontables.operators import runs as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_union_of_strewn_runs(spark):
    """Runs of few keys in any order, over several batches and stripes, unite without a window."""
    rng = random.Random(5)
    rows = [(rng.choice([1, None]), rng.choice([2, 1023, 1024, 3000]), y, y + rng.randint(0, 4)) for y in (rng.randint(-5, 90) for _ in range(400))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        u = R.mask_union(spark.createDataFrame(rows, "k long, x long, ys long, ye long"), ["k"])
        assert "Window" not in plan(u)
        got = [tuple(r) for r in u.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pixels = sorted((k or 0, x, y) for k, x, a, b in got for y in range(a, b))
    assert pixels == sorted({(k or 0, x, y) for k, x, a, b in rows for y in range(a, b)})
    assert len(got) == sum((k, x, y - 1) not in set(pixels) for k, x, y in pixels)


def test_polygons_of_one_mask_share_the_even_odd_rule(spark):
    """A part inside another of the same key is a hole; no row is shuffled per crossing."""
    box = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    rows = [(1, box(0.0, 8.0)), (1, box(2.0, 5.0)), (2, box(1.0, 3.0)), (3, None), (4, []), (5, [{"x": None, "y": 1.0}] * 3)]
    p = spark.createDataFrame(rows, "k long, points array<struct<x:double,y:double>>")
    r = R.rasterize_polygons(p, ["k"])
    assert "Window" not in plan(r)
    got = r.collect()
    one = np.ones((8, 8), bool)
    one[2:5, 2:5] = False
    assert (to_grid([v for v in got if v.k == 1], 8, 8) == one).all()
    assert sorted((v.x, v.ys, v.ye) for v in got if v.k == 2) == [(1, 1, 3), (2, 1, 3)]
    assert {v.k for v in got} == {1, 2}


def test_texts_of_many_masks():
    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 15, 16, 31, 32, 1000, 10**9, 1 << 40]) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    texts = R.encode_texts(np.array([v for one in lists for v in one]), np.array([len(one) for one in lists]))
    assert [R._decode_text(t) for t in texts] == lists
    # unended lengths are none, over-long ones go one by one
    texts += ["", "P", "0P", "é0", "".join(chr(rng.randint(40, 120)) for _ in range(50))]
    assert [list(v) for v in R._decode_texts(texts)] == [R._decode_text(t) for t in texts]
    assert R._decode_texts([]) == [] and list(R._decode_texts(["", ""])[1]) == []


def test_texts_are_read_once(spark):
    """A filter on decoded lengths reads no text ahead of the join it follows."""
    masks = spark.createDataFrame([(1, "0a1")], "k long, counts string")
    sizes = spark.createDataFrame([(1, 4)], "k long, h long")
    d = R.decode_runs(R.decode_coco_counts(masks.join(sizes, "k"), "counts", "n"), ["k"], sizes.h, counts="n")
    assert plan(d).count("ArrowEvalPython") == 1


def test_rectangles_of_many_masks():
    rng = np.random.default_rng(5)
    columns, want = [], []
    for m in range(300):
        n = rng.integers(1, 9)
        x = np.sort(rng.choice(15, n, replace=False))
        lo = rng.integers(0, 9, n)
        hi = lo + rng.integers(0, 9, n)
        columns.append((np.full(n, m), x, lo, hi))
        want.append(C.min_area_rect(np.concatenate([np.stack([x, lo], 1), np.stack([x, hi], 1)])))
    got = C._rects_of(*[np.concatenate(c) for c in zip(*columns)], len(want))
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("band", [1 << 20, 7])
def test_center_points_in_bands(spark, band):
    """Both masks of a key meet as packs; no row is made per pixel."""
    gs, other = random_grids(4, 11, 13, 8, 0.7), random_grids(4, 11, 13, 9, 0.4)
    other[3] = gs[3]
    other[2][:] = False
    e = C.error_center_points(run_table(spark, gs), run_table(spark, other), ["k"], band)
    assert "Generate" not in plan(e)
    got = {r.k: (r.depth2, r.y, r.x, r.label) for r in e.collect()}
    for k, (p, t) in enumerate(zip(gs, other)):
        best = []
        for label, wrong in ((0, p & ~t), (1, t & ~p)):
            framed = np.pad(wrong, 1)
            out = np.argwhere(~framed) - 1
            best.append(max([(min(((out - at) ** 2).sum(1)), -at[0], -at[1], label) for at in np.argwhere(wrong)], default=(0, 0, 0, label)))
        d, y, x, label = best[1] if best[1][0] > best[0][0] else best[0]
        assert got[k] == (d, -y, -x, label)


@pytest.mark.parametrize("top", [255, 1 << 40])
def test_mean_colors_from_packs(spark, top):
    """Strewn pixels, over several stripes and of any depth, meet masks without running sums over shuffled rows."""
    rng = random.Random(9)
    pixels = [(i, x, y, *[rng.randint(-3 if top > 255 else 0, top) for _ in "rgb"]) for i in (1, 2) for x in (0, 1, 63, 64, 130) for y in range(9)]
    rng.shuffle(pixels)
    runs = [(rng.choice([1, 2, 3]), rng.randint(0, 4), rng.choice([0, 1, 63, 64, 130, 131]), y, y + rng.randint(0, 5)) for y in (rng.randint(-1, 8) for _ in range(60))]
    p = spark.createDataFrame([*pixels, (1, None, 2, 9, 9, 9)], "image_id long, x long, y long, r long, g long, b long")
    r = spark.createDataFrame(runs, "image_id long, det_id long, x long, ys long, ye long")
    objects = [(i, d) for i in (1, 2, 3, 4) for d in range(5)]
    m = M.mean_color(spark.createDataFrame(objects, "image_id long, det_id long"), r, p, ["image_id", "det_id"])
    assert "Window" not in plan(m)
    want = {}
    for i, d in objects:
        under = [q[3:] for j, e, x, a, b in runs if (i, d) == (j, e) for q in pixels if q[:2] == (i, x) and a <= q[2] < b]
        want[i, d] = tuple(int(sum(c) / len(under) // 1) for c in zip(*under)) if under else (0, 0, 0)
    assert {tuple(v[:2]): tuple(v[2:]) for v in m.collect()} == want


def test_center_points_without_any_run(spark):
    """Keys whose runs have no place, and null keys, click on the first pixel."""
    rows = [(1, 3, None, 4), (2, 3, 5, 5), (None, 3, 1, 4)]
    runs = spark.createDataFrame(rows, "k long, x long, ys long, ye long")
    assert sorted(map(str, C.error_center_points(runs, runs, ["k"]).collect())) == sorted(
        f"Row(k={k}, x=0, y=0, label=0, depth2=0)" for k in (1, 2, None))


def test_labels_without_a_place(spark):
    """A run without a place belongs to no part, and joins none."""
    runs = spark.createDataFrame([(1, 3, 1, 4), (2, 4, None, None), (2, 5, None, 2), (3, 9, 0, 2)], "k long, x long, ys long, ye long")
    assert sorted((r.k, r.label) for r in C.label_components(runs, ["k"]).collect()) == [(1, (3 << 31) + 1), (3, 9 << 31)]
