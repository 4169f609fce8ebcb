"""Greedy de-duplication and clustering against plain Python restatements."""

import random

import pytest

from visiontables.operators import nms as N


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def greedy(rows, hit):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(hit(iou(k[4:8], r[4:8])) for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def random_rows(seed, n, copies):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([2, 8, 8, 16, 32, 64])
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        w, h = max(1, size - rng.randrange(0, size)), max(1, size - rng.randrange(0, size))
        rows.append([1, i, "p", rng.randrange(0, 20) / 20, float(x), float(y), float(x + w), float(y + h)])
    for i in range(copies):
        rows.append([1, n + i, "p", rng.randrange(0, 20) / 20, *rows[0][4:]])
    rows.append([1, n + copies, "p", 0.5, 5.0, 5.0, 5.0, 9.0])
    rows.append([1, n + copies + 1, "p", 0.5, 5.0, 5.0, 5.0, 9.0])
    return [tuple(r) for r in rows]


SCHEMA = "image_id long, det_id long, prompt string, score double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("threshold,strict", [(0.5, False), (0.5, True), (0.3, False), (0.8, False)])
def test_rounds_equal_fold_equal_greedy(spark, threshold, strict):
    rows = random_rows(int(threshold * 100) + strict, 60, 25)
    df = spark.createDataFrame(rows, SCHEMA)
    want = greedy(rows, (lambda v: v > threshold) if strict else (lambda v: v >= threshold))
    for limit in (20, 512):
        got = {r.det_id for r in N.nms(df, ["image_id"], threshold, strict=strict, fold_limit=limit).collect()}
        assert got == want, limit


def test_threshold_is_met_exactly(spark):
    # two boxes with IoU of exactly one half
    rows = [(1, 1, "p", 0.9, 0.0, 0.0, 2.0, 2.0), (1, 2, "p", 0.8, 0.0, 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (0, 512):
        assert N.nms(df, ["image_id"], 0.5, fold_limit=limit).count() == 1
        assert N.nms(df, ["image_id"], 0.5, strict=True, fold_limit=limit).count() == 2


def test_suppressed_row_does_not_suppress(spark):
    # A beats B, B would beat C, A and C do not meet: C survives
    rows = [(1, 1, "p", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "p", 0.8, 3.0, 0.0, 13.0, 10.0), (1, 3, "p", 0.7, 6.0, 0.0, 16.0, 10.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (0, 512):
        got = {r.det_id for r in N.nms(df, ["image_id"], 0.5, fold_limit=limit).collect()}
        assert got == {1, 3}


def mask_of(r):
    return {(x, y) for x in range(int(r[4]), int(r[6])) for y in range(int(r[5]) + x % 2, int(r[7]))}


@pytest.mark.parametrize("fallback", [True, False])
def test_mask_nms(spark, fallback):
    rows = random_rows(5, 30, 6)
    masks = {r[1]: mask_of(r) for r in rows if r[1] % 4 != 0 or not fallback}
    masks = {k: m for k, m in masks.items() if m}
    runs = [(1, k, x, y, y + 1) for k, m in masks.items() for x, y in m]
    df = spark.createDataFrame(rows, SCHEMA)
    rd = spark.createDataFrame(runs, "image_id long, det_id long, x long, ys long, ye long")

    def overlap(a, b):
        if a[1] in masks and b[1] in masks:
            p, q = masks[a[1]], masks[b[1]]
            return len(p & q) / len(p | q)
        return iou(a[4:8], b[4:8]) if fallback else 0.0

    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(overlap(k, r) < 0.4 for k in kept):
            kept.append(r)
    want = {r[1] for r in kept}
    for limit in (512, 12):
        got = {r.det_id for r in N.mask_nms(df, rd, ["image_id"], 0.4, box_fallback=fallback, fold_limit=limit, tile=8).collect()}
        assert got == want, limit


def test_leader_cluster(spark):
    rows = random_rows(9, 60, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    mx, my = max(r[6] for r in rows), max(r[7] for r in rows)
    diag = (mx * mx + my * my) ** 0.5
    leaders, want = [], {}
    for r in sorted(rows, key=lambda r: r[1]):
        c = ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2)
        for lid, lc in leaders:
            if ((c[0] - lc[0]) ** 2 + (c[1] - lc[1]) ** 2) ** 0.5 / diag < 0.15:
                want[r[1]] = lid
                break
        else:
            leaders.append((r[1], c))
            want[r[1]] = r[1]
    for limit in (512, 10):
        got = {r.det_id: r.leader for r in N.leader_cluster(df, ["image_id"], fold_limit=limit).collect()}
        assert got == want, limit
