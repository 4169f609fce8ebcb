import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visiontables.operators import overlap as O
from visiontables.operators import packed as P
from visiontables.operators import runs as R
from visiontables.plans import videos as PV


def some_runs(seed, masks=9, keys=3):
    rnd, rows = random.Random(seed), []
    for k in range(keys):
        for m in range(masks):
            x0, y0 = rnd.randrange(0, 300), rnd.randrange(0, 40)
            rows += [(k, m, x, y0 + x % 3, y0 + rnd.randrange(0, 30)) for x in range(x0, x0 + rnd.randrange(1, 90))]
    rnd.shuffle(rows)
    return rows


def shared(rows, other, once):
    out = {}
    for k, a, x, s, e in rows:
        for k2, b, x2, s2, e2 in other:
            n = min(e, e2) - max(s, s2)
            if k == k2 and x == x2 and n > 0 and e > s and e2 > s2 and (a < b or not once):
                out[k, a, b] = out.get((k, a, b), 0) + n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_intersections_of_strewn_runs(spark, seed):
    rows, other = some_runs(seed), some_runs(seed + 10, masks=4)
    table = lambda r, name: spark.createDataFrame(r, f"k long, {name} long, x long, ys long, ye long").repartition(3)
    a, b = table(rows, "p"), table(other, "q")
    got = lambda df: {(r.k, r._a, r._b): r.inter for r in df.collect()}
    assert got(O.mask_intersections(a, a, ["k"], "p", "p", once=True, stripe=32, band=16)) == shared(rows, rows, True)
    assert got(O.mask_intersections(a, b, ["k"], "p", "q", stripe=32, band=16)) == shared(rows, other, False)


def test_groups_are_whole_across_batches(spark):
    df = spark.createDataFrame([(k, i) for i in range(40) for k in (None, "a", "b", "c")], "k string, i long").repartition(5)

    def kernel(table, group):
        for g in sorted(set(group)):
            part = table.filter(pa.array(group == g))
            yield pa.RecordBatch.from_pydict({"k": [part.column("k")[0].as_py()], "n": [part.num_rows]}, schema=pa.schema([("k", pa.string()), ("n", pa.int64())]))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((r.k or "", r.n) for r in P.by_group(df, ["k"], kernel, "k string, n long").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("", 40), ("a", 40), ("b", 40), ("c", 40)]


def test_unrolled_masks_are_never_broadcast(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, o, 0, 20, 5) for o in (1, 2)], "video_id long, frame_idx long, obj_id long, x0 long, x1 long, h long")
    boxes.write.parquet(str(tmp_path / "b"))
    boxes = spark.read.parquet(str(tmp_path / "b"))
    runs = boxes.selectExpr("video_id", "frame_idx", "obj_id", "explode(sequence(x0, x1 - 1)) as x", "0L as ys", "h as ye")
    keys = ["video_id", "frame_idx"]
    for df in (PV.review_annotations(runs, runs, keys), O.mask_overlap_join(runs, runs, keys, "obj_id", "obj_id", once=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
    assert PV.review_annotations(runs, runs, keys).collect()[0].matched == 2


def cells(rows):
    return {(k, x, y) for k, x, s, e in rows for y in range(s, e)}


def column_runs(points):
    out, seen = [], set(points)
    for k, x, y in sorted(seen):
        if (k, x, y - 1) not in seen:
            e = y
            while (k, x, e) in seen:
                e += 1
            out.append((k, x, y, e))
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_two_masks_of_strewn_runs(spark, seed):
    one = lambda s: [(k * 10 + m, x, ys, ye) for k, m, x, ys, ye in some_runs(s, masks=3)]
    a, b = one(seed), one(seed + 20)
    table = lambda rows: spark.createDataFrame(rows, "k long, x long, ys long, ye long").repartition(3)
    p, q = cells(a), cells(b)
    got = lambda df: sorted((r.k, r.x, r.ys, r.ye) for r in df.collect())
    for how, want in (("intersect", p & q), ("except", p - q), ("xor", p ^ q)):
        assert got(R.mask_combine(table(a), table(b), ["k"], how)) == column_runs(want)
    e = R.error_regions(table(a), table(b), ["k"])
    assert got(e.where("kind = 'fp'")) == column_runs(p - q) and got(e.where("kind = 'fn'")) == column_runs(q - p)
    assert "Window" not in e._jdf.queryExecution().executedPlan().toString()
    edges = {(r.k, r.x, r.y) for r in R.mask_edges(table(column_runs(p)), ["k"], 200, 60).collect()}
    near = {(k, x - dx, y - dy) for k, x, y in p for dx, dy in ((0, 0), (1, 0), (0, 1))}
    differs = lambda k, x, y: ((k, x, y) in p) != ((k, x + 1, y) in p) or ((k, x, y) in p) != ((k, x, y + 1) in p)
    assert edges == {c for c in near if differs(*c) and 1 <= c[1] < 199 and 1 <= c[2] < 59}


def test_first_owner_of_strewn_runs(spark):
    rows = some_runs(5)
    best = {}
    for k, m, x, s, e in rows:
        for y in range(s, e):
            best[k, x, y] = min(best.get((k, x, y), (9, 0)), (m % 3, m))
    df = spark.createDataFrame(rows, "k long, m long, x long, ys long, ye long").repartition(4)
    own = R.resolve_overlaps(df, ["k"], "m", [F.col("m") % 3])
    got = sorted((r.k * 100 + r.m, r.x, r.ys, r.ye) for r in own.collect())
    assert got == column_runs({(k * 100 + m, x, y) for (k, x, y), (_, m) in best.items()})
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()


def test_runs_of_strewn_pixels(spark):
    points = list(cells([(k, x, s, e) for k, m, x, s, e in some_runs(6, masks=2)]))
    df = spark.createDataFrame(points + points[::3], "k long, x long, y long").repartition(4)
    assert sorted((r.k, r.x, r.ys, r.ye) for r in R.encode_runs(df, ["k"]).collect()) == column_runs(points)


def test_lengths_without_windows(spark):
    df = spark.createDataFrame([(1, 0, 2, 4), (1, 1, 0, 3), (1, 0, 0, 1), (2, 1, 3, 4), (2, 1, 3, 4), (3, 0, None, None), (3, 0, None, None)], "k long, x long, ys long, ye long")
    counts = R.encode_counts(df, ["k"], F.lit(4), F.lit(2))
    assert {r.k: r.counts for r in counts.collect()} == {1: [0, 1, 1, 5, 1], 2: [7, 1], 3: [None, None]}
    plan = R.decode_runs(counts, ["k"], F.lit(4))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("most", [7, 1 << 21])
def test_lines_turned_into_columns(most):
    import numpy as np

    rnd = random.Random(most)
    points = {(r, x, y) for r in range(4) for x in range(12) for y in range(9) if rnd.random() < 0.6}
    spans = [(r, y, s, e) for r, y, s, e in column_runs({(r * 100 + y, 0, x) for r, x, y in points}) for r, y in [divmod(r, 100)]]
    arrays = [np.array(v) for v in zip(*spans)]
    got = [tuple(map(int, t)) for part in R._turned(*arrays, most=most) for t in zip(*part)]
    assert sorted(got) == column_runs(points)
