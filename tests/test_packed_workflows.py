"""Workflows whose masks stay packs, and whose tiles are dealt and joined without the driver."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from visiontables.operators import components as C
from visiontables.operators import nms as N
from visiontables.operators import numbering
from visiontables.operators import packed as P
from visiontables.operators import runs as R
from visiontables.operators import tiles as T
from visiontables.plans import hooks as H
from visiontables.plans import images as PI

KEY = ["image_id", "det_id"]


def some_masks(spark, seed=3):
    """Packs, some masks in two of them, and the same runs one to a row."""
    rnd, rows = random.Random(seed), []
    for image in (1, 2, 3, None):
        for det in range(12):
            x0, y0 = rnd.randrange(-4, 50), rnd.randrange(-3, 30)
            rows += [(image, det, x, y0 + x % 2, y0 + rnd.randrange(0, 25)) for x in range(x0, x0 + rnd.randrange(1, 30))]
    runs = spark.createDataFrame(rows, "image_id long, det_id long, x long, ys long, ye long")
    return runs, P.pack(runs.sortWithinPartitions("x").repartition(3, "x").sortWithinPartitions(*KEY), KEY)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def sizes(df):
    return df.withColumns({"w": F.col("det_id") + 40, "h": F.lit(33).cast("bigint"), "dx": F.col("det_id") - 5, "sw": F.lit(20).cast("bigint")})


def test_packs_are_placed_and_resized_as_runs(spark):
    runs, packs = some_masks(spark)
    moved = [R.place_masks(sizes(d), F.col("dx"), F.lit(-2), F.col("w"), F.col("h")) for d in (runs, packs)]
    assert rows_of(moved[0], *KEY, "x", "ys", "ye") == rows_of(P.unpack(moved[1], KEY), *KEY, "x", "ys", "ye")
    grown = [R.resize_runs(d, F.col("sw"), 17, F.col("w"), F.col("h")) for d in moved]
    assert rows_of(grown[0], *KEY, "x", "ys", "ye") == rows_of(P.unpack(grown[1], KEY), *KEY, "x", "ys", "ye")
    assert grown[0].count() > moved[0].count() > 0


def test_packs_are_written_and_measured_as_runs(spark):
    runs, _ = some_masks(spark)
    runs = P.united(R.place_masks(runs, F.lit(5), F.lit(4), F.lit(90), F.lit(70)), KEY)
    packs = P.pack(runs, KEY)
    texts = [R.encode_coco_counts(R.encode_counts(d, KEY, F.lit(70), F.lit(90))) for d in (runs, packs)]
    assert rows_of(texts[0], *KEY, "text") == rows_of(texts[1], *KEY, "text") != []
    read = [R.decode_runs(R.decode_coco_counts(t, "text", "n"), KEY, F.lit(70), counts="n", packed=p) for t, p in zip(texts, (False, True))]
    assert rows_of(read[0], *KEY, "x", "ys", "ye") == rows_of(P.unpack(read[1], KEY), *KEY, "x", "ys", "ye") == rows_of(runs, *KEY, "x", "ys", "ye")
    for limit in (C.LOCAL_RUNS, 12):
        boxes = [C.obb_from_mask(d, KEY, local_runs=limit) for d in (runs, packs)]
        near = lambda df: [(*r[:2], *[round(v, 6) for v in r[2:]]) for r in rows_of(df, *KEY, "cx", "cy", "w", "h")]
        assert near(boxes[0]) == near(boxes[1]) != []


def test_packs_are_a_few_bytes_a_run_and_hold_any_numbers(spark):
    """Disk follows from the size of packs: ten runs of a mask took 240 bytes and more."""
    rnd = random.Random(5)
    rows = [(k, x, 40 + x % 3, 70 - x % 2) for k in range(50) for x in range(3, 13)]
    runs = spark.createDataFrame(rows, "k long, x long, ys long, ye long").coalesce(1)
    packs = P.pack(runs, ["k"])
    assert packs.count() == 50 and all(len(r[P.RUNS]) <= 40 for r in packs.collect())
    big = [(rnd.randrange(4), *[rnd.choice([0, 1, -1, 200, -(1 << 40), 1 << 62]) + rnd.randrange(300) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(big, "k long, x long, ys long, ye long").repartition(2, "k").sortWithinPartitions("k")
    assert rows_of(P.unpack(P.pack(df, ["k"]), ["k"]), "k", "x", "ys", "ye") == sorted(big, key=str)


def test_runs_join_as_packs(spark):
    """All runs come through, also those without a place or of no height; no run is shuffled by itself."""
    rows = [(k, x, y, y + h) for k in (1, 2, 3, None) for x in range(4) for y, h in ((0, 3), (9, 0), (20, -2))] + [(1, None, 2, 3), (2, 1, None, 3), (3, 1, 1, None)]
    runs = spark.createDataFrame(rows, "k long, x long, ys long, ye long")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k long, v string")
    for how, columns in (("inner", ["k", "x", "ys", "ye", "v"]), ("left_semi", ["k", "x", "ys", "ye"]), ("left_anti", ["k", "x", "ys", "ye"])):
        assert rows_of(P.join_packed(runs, other, ["k"], how), *columns) == rows_of(runs.join(other, ["k"], how), *columns)
    resolved = runs.where("k = 2 or x = 0")
    plan = R.drop_shrunk(runs, resolved, ["k"], 0.5)._jdf.queryExecution().optimizedPlan().toString()
    anti = plan[plan.index("LeftAnti"):].split("\n")[1]
    assert "MapInArrow" in anti
    assert {r.k for r in R.drop_shrunk(runs, resolved, ["k"], 0.5).collect()} >= {2}


def test_only_keys_meet_the_wrong_ones(spark, monkeypatch):
    """Keys without an error are found among keys, not by shuffling every run."""
    rows = [(k, x, 1, 5) for k in range(6) for x in range(8)]
    truth = spark.createDataFrame(rows, "k long, x long, ys long, ye long")
    pred = truth.where("k > 1 or x < 5")
    got = {r.k: r for r in C.error_random_points(pred, truth, ["k"], 3, 10, 10).collect()}
    assert {k: r.label for k, r in got.items()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    assert all(got[k].x >= 5 for k in (0, 1)) and all(not (got[k].x < 8 and 1 <= got[k].y < 5) for k in range(2, 6))


def test_null_texts_have_no_lengths(spark):
    df = spark.createDataFrame([(1, "0a1"), (2, None), (3, ""), (4, None)], "k long, counts string").coalesce(1)
    assert [r.n for r in R.decode_coco_counts(df, "counts", "n").orderBy("k").collect()] == [R._decode_text("0a1"), None, [], None]


@pytest.mark.parametrize("limits", [(512, 1 << 18), (512, 20), (4, 1 << 18)])
def test_mask_nms_takes_packs(spark, limits):
    runs, packs = some_masks(spark)
    box = runs.groupBy(*KEY).agg(*[f(c).cast("double").alias(n) for f, c, n in ((F.min, "x", "x1"), (F.min, "ys", "y1"), (F.max, "x", "x2"), (F.max, "ye", "y2"))])
    dets = box.where("image_id is not null").withColumn("score", F.col("det_id") % 5 / F.lit(5.0))
    bare = F.col("det_id") % 4 > 0
    got = [rows_of(N.mask_nms(dets, d.where(bare), ["image_id"], 0.2, fold_limit=limits[0], fold_runs=limits[1]), *KEY) for d in (runs, packs)]
    assert got[0] == got[1] != []


def test_tiles_are_dealt_over_a_bounded_number_of_tasks(spark):
    """Two tiles for each of 100,000 images are no reason for as many tasks as would weigh on the driver."""
    tiles = spark.range(200_000).selectExpr("id div 2 as image_id", "1D as scale", "id % 2 as tile_id")
    found = H.detect(tiles, lambda pdf: pdf.iloc[:0])
    cores = spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() <= 32 * cores
    assert H.detect(tiles.limit(512), lambda pdf: pdf.iloc[:0]).rdd.getNumPartitions() == cores


def test_tiles_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A few bytes of images make many tiles, which are no small table."""
    def one_box(tiles):
        n = len(tiles)
        found = {"local_id": [0] * n, "x1": [2.0] * n, "y1": [3.0] * n, "x2": [9.0] * n, "y2": [8.0] * n, "score": [0.9] * n}
        return pd.DataFrame({c: tiles[c].to_numpy() for c in ("image_id", "scale", "tile_id", "prompt_no", "prompt")} | found)

    spark.createDataFrame([(i, 900, 700, ["a", "b"]) for i in range(3)], "image_id long, w long, h long, prompts array<string>").write.parquet(str(tmp_path / "i"))
    plans, place = [], T.tile_to_image

    def seen(*given):
        out = place(*given)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(PI.T, "tile_to_image", seen)
    docs = PI.segment(spark.read.parquet(str(tmp_path / "i")), one_box)
    assert plans and not any("Broadcast" in p for p in plans)
    assert [len(r.pred_ids) for r in docs.collect()] == [5, 5, 5]  # four tiles and one of half the scale, under either prompt the same


def test_small_groups_are_numbered_without_being_written(spark, monkeypatch):
    """Rows are numbered in one shuffle; groups above the bound still go by ranges."""
    rows = [(k, i * 7 % 50, i) for k in ("a", "b", None) for i in range(50)] + [("c", i * 3 % 400, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    want = rows_of(numbering.position_in_order(df, ["k"], [F.asc("i")]), "k", "i", "pos")
    sizes, kept = [], numbering.checkpoint
    monkeypatch.setattr(numbering, "checkpoint", lambda d: (sizes.append(d.count()), kept(d))[1])
    assert rows_of(numbering.position_in_order(df, ["k"], [F.asc("i")], whole=1000), "k", "i", "pos") == want and sizes == [0]
    assert rows_of(numbering.position_in_order(df, ["k"], [F.asc("i")], whole=100), "k", "i", "pos") == want and sizes[1:] == [1, 400]
