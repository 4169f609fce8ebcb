"""Edge cases of selection, filters, crops, histories and numbering."""

import pytest
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import text as X
from visiontables.operators import filters as FL
from visiontables.operators import overlap as O
from visiontables.operators import select as S
from visiontables.operators import tiles as T
from visiontables.operators import tracks as K
from visiontables.operators.numbering import position_in_order

DET = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double"


def dets(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), x + 2.0, y + 2.0, 0.5) for i, x, y in rows], DET)


def chosen(df, criterion):
    return sorted(r.det_id for r in S.select_spatial(df, criterion, F.lit(20.0), F.lit(20.0)).collect())


def test_selection_of_none_to_three(spark):
    none = dets(spark, [(1, 0, 0)]).limit(0)
    one, two = dets(spark, [(1, 0, 0)]), dets(spark, [(1, 0, 0), (2, 5, 5)])
    three = dets(spark, [(1, 0, 0), (2, 5, 5), (3, 9, 9)])
    for c in S.CRITERIA:
        assert chosen(none, c) == []
        assert chosen(one, c) == [1]
    assert chosen(two, "third_from_left") == chosen(two, "second_from_left") == [2]
    assert chosen(two, "third_from_right") == [1]
    assert chosen(three, "third_from_left") == [3] and chosen(three, "second_from_right") == [2]
    with pytest.raises(ValueError):
        S.select_spatial(one, "nearest")


def test_selection_ties(spark):
    df = dets(spark, [(1, 4, 0), (2, 4, 0), (3, 4, 9)])
    assert chosen(df, "leftmost") == chosen(df, "rightmost") == chosen(df, "topmost") == [1]
    assert chosen(df, "bottommost") == chosen(df, "center") == [3]
    assert chosen(df, "left_of_all") == chosen(df, "right_of_all") == [1, 2, 3]
    assert chosen(df, "second_from_left") == [2] and chosen(df, "second_from_right") == [2]
    assert chosen(df, "third_from_right") == [1]


def test_attribute_arguments():
    for bad in ({}, {"min_size": 0.5, "max_size": 0.1}, {"aspect": (2.0, 1.0)}):
        with pytest.raises(ValueError):
            FL.attribute_checks(**bad)
    with pytest.raises(ValueError):
        T.pyramid(None, [1.0, 0.0])


def test_box_conversions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0, 90.0)], "cx double, cy double, w double, h double, angle double")
    r = B.convert_boxes(df, "xywha", "xyxy").first()
    assert (r.x1, r.y1, r.x2, r.y2) == tuple(pytest.approx(v) for v in (-1, -2, 1, 2))
    with pytest.raises(NotImplementedError):
        B.convert_boxes(df, "xywha", "xywh")


def test_crop_of_inverted_box(spark):
    df = spark.createDataFrame([(8.0, 8.0, 2.0, 2.0, 20, 20)], "x1 double, y1 double, x2 double, y2 double, w long, h long")
    r = B.crop_window(df, "cluster").first()
    assert (r.cx1, r.cy1, r.cx2, r.cy2) == (1, 1, 8, 8)
    r = B.crop_window(df, "region").first()
    assert (r.cx1, r.cx2) == (8, 9)


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.9])
def test_iou_join_against_all_pairs(spark, threshold):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(120):
        x, y, w, h = rng.uniform(-20, 60), rng.uniform(-20, 60), rng.choice([1, 2, 4, 8, 16, 32]), rng.choice([1, 2, 4, 8, 16, 33])
        rows.append((1, i, x, y, x + w, y + h, 0.5))
        if i % 3 == 0:
            rows.append((1, 1000 + i, x + w * 0.02, y, x + w * 1.02, y + h, 0.5))
    df = spark.createDataFrame(rows, DET)
    got = {(r.det_id, r.det_id_2) for r in O.iou_join(df, df, threshold, ["image_id"], "det_id", "det_id", once=True).collect()}
    from test_nms import iou

    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and iou(a[2:6], b[2:6]) >= threshold}
    assert got == want and want


@pytest.mark.parametrize("span", [4, 1000])
def test_histories_in_blocks(spark, span):
    import random

    rng = random.Random(5)
    rows = [(1, o, f, rng.random() < 0.6) for o in (1, 2) for f in range(40)]
    df = spark.createDataFrame(rows, "video_id long, obj_id long, frame_idx long, matched boolean")
    alive = {(r.obj_id, r.frame_idx): r.alive for r in K.keep_alive(df, 2, 5, -1, span).collect()}
    streak = {(r.obj_id, r.frame_idx): (r.streak, r.status) for r in K.confirmation_streak(df, 3, span).collect()}
    for o in (1, 2):
        value, run, sure = 2, 0, 1
        for _, _, f, m in [r for r in rows if r[1] == o]:
            value = min(5, value + 1) if m else max(-1, value - 1)
            run = run + 1 if m else 0
            sure = 2 if run >= 3 else sure
            assert alive[o, f] == value and streak[o, f] == (run, sure)


def test_positions_in_any_order(spark):
    rows = [(k % 2, (k * 37) % 50 / 10, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, v double, k long")
    got = {r.k: r.pos for r in position_in_order(df, ["g"], [F.desc("v"), F.asc("k")]).collect()}
    for g in (0, 1):
        for i, r in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2])), 1):
            assert got[r[2]] == i
    blocks = {r.k: r.pos for r in S.position_in_group(df, ["g"], "k", 16).collect()}
    assert all(blocks[k] == k // 2 + 1 for k in range(200))


def test_tool_call_notations(spark):
    texts = [
        'x {"name": "examine_each_mask", "arguments": {}} {"name": "other", "arguments": {}}',
        "segment_phrase_batch(text_prompts=[\"a\", 'b'], limit=3)",
        "report_no_mask",
        'select_masks_and_return "final_answer_masks": [1, 2]',
        "nothing here",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.c for r in df.select("i", X.extract_tool_calls(F.col("t")).alias("c")).collect()}
    assert [(c.name, c.arguments) for c in got[0]] == [("examine_each_mask", "{}")]
    assert [(c.name, c.arguments) for c in got[1]] == [("segment_phrase_batch", '{"text_prompts": ["a", "b"], "limit": 3}')]
    assert got[2][0].name == "report_no_mask"
    assert got[3][0].arguments == '{"final_answer_masks": [1, 2]}'
    assert got[4] is None


def test_replies(spark):
    rows = [(1, "Mask 1: HIGH\n2 - low\nMask 1: medium"), (2, None), (3, "<verdict>Accept Reject</verdict>")]
    df = spark.createDataFrame(rows, "i long, text string")
    got = {(r.i, r.mask_no): r.confidence for r in X.confidence_lines(df, ["i"]).collect()}
    assert got == {(1, 1): "MEDIUM", (1, 2): "LOW"}
    v = {r.i: r.v for r in df.select("i", X.verdict(F.col("text")).alias("v")).collect()}
    assert v == {1: None, 2: None, 3: None}
    keep = {r.i: (r.a, r.b) for r in df.select("i", FL.accept_yes_no(F.col("text"), "lenient").alias("a"), FL.accept_yes_no(F.col("text"), "strict").alias("b")).collect()}
    assert keep[2] == (True, False) and keep[1] == (False, False)


def test_kept_punctuation(spark):
    df = spark.createDataFrame([("A_b, {} &amp;lt; {c}!",)], "t string")
    assert df.select(X.canonicalize_text(F.col("t"), keep="{}")).first()[0] == "a b {} c"
