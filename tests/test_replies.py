"""Tool calls of replies are valid JSON, and rows without a rating are looked at again."""

import json

import pytest
from pyspark.sql import functions as F

from visiontables.functions import text as X
from visiontables.plans import hooks as H


@pytest.mark.parametrize("reply, want", [
    ("segment_phrase_batch ['a', \"driver's car\"] text_prompts = ['a', \"driver's car\"]", {"text_prompts": ["a", "driver's car"]}),
    ('segment_phrase_batch "text_prompts": ["a", "b",]', {"text_prompts": ["a", "b"]}),
    ("segment_phrase text_prompt = 'the \"red\" car'", {"text_prompts": ['the "red" car']}),
    ("segment_phrase_batch(text_prompts=['x', 'y'], min_size=\"0.01\", label='a \"b\"')", {"text_prompts": ["x", "y"], "min_size": 0.01, "label": 'a "b"'}),
    ('{"name": "segment_phrase_batch", "arguments": {"text_prompts": ["a"]}}', {"text_prompts": ["a"]}),
])
def test_tool_arguments(spark, reply, want):
    calls = spark.createDataFrame([(reply,)], "t string").select(X.extract_tool_calls(F.col("t")).alias("c")).first().c
    assert [json.loads(c.arguments) for c in calls] == [want]


def test_unrated_rows_are_doubtful(spark):
    rows = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 10.0 * i + 5, 5.0, 0.5) for i in range(1, 31)],
                                 "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double")
    out = H.smart_confidence(rows, lambda p: "nothing", lambda p: "\n".join(f"Mask {i}: HIGH" for i in p["pos"]), ["image_id"], limit=0)
    assert {r.confidence for r in out.collect()} == {"HIGH"}
    out = H.smart_confidence(rows, lambda p: "nothing", lambda p: "Mask 1: HIGH", ["image_id"], limit=30)
    assert {r.confidence for r in out.collect()} == {"LOW"}
