"""Quality rules: counts against plain ones, and lists learnt from rows whose rule is known."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visiontables.llm import quality_rules as Q

LOG = "conv_id string, turn bigint, role string, text string, n_chars bigint, _text string, bad int, rule string"


def log(spark, rows):
    """Message rows ``(conv_id, turn, text)`` with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(c, t, "user", x, 7, "t", 1, "r") for c, t, x in rows], LOG)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EDGES = [None, "", " \n\t\x0b\x0c\r ", "a", "a b c d e", "a b c d e a b c d e", "a " * 12, "a b " * 9, "x\n\nx\n x\nx\r\n", "é ü 😀 日本 語", "# * $ % & | < > ##", "\x00 \x1c b"]


def test_counts_of_whole_texts(spark):
    rng = random.Random(1)
    texts = EDGES + ["".join(rng.choice(["red car ", "é", "\n", " ", "mask 3 ", "| ", "a b c d e f "]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    texts += [" ".join(rng.choice("abcdefghij") for _ in range(60_000)), "w" * 300_000]
    rows = [(f"c{i % 7}", i, t) for i, t in enumerate(texts)] + [(None, None, "no key here"), ("c1", 1, "")]
    got = Q.rate_messages(log(spark, rows), [], ["conv_id", "turn"]).collect()
    assert len(got) == len(rows)
    want = Counter((c, t, *(p := plain(x)), failed := p[0] < 10 or 100 * p[4] > 20 * p[0], None, not failed) for c, t, x in rows)
    assert Counter((r["conv_id"], r["turn"], *[r[c] for c in COUNTS], r["base_failed"], r["rule"], r["kept"]) for r in got) == want


def noisy(rng, bad):
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
    if bad == 1:
        words = [w + "###" for w in words]
    if bad == 2:
        words = [w * 6 for w in words]
    return " ".join(words)


def labelled(spark, n, seed=3):
    rng = random.Random(seed)
    kinds = [rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(n)]
    rows = [(f"c{i}", 0, noisy(rng, k)) for i, k in enumerate(kinds)]
    labels = [(f"c{i}", 0, int(not k)) for i, k in enumerate(kinds)]
    return rows, labels, kinds


def test_rules_find_what_was_planted(spark):
    rows, labels, kinds = labelled(spark, 600)
    labels += [("c0", 0, None), (None, 0, 1), ("gone", 0, 0), ("c1", 0, 0), ("c1", 0, int(not kinds[1]))]
    train = spark.createDataFrame([x for x in labels if x[0] is None or x[0] == "gone" or int(x[0][1:]) < 400], "conv_id string, turn bigint, quality int")
    messages = log(spark, rows)
    rules = Q.learn_rules(messages, train, ["conv_id", "turn"])
    assert 1 <= len(rules) <= 4 and {c.statistic for r in rules for c in r.conditions} <= {"symbols_per_word", "word_length", "words_per_line", "n_words", "distinct_words"}
    got = {r["conv_id"]: r for r in Q.rate_messages(messages, rules, ["conv_id", "turn"]).collect()}
    held = [i for i in range(400, 600) if not got[f"c{i}"]["base_failed"]]
    right = [got[f"c{i}"]["kept"] == (kinds[i] == 0) for i in held]
    assert sum(right) / len(right) >= 0.97
    # the first rule that holds is named, in the list's order
    named = Q.rate_messages(messages, rules, ["conv_id", "turn"]).select("rule", *[r.column().alias(f"_{i}") for i, r in enumerate(rules)])
    for r in named.collect():
        assert r["rule"] == next((str(x) for i, x in enumerate(rules) if r[f"_{i}"]), None)


def test_the_list_is_that_of_a_plain_version(spark):
    """The first condition gains most among all statistics and thresholds; pruning keeps the best prefix."""
    import math

    rows, labels, _ = labelled(spark, 240, seed=5)
    messages = log(spark, rows)
    frame = spark.createDataFrame(labels, "conv_id string, turn bigint, quality int")
    rules = Q.learn_rules(messages, frame, ["conv_id", "turn"], grades=8, most_rules=1, most_conditions=1)
    joined = Q.rate_messages(messages, [], ["conv_id", "turn"]).where("not base_failed").join(frame, ["conv_id", "turn"])
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    table = joined.select("quality", part.alias("part"), *[c.alias(n) for n, c in Q._statistics().items()]).toPandas()
    grow = table[table.part < 2]
    bad, good = (grow.quality == 0).sum(), (grow.quality == 1).sum()
    best = 0
    for s in Q._statistics():
        ordered = sorted(table[s])
        for t in {ordered[max(0, math.ceil(k / 8 * len(ordered)) - 1)] for k in range(1, 8)}:
            for up in (True, False):
                on = grow[grow[s] >= t] if up else grow[grow[s] < t]
                b, w = (on.quality == 0).sum(), (on.quality == 1).sum()
                best = max(best, b * (math.log2(b / (b + w)) - math.log2(bad / (bad + good))) if b else 0)
    (c,) = rules[0].conditions
    on = grow[(grow[c.statistic] >= c.threshold) == c.at_least]
    b, w = (on.quality == 0).sum(), (on.quality == 1).sum()
    assert b * (math.log2(b / (b + w)) - math.log2(bad / (bad + good))) == pytest.approx(best)


def test_nothing_to_learn_from(spark):
    rows, labels, kinds = labelled(spark, 30)
    kind = "conv_id string, turn bigint, quality int"
    for given in ([], [(c, t, 1) for c, t, _ in labels], [(c, t, None) for c, t, _ in labels]):
        assert Q.learn_rules(log(spark, rows), spark.createDataFrame(given, kind), ["conv_id", "turn"]) == []
    empty = log(spark, [])
    assert Q.learn_rules(empty, spark.createDataFrame(labels, kind), ["conv_id", "turn"]) == []
    assert Q.rate_messages(empty, [], ["conv_id"]).count() == 0


def test_the_plan_has_no_python(spark):
    plan = Q.rate_messages(log(spark, [("c", 0, "x")]), [], ["conv_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
