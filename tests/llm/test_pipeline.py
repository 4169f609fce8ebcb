"""Each stage of the corpus pipeline against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from test_llm_operators import plain_passages, plain_secrets, roots, shingles

import corpus_pipeline
from visiontables.llm import quality_model
from visiontables.llm.queries import QUERIES, remainder, table
from visiontables.llm.tables import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages(spark):
    documents = table(spark, SF, "documents")
    # rows the stages must cope with: nulls, no text, a repeated row
    other = " ".join(reversed(documents.where("doc_id = 0").first()["text"].split(" "))) + " password=hunter22 and token: abcdef0123 ."
    odd = spark.createDataFrame([(900_003, other, "en", "x", 7), (900_001, None, "en", "src0", None), (900_002, "", None, None, 0), (None, "no id but some words here", "en", None, 25), (3, None, "en", "x", 1)], documents.schema)
    docs = written(documents.unionByName(odd).unionByName(documents.where("doc_id = 5")))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]

    good = written(stages["quality classifier"](spark, docs, SF))
    labels = table(spark, SF, "labels").where(remainder(5) != 0)
    model = quality_model.fit_quality(docs, labels, ("n_chars",), message_id="doc_id")
    one = lambda r: quality_model._scores(model, pa.RecordBatch.from_pydict({"text": pa.array([r[1]], pa.string()), "n_chars": pa.array([r[4]], pa.int64())}), "text")[0]
    assert good.columns == COLUMNS and rows(good) == Counter({r: n for r, n in rows(docs).items() if one(r) >= 0.3})

    single = written(stages["n-gram Jaccard join"](spark, good, SF))
    given = list(rows(good))
    sets = [(r[0], shingles(r[1], 5)) for r in given if r[0] is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({i for i, _ in sets}, links)
    assert rows(single) == Counter(r for r in given if r[0] is None or root[r[0]] == r[0])

    clean = written(stages["benchmark decontamination"](spark, single, SF))
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hit = Counter()
    for r in rows(single).elements():
        (key,) = plain_passages([(r[0], r[1])], items)
        hit[r] += not key[2]
    assert rows(clean) == +hit

    masked = written(stages["secret scans"](spark, clean, SF))
    want = Counter()
    for r in rows(clean).elements():
        text, at, out = r[1], 0, []
        spans = sorted((a, b) for _, a, b in plain_secrets(text or ""))
        for a, b in spans:
            if a >= at:
                out += [text[at:a], "<secret>"]
            at = max(at, b)
        new = "".join(out) + text[at:] if spans else text
        want[(r[0], new, r[2], r[3], len(new) if spans else r[4])] += 1
    assert rows(masked) == want and any("<secret>" in (r[1] or "") for r in want)

    packed = stages["best-fit packing"](spark, masked, SF).toPandas()
    assert packed["doc_id"].nunique() == masked.select("doc_id").where("doc_id is not null").distinct().count()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_near_duplicates_share_80_of_100_five_word_shingles(spark):
    w = [f"w{k}" for k in range(200)]
    edited = lambda at: [f"v{k}" if k in at else x for k, x in enumerate(w)]
    # 100 words and 20 more: 96 of 116 five-word shingles (97 of 117 four-word ones); 30 more: 96 of 126
    texts = {1: w[:100], 2: w[:120], 11: [x + "b" for x in w[:100]], 12: [x + "b" for x in w[:130]], 21: [x + "c" for x in w], 22: [x + "c" for x in edited({30, 80, 130, 170})]}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "x", 1) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    five = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    links = [(a, b) for a in five for b in five if b < a and 100 * len(five[a] & five[b]) >= 80 * len(five[a] | five[b])]
    assert kept == {i for i, r in roots(set(five), links).items() if i == r} == {1, 11, 12, 21}


def test_the_query_runs_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 50


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
