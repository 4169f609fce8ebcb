"""Collocations against plain counts, and the shard index against plain scans."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from visiontables.llm import phrase_index as P

LOG = "conv_id bigint, turn bigint, role string, text string, shard int, n int, word string, a string, phrase string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def log(spark, rows):
    """Message rows ``(role, text)`` with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, 0, r, t, 1, 2, "w", "a", "p") for i, (r, t) in enumerate(rows)], LOG)


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(rows, least, top=2000, within=50):
    f, n = defaultdict(Counter), Counter()
    for role, text in rows:
        for w in pieces(text):
            n["und" if role is None else role] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f["und" if role is None else role][tuple(w[i : i + k])] += 1
    out = []
    for role, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in candidates.items():
            if len(p) == 2 and any(q[i : i + 2] == p and 100 * b >= within * a for q, b in candidates.items() if len(q) == 3 for i in (0, 1)):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((role, rank, phrase.decode(), -a, left, right, n[role], -score))
    return sorted(out)


def some_text(rng, words=60):
    vocabulary = ["New", "york", "the", "in", "été", "zürich", "mask", "Of", "x y", "b-2", "ＮＥＷ", "tile\x00"]
    out = []
    for _ in range(words):
        out.append(rng.choice(["new York ", "in the mask ", "a the of ", *(v + " " for v in vocabulary), ". ", "\t", ", ", "\r\n", ": "]))
    return "".join(out)


def test_phrases_of_each_role(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant", None, ""]), some_text(rng)) for _ in range(150)]
    rows += [("user", None), (None, ""), ("tool", " \n\t. "), ("lone", "word"), ("user", "rare " * 3)] + [("copies", "to be or not to be")] * 30
    want = plain(rows, 10)
    assert {r[0] for r in want} >= {"user", "assistant", "und", "", "copies"}
    for partitions, size in [(1, 12 << 20), (5, 700)]:
        got = P.mine_phrases(log(spark, rows).repartition(partitions), shard_bytes=size)
        assert sorted(map(tuple, got.collect())) == want


def test_top_ties_and_long_text(spark):
    rng = random.Random(2)
    rows = [("r", some_text(rng, 30_000)), ("r", "p q. " * 12 + "s t. " * 12 + "é f. " * 12)]
    want = plain(rows, 3, top=7, within=90)
    got = P.mine_phrases(log(spark, rows), least=3, top=7, within=90, shard_bytes=1000)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7


def test_nothing_to_mine(spark):
    for rows in ([], [("user", None)], [("user", "only a few words")]):
        assert P.mine_phrases(log(spark, rows)).count() == 0


def test_products_pass_64_bits(spark, monkeypatch):
    """Counts that only a corpus of many terabytes has, put in place of the shards' own."""
    big = 3_000_000_007
    shards = P._shards

    def words(most):
        plain_run = shards(most)

        def run(batches):
            for b in plain_run(batches):
                n = b.column("n")
                yield b.set_column(b.schema.get_field_index("n"), b.schema.field("n"), pa.ListArray.from_arrays(n.offsets, pa.array(n.values.to_numpy() * big)))

        return run

    plain_pairs = P._pairs

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        t = plain_pairs(a, b)
        return t.set_column(3, t.schema.field("n"), pa.array(t.column("n").to_numpy() * big))

    monkeypatch.setattr(P, "_shards", words)
    monkeypatch.setattr(P, "_pairs", pairs)
    (row,) = P.mine_phrases(log(spark, [("r", "one two. " * 10 + "one. " * 5)])).collect()
    assert tuple(row) == ("r", 1, "one two", 10 * big, 15 * big, 10 * big, 25 * big, 666_666)


@pytest.mark.parametrize("seed", range(6))
def test_intervals_count_phrases(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, rng.integers(2, 9), rng.integers(1, 400))
    index = P.ShardIndex(seq)
    text = [int(x) for x in seq]
    grams = lambda k: Counter(g for i in range(len(text) - k + 1) if 0 not in (g := tuple(text[i : i + k])))
    assert Counter({(a, b): n for a, b, n in zip(*map(np.ndarray.tolist, index.pairs()))}) == grams(2)
    pairs = sorted(grams(2))
    known = [p for i, p in enumerate(pairs) if i % 4] or pairs
    a, b = (np.array([p[i] for p in known], np.int64) for i in (0, 1))
    want = Counter({g: n for g, n in grams(3).items() if g[:2] in known and g[1:] in known})
    assert Counter({g[:3]: g[3] for g in zip(*map(np.ndarray.tolist, index.triples(a, b)))}) == want
    # right extensions first, then left ones: the same intervals
    ids = np.flatnonzero(index.size > 0)
    ids = ids[ids > 0]
    which, second, lo, rlo, size = index.extend_right(*index.word(ids))
    last, first, *_, count = index.extend_left(lo, rlo, size)
    got = Counter({(int(f), int(ids[which[w]]), int(second[w])): int(n) for w, f, n in zip(last, first, count)})
    assert got == grams(3)


def test_many_words_sort_without_packing():
    seq = np.array([1, 2**22, 3, 0, 1, 2**22, 3, 5])
    a, b, n = P.ShardIndex(seq).pairs()
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 2**22, 2), (3, 5, 1), (2**22, 3, 2)]
