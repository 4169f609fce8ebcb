"""The trie of logged conversations against a plain one, with nulls, ties, repeated rows and long logs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from visiontables.llm import prefix_trie as P
from visiontables.llm.queries import op11_prefix_trie

LOG = "conv_id {}, turn bigint, role string, text string, depth int, a string, n_convs int, words string, path int"


def log(spark, rows, kind="bigint"):
    """Message rows with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "a", 2, "w", 3) for r in rows], LOG.format(kind))


def ordered(rows):
    logs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            logs[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [m[1:] for m in sorted(ms)] for c, ms in logs.items()}


def plain(logs):
    """Rows ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends``."""
    members = defaultdict(list)
    for c, ms in logs.items():
        for d in range(len(ms) + 1):
            members[tuple(ms[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = sum(saved[k] for k in below[node]) + (len(members[node]) - 1) * words(node)
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(below[n]), leaves[n], saved[n],
                   tuple(sorted(c for c in cs if len(logs[c]) == len(n)))) for n, cs in members.items())


def found(trie):
    ends = trie.ends.groupBy("depth", "a", "b").agg(F.array_sort(F.collect_list("conv_id")).alias("ends"))
    rows = trie.nodes.join(ends, ["depth", "a", "b"], "left").collect()
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], tuple(r["ends"] or ())) for r in rows)


def some_log(seed, conversations, most, ids=lambda i: i):
    rng = random.Random(seed)
    rows = []
    for i in range(conversations):
        n = rng.choice([1, 2, 3, most])
        rows += [(ids(i), t, ["user", "assistant"][t % 2], " ".join(rng.choice(["segment the", "red car ", "\tyes\n", ""]) for _ in range(rng.choice([1, 1, 2])))) for t in range(n)]
    return rows


EDGES = [(900, None, None, None), (900, 1, "user", "a b"), (900, 1, "user", "a b"), (901, 1, "user", "tie b"), (901, 1, "tool", "tie a"), (901, 1, "tool", "tie"),
         (902, None, "user", ""), (902, None, None, "x"), (None, 1, "user", "no conversation"), (903, -5, "user", "word " * 50_000), (904, 3, "", "")]


@pytest.mark.parametrize("band,span", [(2, 3), (3, 4096), (16, 5)])
def test_nodes_of_a_message_log(spark, band, span):
    rows = some_log(1, 60, 14) + [(500 + k, t, "user", f"step {t}") for k in range(3) for t in range(40 - k)] + EDGES
    more = spark.createDataFrame([(2000,), (2001,), (2001,), (500,), (None,)], "conv_id bigint")
    want = plain(ordered(rows) | {2000: [], 2001: []})
    assert found(P.prefix_trie(log(spark, rows).repartition(5), more, band=band, span=span)) == want


def test_conversations_named_by_text(spark):
    rows = some_log(2, 30, 5, lambda i: f"session-{i:03d}")
    assert found(P.prefix_trie(log(spark, rows, "string"))) == plain(ordered(rows))


def test_a_log_without_rows_has_no_node(spark):
    trie = P.prefix_trie(log(spark, []))
    assert trie.nodes.count() == trie.ends.count() == P.ends_digest(trie.ends).count() == 0


def test_only_conversations_without_messages(spark):
    assert found(P.prefix_trie(log(spark, []), spark.createDataFrame([(7,), (5,)], "conv_id bigint"))) == [(5, 0, None, 2, 0, 1, 0, (5, 7))]


def test_a_node_of_many_ends_and_children(spark):
    rows = [(c, 0, "system", "same prompt") for c in range(300)] + [(c, 1, "user", f"q {c // 2}") for c in range(0, 300, 2)]
    assert found(P.prefix_trie(log(spark, rows), band=2)) == plain(ordered(rows))


def test_query_rebuilds_every_conversation(spark, tmp_path):
    rows = [r for r in some_log(3, 70, 6) if r[0] not in (20, 41)] + EDGES
    log(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    logs = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in logs}
    rebuilt = {c: logs.get(c - c % 20, [])[: h[c]] + ms[h[c] :] for c, ms in logs.items()}
    assert any(not ms for ms in rebuilt.values())
    want = [(*r[:-1], hashlib.sha256(",".join(map(str, r[-1])).encode()).hexdigest()) for r in plain(rebuilt)]
    got = [tuple(r) for r in op11_prefix_trie(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
