"""Shared beginnings of logged conversations: a trie of message prefixes, rolled up by bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm.tables import salted_lookup, written
from visiontables.operators.numbering import position_in_order

BAND = 16
SPAN = 4096
_NODE = ["depth", "a", "b"]
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class PrefixTrie:
    """``nodes`` has a row per distinct prefix, ``ends`` a row per conversation: the node of its whole log.

    Both name a node by ``depth, a, b``: its number of messages and two hashes
    of them.
    """

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(
    messages: DataFrame, conversations: DataFrame | None = None, band: int = BAND, span: int = SPAN,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> PrefixTrie:
    """The trie of the message logs' prefixes, as used to plan shared prompt caches.

    A conversation's messages are ordered by ``turn`` (null first), then by
    role and text. Each distinct sequence of its first d messages (role, text)
    is a node of depth d, from the root without messages (d = 0); the
    conversations that start with it are its members. ``nodes`` holds

    * ``depth, a, b`` and ``conv_id``, the smallest member;
    * ``parent_conv_id``, the smallest member of the parent (null for the root);
    * ``n_convs``, ``n_children``: members, and nodes one message longer;
    * ``n_leaves``, ``saved_tokens``: over the node and all below it, the nodes
      without children, and (members - 1) x words of the last message.

    ``conversations`` may list further ``conv_id``s, those without a message;
    they are members of the root only. A null role or text is empty, repeated
    messages count as often as they stand there, a message without ``conv_id``
    belongs to no conversation and is left out. Without conversations there is
    no node. Ids may be of any ordered type; other columns are ignored.

    Messages are numbered over ranges and hashed over blocks of ``span``, so
    one long conversation spreads over many tasks. A node adds what it has to
    its ancestors within its band of ``band`` depths only; the nodes at which
    bands begin form a trie of a ``band``-th of the depth, rolled up the same
    way, and hand their completed totals to their ancestors one band above. A
    trie of depth d takes log_band(d) rounds. Nodes of many children or members
    are only ever summed up after partial sums, or looked up by salted keys.
    Prefixes are told apart by 128 bits of hashes.
    """
    m = messages.select(
        messages[conv_id].alias("conv_id"), messages[turn].alias("turn"),
        F.coalesce(messages[role], F.lit("")).alias("role"), F.coalesce(messages[text], F.lit("")).alias("text")).where("conv_id is not null")
    m = position_in_order(m, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "depth")
    own = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "text")
    m = m.select("conv_id", "depth", own(1).alias("own_a"), own(2).alias("own_b"), F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("words"))
    steps = _prefixes(written(m, "messages"), span)
    ends = steps.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("end")).select("conv_id", "end.*")
    if conversations is not None:
        ids = conversations.select(conversations[conv_id].alias("conv_id")).where("conv_id is not null").distinct()
        zero = F.lit(0).cast("bigint")
        ends = ids.unionByName(ends.select("conv_id")).distinct().join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _NODE])
    ends = written(ends, "ends")
    nothing = F.lit(0).cast("bigint")
    root = ends.select("conv_id", *[nothing.alias(c) for c in (*_NODE, "parent_a", "parent_b", "words")])
    steps = written(steps.unionByName(root), "prefixes")
    nodes = steps.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"), F.first("words").alias("words"))
    nodes = written(nodes, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", nothing)), "nodes")
    leaf = (F.col("n_children") == 0).cast("bigint")
    values = nodes.select(*_NODE, "conv_id", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rolled_up(steps.select("conv_id", *_NODE), values, band)
    parents = nodes.select(*_NODE, F.col("conv_id").alias("parent_conv_id"))
    found = salted_lookup(nodes.where("depth > 0").select(*_NODE, *[c.alias(f"of_{n}") for n, c in zip(_NODE, above)]), [f"of_{n}" for n in _NODE],
                          parents.select(*[F.col(n).alias(f"of_{n}") for n in _NODE], "parent_conv_id"))
    out = nodes.join(totals, _NODE).join(found.select(*_NODE, "parent_conv_id"), _NODE, "left")
    return PrefixTrie(out.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def _prefixes(m: DataFrame, span: int) -> DataFrame:
    """Hashes of all prefixes: each message's own hashes, salted by its place, combined with those before it."""
    mixed = lambda x, y: x.bitwiseXOR(y)
    m = m.withColumn("block", F.floor(F.col("depth") / span))
    totals = m.groupBy("conv_id", "block").agg(F.bit_xor("own_a").alias("ta"), F.bit_xor("own_b").alias("tb"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("bigint"))
    totals = totals.select("conv_id", "block", carried("ta").alias("ta"), carried("tb").alias("tb"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumns({"ra": F.bit_xor("own_a").over(within), "rb": F.bit_xor("own_b").over(within)}).join(totals, ["conv_id", "block"])
    m = m.withColumns({"a": mixed(F.col("ra"), F.col("ta")), "b": mixed(F.col("rb"), F.col("tb"))})
    return m.select("conv_id", *_NODE, mixed(F.col("a"), F.col("own_a")).alias("parent_a"), mixed(F.col("b"), F.col("own_b")).alias("parent_b"), "words")


def rolled_up(steps: DataFrame, values: DataFrame, band: int) -> DataFrame:
    """Sums of ``n_leaves`` and ``saved_tokens`` over each node and all below it.

    ``steps`` holds every conversation's nodes ``conv_id, depth, a, b``, and
    ``values`` each node's own amounts with one member ``conv_id``, whose steps
    are its ancestors.
    """
    sums = ["n_leaves", "saved_tokens"]
    total = lambda df: df.groupBy(*_NODE).agg(*[F.sum(s).alias(s) for s in sums])
    held = steps.join(values, ["conv_id", *_NODE], "left").withColumn("band", F.floor(F.col("depth") / band))
    paths = held.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(F.struct(*_NODE, *sums))).alias("path"))  # at most ``band`` long
    paths = written(paths, "bands")
    own = paths.withColumn("node", F.explode(F.filter("path", lambda x: x["n_leaves"].isNotNull())))
    own = own.select("node.n_leaves", "node.saved_tokens", F.explode(F.filter("path", lambda x: x["depth"] <= F.col("node.depth"))).alias("up"))
    inside = written(total(own.select("up.depth", "up.a", "up.b", *sums)), "inside")
    deepest = paths.agg(F.max("band")).first()[0]
    if not deepest:
        return inside
    at_root = F.col("depth") % band == 0
    shorter = (F.col("depth") / band).cast("bigint")
    tops = inside.where(at_root).join(values.select(*_NODE, "conv_id"), _NODE).withColumn("depth", shorter)
    whole = rolled_up(steps.where(at_root).withColumn("depth", shorter), tops, band).where("depth > 0")
    whole = whole.join(tops.select(*_NODE, "conv_id"), _NODE).select("conv_id", (F.col("depth") - 1).alias("band"), *sums)
    handed = whole.join(paths.select("conv_id", "band", "path"), ["conv_id", "band"]).select(*sums, F.explode("path").alias("up"))
    return written(total(inside.unionByName(handed.select("up.depth", "up.a", "up.b", *sums))), "totals")


def _digest(kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hasher = None, None
        for batch in batches:
            out = []
            for depth, a, b, conv in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "conv_id")]):
                if (depth, a, b) != at:
                    if hasher is not None:
                        out.append((*at, hasher.hexdigest()))
                    at, hasher = (depth, a, b), hashlib.sha256(str(conv).encode())
                else:
                    hasher.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, hasher.hexdigest()), kinds)], schema=kinds)

    return run


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, a, b, sha256`` of each node where conversations end: of their ids, ascending, joined by commas.

    Sorted ids stream through the hash, which takes them one after the other
    by nature, so a node of any number of ends needs no more memory than one.
    """
    long = T.LongType()
    schema = T.StructType([*[T.StructField(c, long) for c in _NODE], T.StructField("sha256", T.StringType())])
    kinds = pa.schema([*[(c, pa.int64()) for c in _NODE], ("sha256", pa.string())])
    ordered = ends.select(*_NODE, "conv_id").repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    return ordered.mapInArrow(_digest(kinds), schema)


def first_messages(messages: DataFrame, shared: Column, base: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Logs whose first messages are those of another conversation, as branches of one talk have.

    Every conversation takes the first ``shared`` messages (an expression of
    ``conv_id``, a small number) of the conversation ``base``, where that
    exists, and then its own after its first ``shared``. Returns the messages
    and all conversation ids, those left without a message included.
    """
    m = messages.select(messages[conv_id].alias("conv_id"), messages[turn].alias("turn"), messages[role].alias("role"), messages[text].alias("text")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")).asc(), F.coalesce("text", F.lit("")).asc()]
    m = written(position_in_order(m, ["conv_id"], order, "place"), "ordered")
    ids = written(m.select("conv_id").distinct().select("conv_id", base.alias("base"), shared.cast("bigint").alias("shared")), "conversations")
    most = ids.agg(F.max("shared")).first()[0] or 0
    head = m.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "role", "text")
    taken = ids.join(head, "base").where("place <= shared").select("conv_id", F.col("place").alias("turn"), "role", "text")
    own = m.join(ids, "conv_id").where("place > shared").select("conv_id", F.col("place").alias("turn"), "role", "text")
    return taken.unionByName(own), ids.select("conv_id")
