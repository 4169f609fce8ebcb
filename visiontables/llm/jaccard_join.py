"""Messages that share most of their word shingles: an exact Jaccard join by prefix filter, sketches and hubs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.llm import textbytes as B
from visiontables.llm.links import components
from visiontables.llm.tables import discard, most_frequent, narrow, written
from visiontables.session import is_empty

_U = np.uint64
# Long lists that are told apart: those with the most members. Only what comes last in the search depends on it.
MOST_LONG = 1 << 18
SALT_ROWS = 8_192
#: Members of a long list that are compared with each other in one go.
BLOCK_ROWS = 4_096


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct hashed shingles, ascending; a text of fewer words has them all as its only one."""
    buf, bounds = B.flat(column)
    start, end, first = B.words(buf, bounds, B.SPACED)
    w = B.word_hashes(buf, start, end)
    factor = B.keys(width, 29)
    h = np.zeros(max(0, len(w) - width + 1), _U)
    for j in range(width):
        h += w[j : len(w) - width + 1 + j] * factor[j]
    h = B.mix(h + _U(width))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(B.mix((w[a:b] * factor[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


@dataclass(frozen=True)
class Join:
    """What the join is made of: words per shingle, percent of similarity, and the length from which lists are long."""

    width: int = 4
    percent: int = 85
    long_list: int = 32

    def prefix(self, n: int) -> int:
        """How many lists are searched for candidates: all but the required overlap less one."""
        return n + (-self.percent * n // 100) + 1 if n else 0


def _signature(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of 512 classes of shingles: sets whose sketches differ in k bits differ in at least k shingles."""
    odd = np.bincount((shingles >> _U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            sets = shingle_sets(b.column("text"), join.width)
            yield pa.RecordBatch.from_arrays(
                [b.column("message_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([_sketch(s) for s in sets], pa.list_(pa.int64()))], names=["message_id", "n", "sig", "sketch"])

    return run


def _prefix(join: Join, s: np.ndarray, long_lists: np.ndarray) -> np.ndarray:
    p = join.prefix(len(s))
    if len(long_lists) and len(s):
        at = np.searchsorted(long_lists, s)
        at[at == len(long_lists)] = 0
        long = long_lists[at] == s
        s = np.concatenate([s[~long], s[long]])
    return s[:p]


def _distinct_prefixes(join: Join, batch: pa.RecordBatch, long_lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a batch's distinct sets: shingle, signature, size, and how many shingles are left from this one on."""
    sets = {_signature(s): s for s in shingle_sets(batch.column("text"), join.width) if len(s)}
    parts = [_prefix(join, s, long_lists) for s in sets.values()]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    sig = np.repeat(np.fromiter(sets, np.int64, len(sets)), size)
    left = np.repeat(np.array([len(s) for s in sets.values()], np.int64), size) - B.ragged(np.zeros(len(size), np.int64), size)
    return flat.view(np.int64), sig, np.repeat(np.array([len(s) for s in sets.values()], np.int64), size), left


def _list_lengths(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            shingle, n = np.unique(_distinct_prefixes(join, b, np.zeros(0, _U))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n)], names=["shingle", "n"])

    return run


def _postings(join: Join, long_lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _distinct_prefixes(join, b, long_lists.value)], names=["shingle", "sig", "n", "left"])

    return run


def _merge_lists(join: Join):
    """Candidates from lists that come sorted by shingle; what is left of long ones goes on as it is.

    A list with salts is here only in part, so it counts as long whatever is here of it.
    """
    names = ["long", "shingle", "a", "na", "b", "nb", "left"]

    def merged(shingle: np.ndarray, salt: np.ndarray, sig: np.ndarray, n: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        keep = np.ones(len(sig), bool)
        keep[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])
        shingle, salt, sig, n, rest = shingle[keep], salt[keep], sig[keep], n[keep], rest[keep]
        head = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        size = np.diff(np.append(head, len(shingle)))
        each = np.repeat(size, size)
        long = (each > join.long_list) | (salt > 0)
        left = [np.zeros(0, np.int64)]
        right = [np.zeros(0, np.int64)]
        place = np.arange(len(shingle))
        end = np.repeat(head + size, size)
        for gap in range(1, join.long_list):  # members of short lists with the member `gap` further on
            i = place[(each > gap) & ~long & (place + gap < end)]
            if not len(i):
                break
            j = i + gap
            need = -(-join.percent * (n[i] + n[j]) // (100 + join.percent))
            fits = np.minimum(rest[i], rest[j]) >= need
            left.append(i[fits]), right.append(j[fits])
        i, j = np.concatenate(left), np.concatenate(right)
        a, b = np.where(sig[i] < sig[j], i, j), np.where(sig[i] < sig[j], j, i)
        k = np.flatnonzero(long)
        no, none = np.zeros(len(a), bool), np.full(len(k), None)
        cols = [np.concatenate([no, np.ones(len(k), bool)]), np.concatenate([shingle[a], shingle[k]]), np.concatenate([sig[a], sig[k]]), np.concatenate([n[a], n[k]])]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, cols), pa.array(np.concatenate([sig[b].astype(object), none]), pa.int64()), pa.array(np.concatenate([n[b].astype(object), none]), pa.int64()), pa.array(np.concatenate([rest[a], rest[k]]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 5
        for b in batches:
            now = [np.concatenate([r, b.column(k).to_numpy()]) for k, r in enumerate(rest)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield merged(*[x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if len(rest[0]):
            yield merged(*rest)

    return run


def _cross(join: Join, every: bool):
    """Pairs of two blocks of a list that are in different groups and may still link, by positions and sketches.

    Of each member the likeliest pair only, unless ``every`` is asked for.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sig, n, left, label, block = (table.column(c).to_numpy() for c in ("sig", "n", "left", "label", "block"))
        sketch = np.stack([x.values.to_numpy() for x in table.column("sketch")])
        bits = np.unpackbits(sketch.view(np.uint8), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        one, two = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        out: list[list] = [[], []]
        for lo in range(0, len(one), 1024):
            x = one[lo : lo + 1024]
            best, partner = np.full(len(x), np.inf), np.full(len(x), -1)
            for to in range(0, len(two), 1024):
                y = two[to : to + 1024]
                both = n[x][:, None] + n[y]
                need = -(-join.percent * both // (100 + join.percent))
                differ = ones[x][:, None] + ones[y] - 2 * (bits[x] @ bits[y].T)
                ok = (differ <= both - 2 * need) & (label[x][:, None] != label[y]) & (np.minimum(left[x][:, None], left[y]) >= need)
                if every:
                    if key[1] == key[2]:
                        ok &= sig[x][:, None] < sig[y]
                    i, j = np.nonzero(ok)
                    out[0].append(x[i]), out[1].append(y[j])
                    continue
                worth = np.where(ok, differ / np.maximum(both - 2 * need, 1), np.inf)
                j = worth.argmin(axis=1)
                nearer = worth[np.arange(len(x)), j] < best
                best[nearer], partner[nearer] = worth[np.arange(len(x)), j][nearer], y[j[nearer]]
            out[0].append(x[partner >= 0]), out[1].append(partner[partner >= 0])
        i, j = (np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out)
        return pa.table({"a": sig[i], "na": n[i], "b": sig[j], "nb": n[j]})

    return run


def _probe(join: Join):
    """Look up each shingle of the smaller set in the larger by binary search, and keep pairs with the required overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("xa"), b.column("xb")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                ok.append(100 * common >= join.percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _blobs(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            sets = shingle_sets(b.column("text"), join.width)
            # an id may have several texts: the one meant has this signature
            out = pa.RecordBatch.from_arrays([b.column("sig"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "shingles"])
            yield out.filter(pa.array([len(s) > 0 and _signature(s) == k for s, k in zip(sets, b.column("sig").to_pylist())]))

    return run


class _Verifier:
    """Tells which candidate pairs link; sets are fetched from the texts for the candidates only."""

    def __init__(self, join: Join, messages: DataFrame, sets: DataFrame):
        self.join, self.messages, self.sets = join, messages, sets
        self.sketches = sets.select("sig", "sketch").where("sig is not null").dropDuplicates(["sig"])
        self.blobs: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those whose sketches do not rule out the required overlap."""
        side = lambda x: self.sketches.select(F.col("sig").alias(x), F.col("sketch").alias("s" + x))
        differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n.cast("int"))
        both = F.col("na") + F.col("nb")
        need = F.ceil(self.join.percent * both / (100 + self.join.percent))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= both - 2 * need).select("a", "na", "b", "nb")

    def fetch(self, members: DataFrame) -> None:
        """Keep the sets of ``members (sig)``."""
        one = self.sets.where("sig is not null").groupBy("sig").agg(F.min("message_id").alias("message_id")).join(members, "sig", "left_semi")
        texts = self.messages.join(one.hint("shuffle_hash"), "message_id").select("sig", "text")
        self.blobs = written(texts.mapInArrow(B.tidy(_blobs(self.join)), "sig bigint, shingles binary").dropDuplicates(["sig"]), "shingles")

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.blobs.select(F.col("sig").alias(x), F.col("shingles").alias("x" + x))
        probed = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(B.tidy(_probe(self.join)), "a bigint, b bigint, linked boolean")
        return written(probed, "probed")


def join_messages(messages: DataFrame, join: Join = Join(), hub_rounds: int = 2, near_rounds: int = 3, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """Groups of messages whose word shingles are similar, directly or by way of others.

    A-Z is taken in lower case; words end at ASCII white space. A message's set
    holds its distinct runs of ``width`` words; one of fewer words has them all
    as its only shingle, one without words (or text) has none and links with
    nothing. Two messages link when 100 times the common shingles are at least
    ``percent`` times those of either. Shingles and sets are compared by 64-bit
    hashes. Returns ``message_id, n_shingles, component_id`` (the smallest
    message id reachable by links) per input row; messages without an id are
    left out, a repeated row is repeated.

    The search is a prefix filter that takes long lists last; it counts no
    occurrences over merged lists, for that would post every shingle:

    * Every distinct set searches its shortest inverted lists: all its lists
      but the required overlap less one. Which shingles have long lists (more
      than ``long_list`` sets) is counted over all messages beforehand, so they
      come last and are searched only by sets made of little else.
    * Short lists are merged, sorted by shingle, into candidate pairs. Pairs
      are dropped when their sizes or the parities of their sketches rule out
      the required overlap; for the others, the whole sets are intersected by
      binary search.
    * In lists that are long all the same, members are first compared with one
      of them (a hub), ``hub_rounds`` times with another hub. Members that are
      not yet in one group are then compared with each other by sketches, block
      by block: ``near_rounds`` times each with its likeliest partner in
      another group, which at least halves the groups that hold together; at
      last all pairs of members still in different groups are verified.

    Copies of one set count once. Long lists are salted by their counted
    length, so no list, however common, is gathered in one task; all members
    of a salted list take the way of the long ones.
    """
    spark = messages.sparkSession
    m = narrow(messages, message_id=message_id, text=text).where(F.col("message_id").isNotNull())
    m = m.withColumn("text", F.coalesce("text", F.lit("")))
    kind = m.schema["message_id"].dataType.simpleString()
    sets = written(m.mapInArrow(B.tidy(_sets(join)), f"message_id {kind}, n bigint, sig bigint, sketch array<bigint>"), "sets")
    verifier = _Verifier(join, m, sets)

    lengths = m.select("text").mapInArrow(B.tidy(_list_lengths(join)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    long = most_frequent(written(lengths.where(F.col("n") > join.long_list), "long-lists"), "n", MOST_LONG)
    known = np.sort(np.array([r[0] for r in long.select("shingle").collect()], np.int64).view(_U))
    shared = spark.sparkContext.broadcast(known)
    postings = m.select("text").mapInArrow(B.tidy(_postings(join, shared)), "shingle bigint, sig bigint, n bigint, left bigint")
    salts = F.when(F.col("length") > SALT_ROWS, 1 + F.pmod("sig", F.ceil(F.col("length") / SALT_ROWS))).otherwise(0).cast("bigint")
    salted = postings.join(F.broadcast(long.select("shingle", F.col("n").alias("length"))), "shingle", "left").select("shingle", F.coalesce(salts, F.lit(0)).alias("salt"), "sig", "n", "left")
    lists = salted.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "sig")
    found = written(lists.select("shingle", "salt", "sig", "n", "left").mapInArrow(B.tidy(_merge_lists(join)), "long boolean, shingle bigint, a bigint, na bigint, b bigint, nb bigint, left bigint"), "candidates")
    pairs = written(verifier.near(found.where("not long").select("a", "na", "b", "nb").distinct()), "near")
    rest = written(found.where("long").select("shingle", F.col("a").alias("sig"), F.col("na").alias("n"), "left").distinct(), "members")
    discard(found)
    verifier.fetch(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(rest.select("sig")).distinct())
    probed = verifier.links(pairs)

    discard(pairs)
    lists: DataFrame | None = None

    def labelled() -> DataFrame:
        groups = components(probed.where("linked"))
        now = written(rest.join(groups.withColumnRenamed("id", "sig"), "sig", "left").select("shingle", "sig", "n", "left", F.coalesce("component", "sig").alias("label")), "long-lists")
        discard(*([] if lists is None else [lists]), *([groups] if hasattr(groups, "_step") else []))
        return now

    def fits(x: str, y: str):
        return 100 * F.least(x, y) >= join.percent * F.greatest(x, y)

    def compare(now: DataFrame) -> DataFrame:
        """Probe pairs ``a, na, b, nb`` that have not been."""
        ordered = now.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                             F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        new = ordered.distinct().join(probed.select("a", "b"), ["a", "b"], "left_anti")
        return probed.unionByName(verifier.links(verifier.near(new)))

    if not is_empty(rest):
        for k in range(hub_rounds):
            lists = labelled()
            band = F.floor(F.log(F.col("n")) / np.log(100 / join.percent) + F.lit(0.5 * (k % 2)))
            banded = lists.withColumn("band", band)
            hub = banded.groupBy("shingle", "band").agg(F.min_by(F.struct("sig", "n", "label"), F.xxhash64("sig", F.lit(k))).alias("hub"))
            near = banded.join(hub, ["shingle", "band"]).where((F.col("label") != F.col("hub.label")) & fits("n", "hub.n"))
            probed = compare(near.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("hub.sig").alias("b"), F.col("hub.n").alias("nb")))
        for k in range(near_rounds + 1):
            lists = labelled()
            mixed = lists.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")).where("l <> h").select("shingle", "blocks")
            block = F.pmod("sig", F.col("blocks")).alias("block")
            dealt = lists.join(mixed, "shingle").join(verifier.sketches, "sig").select("shingle", block, "sig", "n", "left", "label", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
            dealt = dealt.withColumns({"i": F.least("block", "with").cast("bigint"), "j": F.greatest("block", "with").cast("bigint")}).drop("with")
            cross = dealt.groupBy("shingle", "i", "j").applyInArrow(_cross(join, k == near_rounds), "a bigint, na bigint, b bigint, nb bigint")
            cross = written(cross.distinct(), "near")
            done = is_empty(cross)
            probed = probed if done else compare(cross)
            discard(cross)
            if done:
                break
        discard(lists)

    groups = components(probed.where("linked"))
    smallest = sets.where("sig is not null").groupBy("sig").agg(F.min("message_id").alias("first"))
    named = smallest.join(groups.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = named.select("sig", "component").join(least, "component").select("sig", "component_id")
    out = sets.select("message_id", "n", "sig").join(of_set, "sig", "left")
    return out.select(F.col("message_id").alias(message_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "message_id").alias("component_id"))
