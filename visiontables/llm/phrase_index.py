"""Collocations of message logs: phrases counted by a bidirectional FM-index per shard."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiontables.llm import textbytes as B
from visiontables.llm.tables import discard, salted_lookup, written
from visiontables.operators.numbering import position_in_order

LEAST = 10
TOP = 2000
WITHIN = 50
SHARD_BYTES = 6 << 20
SALTS = 64
NO_ROLE = "und"

_b = np.arange(256)
_BREAK = np.isin(_b, [ord(c) for c in ".,;:!?"]) | ((_b >= 0x0A) & (_b <= 0x0D))
_IN_WORD = ~(_BREAK | (_b == 0x20) | (_b == 0x09))
_LOWER = _b.astype(np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class ShardIndex:
    """FM-index of word ids in both directions, for phrases of up to three words.

    ``seq`` holds ids from 1 on, and 0 between pieces. Rotations are sorted by
    their first three words, which settles every interval of a phrase that
    short. An interval is a phrase's range of rotations of the sequence
    (``lo``), its range of rotations of the reversed one (``rlo``) and its
    ``size``; extending it by a word to one side takes a step in one index and
    narrows the range in the other.
    """

    def __init__(self, seq: np.ndarray, reverse: bool = True):
        seq = np.concatenate([seq, np.zeros(3, seq.dtype)]).astype(np.int64)
        self.n, self.words = len(seq), int(seq.max()) + 1
        count = np.bincount(seq, minlength=self.words)
        self.size, self.lo = count, np.cumsum(count) - count
        self.left = self._bwt(seq)
        self.right = self._bwt(seq[::-1]) if reverse else None

    def _bwt(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each sorted rotation, and all (word, row) pairs in order, which count a word's rows before any."""
        second, third = np.roll(s, -1), np.roll(s, -2)
        bits = max(1, int(self.words).bit_length())
        if 3 * bits <= 63:
            order = np.argsort((s << (2 * bits)) | (second << bits) | third, kind="stable")
        else:
            order = np.lexsort((third, second, s))
        bwt = np.roll(s, 1)[order]
        return bwt, np.sort(bwt * self.n + np.arange(self.n))

    def word(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.lo[ids], self.lo[ids], self.size[ids]

    def _extend(self, bwt: np.ndarray, occ: np.ndarray, lo: np.ndarray, rlo: np.ndarray, size: np.ndarray):
        """All extensions by a word: which interval, which word, and the new intervals."""
        owner = np.repeat(np.arange(len(size)), size)
        code, count = np.unique(owner * self.words + bwt[B.ragged(lo, size)], return_counts=True)
        which, word = np.divmod(code, self.words)
        smaller = np.cumsum(count) - count - (np.cumsum(size) - size)[which]
        stepped = np.searchsorted(occ, word * self.n + lo[which])
        real = word > 0
        return which[real], word[real], stepped[real], (rlo[which] + smaller)[real], count[real]

    def extend_left(self, lo: np.ndarray, rlo: np.ndarray, size: np.ndarray):
        which, word, lo, rlo, size = self._extend(*self.left, lo, rlo, size)
        return which, word, lo, rlo, size

    def extend_right(self, lo: np.ndarray, rlo: np.ndarray, size: np.ndarray):
        which, word, rlo, lo, size = self._extend(*self.right, rlo, lo, size)
        return which, word, lo, rlo, size

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrases of two words and their counts."""
        ids = np.flatnonzero(self.size > 0)
        ids = ids[ids > 0]
        which, first, _, _, size = self.extend_left(*self.word(ids))
        return first, ids[which], size

    def triples(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All phrases of three words whose both pairs are among the given ones, and their counts."""
        known = np.sort(first * self.words + second)
        among = lambda x: known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
        ids = np.unique(second)
        which, a, lo, rlo, size = self.extend_left(*self.word(ids))
        b = ids[which]
        kept = among(a * self.words + b)
        a, b = a[kept], b[kept]
        which, c, _, _, size = self.extend_right(lo[kept], rlo[kept], size[kept])
        kept = among(b[which] * self.words + c)
        return a[which][kept], b[which][kept], c[kept], size[kept]


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Slices of about ``most`` bytes of text, across batches."""
    held, size = [], 0
    for b in B.slices(batches, "text", most):
        n = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if held and size + n > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


_SHARD = pa.schema([("seq", pa.binary()), ("roles", pa.list_(pa.string())), ("role", pa.list_(pa.int32())), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, most):
            buf, bounds = B.flat(table.column("text").combine_chunks())
            start, end, first = B.words(buf, bounds, _IN_WORD)
            if not len(start):
                continue
            row = B.row_of(first)
            breaks = np.searchsorted(np.flatnonzero(_BREAK[buf]), start)
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(breaks) > 0) | (np.diff(row) > 0)
            del breaks
            edges = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
            letters = _LOWER[buf[_IN_WORD[buf]]]
            size = len(start)
            del start, end
            text = pa.StringArray.from_buffers(size, pa.py_buffer(edges), pa.py_buffer(letters)).dictionary_encode()
            roles = table.column("role").combine_chunks().dictionary_encode()
            of = roles.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            code, word, n = np.unique(of * len(text.dictionary) + text.indices.to_numpy(), return_inverse=True, return_counts=True)
            which, what = np.divmod(code, len(text.dictionary))
            seq = np.zeros(size + int(new.sum()), np.int32)
            seq[np.arange(size) + np.cumsum(new)] = word + 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_squeezed(seq)], pa.binary()), one(roles.dictionary), one(pa.array(which, pa.int32())), one(text.dictionary.take(pa.array(what))), one(pa.array(n, pa.int64()))], schema=_SHARD)

    return run


def _squeezed(seq: np.ndarray) -> bytes:
    """A sequence with the bytes of all numbers' same places side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4).T).tobytes())


def _sequence(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def _frequent(shard: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shard's sequence over its frequent words, numbered by their ids, and those ids; rare words part pieces."""
    seq = _sequence(shard.column("seq")[0].as_py())
    local, gid = (words.column(c).to_numpy() for c in ("local", "gid"))
    gid_sorted = np.unique(gid)
    number = np.zeros(int(seq.max()) + 2, np.int64)
    number[local] = np.searchsorted(gid_sorted, gid) + 1
    return number[seq], np.concatenate([[-1], gid_sorted])


def _pairs(shard: pa.Table, words: pa.Table) -> pa.Table:
    if not (len(shard) and len(words)):
        return _PAIRS.empty_table()
    seq, gid = _frequent(shard, words)
    a, b, n = ShardIndex(seq, reverse=False).pairs()
    where = np.full(len(a), shard.column("shard")[0].as_py())
    return pa.table([gid[a], gid[b], where, n], schema=_PAIRS)


_PAIRS = pa.schema([(c, pa.int64()) for c in ("g1", "g2", "shard", "n")])
_TRIPLES = pa.schema([(c, pa.int64()) for c in ("g1", "g2", "g3", "n")])


def _triples(shard: pa.Table, known: pa.Table) -> pa.Table:
    """``known`` holds the shard's frequent words (local id, id) and its frequent pairs (first id less than 0, second)."""
    is_word = pc.greater(known.column("x"), 0)
    words, pairs = known.filter(is_word), known.filter(pc.invert(is_word))
    if not (len(shard) and len(words) and len(pairs)):
        return _TRIPLES.empty_table()
    seq, gid = _frequent(shard, words.rename_columns(["shard", "local", "gid"]))
    a, b, c, n = ShardIndex(seq).triples(np.searchsorted(gid, -pairs.column("x").to_numpy()), np.searchsorted(gid, pairs.column("y").to_numpy()))
    return pa.table([gid[a], gid[b], gid[c], n], schema=_TRIPLES)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} bigint" for f in schema)


def mine_phrases(
    messages: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN, shard_bytes: int = SHARD_BYTES,
    role: str = "role", text: str = "text",
) -> DataFrame:
    """The phrases of two or three words that stick together most, for every role of a message log.

    Texts (A-Z in lower case) are split at ``.,;:!?`` and line ends into
    pieces, and those at blanks and tabs into words; everything is counted per
    ``role`` (null: ``und``). Candidates are phrases found at least ``least``
    times. Cut after k words into parts found l and r times, a candidate found
    a times scores floor(1000000 a a / (l r)); its lowest cut counts, ties to
    the smallest k. A candidate inside a longer one that is found at least
    ``within`` of 100 times as often is dropped. Returns each role's ``top`` by
    score, then a, then phrase in byte order: ``role, rank, phrase, a, l, r, n,
    score`` (n: all words of the role). A null or wordless text has no words,
    repeated messages count each, other columns are ignored; without words the
    result is empty.

    Shards are slices of the input of about ``shard_bytes`` of text (a single
    longer text is a shard of its own), written once as word ids. A shard's
    FM-index extends phrases by a word; its counts are summed over shards. A
    phrase can be frequent only if its parts are, so rare words part pieces,
    and only pairs frequent over all shards are extended to triples. Sums are
    grouped by phrase, of which a shard holds one row; words of many phrases
    are looked up by salted keys. Nothing is broadcast or brought to the driver.
    """
    m = messages.select(F.coalesce(messages[role], F.lit(NO_ROLE)).alias("role"), messages[text].alias("text")).where("text is not null")
    shards = m.mapInArrow(B.tidy(_shards(shard_bytes)), "seq binary, roles array<string>, role array<int>, word array<string>, n array<bigint>")
    shards = written(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")

    # words: summed over shards, those frequent enough numbered from the most frequent on
    held = shards.select("shard", "roles", F.posexplode(F.arrays_zip("role", "word", "n")).alias("local", "w"))
    held = held.select("shard", (F.col("local") + 1).alias("local"), F.get("roles", "w.role").alias("role"), "w.word", "w.n")
    every = held.groupBy("role", "word").agg(F.sum("n").alias("f"))
    every = written(every, "words")
    totals = written(every.groupBy("role").agg(F.sum("f").alias("n")), "totals")
    words = position_in_order(every.where(F.col("f") >= least), [], [F.desc("f"), F.asc("role"), F.asc("word")], "gid")
    words = written(words.select("gid", "role", "word", "f"), "frequent-words")
    discard(every)
    local = written(held.select("shard", "local", "role", "word").join(words.select("role", "word", "gid"), ["role", "word"]).select("shard", "local", "gid"), "shard-words")

    # pairs: counted per shard, kept where frequent over all
    sequences = shards.select("shard", "seq")
    pairs = sequences.groupBy("shard").cogroup(local.groupBy("shard")).applyInArrow(_pairs, _ddl(_PAIRS))
    # one number per pair: rows sort by it alone
    base = words.count() + 1
    wide = "bigint" if base < 1 << 31 else "decimal(38,0)"
    number = (F.col("g1").cast(wide) * F.lit(base).cast(wide) + F.col("g2")).cast(wide)
    found = pairs.select(number.alias("pair"), "shard", "n").withColumn("a", F.sum("n").over(Window.partitionBy("pair"))).where(F.col("a") >= least)
    ends = [F.call_function("div", F.col("pair"), F.lit(base).cast(wide)).alias("g1"), (F.col("pair") % F.lit(base).cast(wide)).cast("bigint").alias("g2")]
    found = written(found.select(*ends, "shard", "a"), "pairs")
    pair = written(found.groupBy("g1", "g2").agg(F.first("a").alias("a")), "pair-counts")

    # triples: extensions of those pairs
    known = local.select("shard", F.col("local").cast("bigint").alias("x"), F.col("gid").alias("y")).unionByName(
        found.select("shard", (-F.col("g1")).alias("x"), F.col("g2").alias("y")))
    triples = sequences.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_triples, _ddl(_TRIPLES))
    triple = written(triples.groupBy("g1", "g2", "g3").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "triples")
    discard(shards, local, found)

    inside = triple.select("g1", "g2", "a").unionByName(triple.select(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a"))
    inside = inside.groupBy("g1", "g2").agg(F.max("a").alias("longest"))
    kept = pair.join(inside, ["g1", "g2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < within * F.col("a"))).drop("longest")

    def looked(df: DataFrame, gid: str, suffix: str) -> DataFrame:
        return salted_lookup(df, [gid], words.select(F.col("gid").alias(gid), F.col("word").alias(f"w{suffix}"), F.col("f").alias(f"f{suffix}"), F.col("role").alias(f"role{suffix}")), SALTS)

    two = looked(looked(kept, "g1", "1"), "g2", "2")
    two = two.select(F.col("role1").alias("role"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    head, tail = pair.select("g1", "g2", F.col("a").alias("f12")), pair.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("f23"))
    three = salted_lookup(salted_lookup(triple, ["g1", "g2"], head, SALTS), ["g2", "g3"], tail, SALTS)
    three = looked(looked(looked(three, "g1", "1"), "g2", "2"), "g3", "3")
    three = three.select(F.col("role1").alias("role"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array(
        F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"))).alias("cuts"))
    exact = lambda c: c.cast("decimal(38,0)")
    product = lambda *cs: functools.reduce(lambda x, y: x * y, map(exact, cs)).cast("decimal(38,0)")
    score = lambda x: F.call_function("div", product(F.lit(1_000_000), F.col("a"), F.col("a")), product(x["l"], x["r"]))
    scored = F.transform("cuts", lambda x, k: F.struct(score(x).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    rated = two.unionByName(three).select("role", "phrase", "a", F.array_min(scored).alias("cut"))
    rated = rated.select("role", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("role", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*by)
    best = rated.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(*by)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "role").select("role", "rank", "phrase", "a", "l", "r", "n", "score")
