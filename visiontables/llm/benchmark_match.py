"""Passages of evaluation phrases within message logs (benchmark decontamination)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm import textbytes as B
from visiontables.llm.tables import narrow, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
_LANES = 8192
_U = np.uint64
_ROW = "message_id bigint, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<bigint>"


class Patterns:
    """Wu-Manber tables over the windows of ``size`` words of a block of phrases.

    The alphabet is words (by hash) and a block is two words, one for windows
    of a single word. ``shift`` tells for each hashed block how far the window
    end may move; where it is 0, the exact block leads to the windows that end
    in it (``suffix``, sorted), and those are compared word by word.
    """

    def __init__(self, size: int, windows: np.ndarray, items: np.ndarray, texts: list[list[bytes]]):
        self.size, self.block = size, min(2, size)
        self.windows, self.items, self.texts = windows, items, texts
        self.bits = min(22, max(10, int(np.ceil(np.log2(16 * size * max(1, len(windows)))))))
        self.shift = np.full(1 << self.bits, size - self.block + 1, dtype=np.uint8)
        for end in range(self.block - 1, size):
            at = self.slot(self.blocks(windows[:, end], windows[:, end - 1]))
            np.minimum.at(self.shift, at, np.uint8(size - 1 - end))
        last = self.blocks(windows[:, size - 1], windows[:, size - 2] if size > 1 else windows[:, 0])
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def blocks(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return B.mix(word) if self.block == 1 else B.mix(word * _U(3) + before * _U(0x9E3779B97F4A7C15))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> _U(64 - self.bits)).astype(np.int64)

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start in the words ``w``, and which windows.

        Many stretches of the text are searched side by side, each with its own
        position that jumps by the shift table.
        """
        m, n = self.size, len(w)
        if n < m or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.linspace(m - 1, n, min(_LANES, n - m + 1) + 1).astype(np.int64)
        at, to = cut[:-1].copy(), cut[1:]
        found = []
        while len(at):
            block = self.blocks(w[at], w[at - 1] if m > 1 else w[at])
            skip = self.shift[self.slot(block)]
            zero = skip == 0
            if zero.any():
                found.append((at[zero], block[zero]))
            at = at + np.maximum(skip, 1)
            live = at < to
            at, to = at[live], to[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, block = (np.concatenate(x) for x in zip(*found))
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        begin = np.repeat(end - m + 1, hi - lo)
        which = self.order[B.ragged(lo, hi - lo)]
        same = np.ones(len(begin), bool)
        for j in range(m):
            live = np.flatnonzero(same)
            same[live] = w[begin[live] + j] == self.windows[which[live], j]
        return begin[same], which[same]


def tables(rows: list[tuple[int | None, str]], window: int) -> tuple[list[Patterns], list[int | None]]:
    """Tables per window length for phrases ``(item_id, text)``; shorter phrases are one window each."""
    ids = [r[0] for r in rows]
    buf, bounds = B.flat(pa.array([r[1] for r in rows], type=pa.string()))
    start, end, first = B.words(buf, bounds, B.ALNUM)
    h = B.word_hashes(buf, start, end)
    raw = bytes(buf)
    seen: set[tuple] = set()
    kept: dict[int, tuple[list, list, list]] = {}
    for i in range(len(rows)):
        n = int(first[i + 1] - first[i])
        m = min(window, n)
        for s in range(first[i], first[i + 1] - m + 1) if m else ():
            text = [raw[a:b].lower() for a, b in zip(start[s : s + m], end[s : s + m])]
            if (i, *text) not in seen:
                seen.add((i, *text))
                a, b, c = kept.setdefault(m, ([], [], []))
                a.append(h[s : s + m]), b.append(i), c.append(text)
    return [Patterns(m, np.array(a), np.array(b), c) for m, (a, b, c) in sorted(kept.items())], ids


def _mark(patterns: list[Patterns], ids: list[int | None], numbered: bool = False):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("message_id", pa.int64()), ("n_words", pa.int64()), ("hits", span), ("items", pa.list_(pa.int64()))] + [("row", pa.int64())] * numbered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            buf, bounds = B.flat(b.column("text"))
            start, end, first = B.words(buf, bounds, B.ALNUM)
            rows = len(first) - 1
            # one word that no phrase has stands between texts
            place = np.arange(len(start)) + B.row_of(first)
            w = np.zeros(len(start) + rows, dtype=_U)
            w[place] = B.word_hashes(buf, start, end)
            back = np.full(len(w), -1, dtype=np.int64)
            back[place] = np.arange(len(start))
            hits: list[dict[int, set]] = [{} for _ in range(rows)]
            for p in patterns:
                for begin, which in zip(*p.search(w)):
                    k = back[begin : begin + p.size]
                    if (k < 0).any():
                        continue
                    if any(bytes(buf[start[i] : end[i]]).lower() != t for i, t in zip(k, p.texts[which])):
                        continue
                    row = int(np.searchsorted(first, k[0], side="right")) - 1
                    hits[row].setdefault(int(p.items[which]), set()).add((int(k[0] - first[row]), int(k[0] - first[row]) + p.size))
            spans = [_joined(sorted(set().union(*h.values()))) if h else [] for h in hits]
            items = [sorted(ids[i] for i in h if ids[i] is not None) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [b.column("message_id"), pa.array(np.diff(first), pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.int64()))] + ([b.column("row")] if numbered else []),
                schema=schema,
            )

    return run


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in spans:
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.udf(_SPANS)
def _merged(groups):
    return _joined(sorted((s["start"], s["end"]) for g in groups for s in g))


def mark_phrases(
    messages: DataFrame, annotations: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    message_id: str = "message_id", text: str = "text", item_id: str = "item_id", noun_phrase: str = "noun_phrase",
) -> DataFrame:
    """Mark the words of messages that lie in a passage of an evaluation phrase.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with
    A-Z in lower case. A passage is ``window`` consecutive words of a phrase; a
    shorter phrase is one passage. Returns per message ``message_id, n_words,
    hits`` (``array<struct<start, end>>``, merged runs of hit words, by word
    number) and ``items`` (ids of the phrases found, ascending).

    A null or wordless text has no words; a null or wordless phrase none to
    find. A phrase without id hits but is not listed. Repeated messages keep a
    row each, repeated items count once. Other columns are ignored.

    Messages are searched where they are read, without a shuffle. The phrases
    are dealt into blocks of about ``block_bytes`` of text, whatever their
    number; each block is one pass, so tables in memory stay bounded.
    """
    m = narrow(messages, message_id=message_id, text=text).withColumn("message_id", F.col("message_id").cast("bigint"))
    blocks = _blocks(annotations, window, block_bytes, item_id, noun_phrase)
    if len(blocks) > 1:
        m = written(m.withColumn("row", F.monotonically_increasing_id()), "messages")
    passes = [_pass(m, patterns, ids) for patterns, ids in blocks]
    out = passes[0] if len(blocks) == 1 else _combined(passes)
    return out.withColumnRenamed("message_id", message_id)


def _pass(m: DataFrame, patterns: list[Patterns], ids: list[int | None]) -> DataFrame:
    kind = "" if "row" not in m.columns else ", row bigint"
    return m.mapInArrow(B.tidy(_mark(patterns, ids, bool(kind))), _ROW + kind)


def _combined(passes: list[DataFrame]) -> DataFrame:
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)
    g = rows.groupBy("row").agg(
        F.first("message_id").alias("message_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("h"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return g.select("message_id", "n_words", _merged("h").alias("hits"), "items")


def keep_clean(messages: DataFrame, annotations: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id", noun_phrase: str = "noun_phrase") -> DataFrame:
    """The rows of ``messages`` without any passage of an evaluation phrase (see ``mark_phrases``), all columns as they were."""

    def clean(patterns: list[Patterns]):
        mark = _mark(patterns, [0] * (1 + max((int(p.items.max()) for p in patterns), default=0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in B.slices(batches, text, 1 << 20):
                bare = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(text)], names=["message_id", "text"])
                hit = np.concatenate([np.diff(x.column("hits").offsets.to_numpy()) > 0 for x in mark(iter([bare]))])
                yield b.filter(pa.array(~hit))

        return run

    out = messages
    for patterns, _ in _blocks(annotations, window, block_bytes, item_id, noun_phrase):
        out = out.mapInArrow(B.tidy(clean(patterns)), messages.schema)
    return out


def _blocks(annotations: DataFrame, window: int, block_bytes: int, item_id: str, noun_phrase: str) -> list[tuple[list[Patterns], list[int | None]]]:
    """Tables of each block of phrases; the number of blocks follows the phrases' bytes."""
    items = narrow(annotations, item_id=item_id, text=noun_phrase).where(F.col("text").isNotNull()).withColumn("item_id", F.col("item_id").cast("bigint"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    of_block = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().toLocalIterator()
    return [tables([(r[0], r[1]) for r in of_block(k)], window) for k in range(blocks)]
