"""Token ids of message logs in Simple-8b files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.llm import bpe
from visiontables.llm import textbytes as B
from visiontables.llm.tables import narrow

END = 1
BLOCK_IDS = 2048
# Ids per word and bits per id of the word's 4-bit selector. Selector 15 is the escape for one id of any
# size; 0 and 1 are not used.
COUNT = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_SEGMENT = "file bigint, segment bigint, n_ids bigint, ranks binary, offsets binary, words binary, message_ids binary, null_ids binary, sizes binary"
_READ = "message_id bigint, start bigint, n_tokens bigint, ids binary"


def pack_words(values: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``values`` (below 2**60), and the first word of each block (one more at the end).

    Each word takes as many of the next values as fit; blocks are packed side
    by side. The last word of a block may be filled up with zeros.
    """
    n = len(values)
    rows = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    wide = np.zeros((rows, block + 60), dtype=np.uint32 if int(values.max()) < 1 << 32 else np.uint64)
    size = np.minimum(block, n - np.arange(rows) * block)
    wide[np.repeat(np.arange(rows), size), B.ragged(np.zeros(rows, np.int64), size)] = values
    # the narrowest selector each value fits, then for each selector where the values of a whole word fit
    need = np.full(wide.shape, 2, dtype=np.int8)
    for b in BITS[2:15]:
        need += wide > (1 << int(b)) - 1
    select = np.full(wide.size, 15, dtype=np.int8)
    need = need.ravel()
    for s in range(14, 1, -1):
        fit, width = need <= s, 1
        while 2 * width <= COUNT[s]:
            fit[:-width] &= fit[width:]
            fit[-width:] = False
            width *= 2
        more = int(COUNT[s]) - width
        if more:
            fit[:-more] &= fit[more:]
            fit[-more:] = False
        select[fit] = s
    select = select.reshape(wide.shape)
    live, at = np.arange(rows), np.zeros(rows, np.int64)
    taken = []
    while len(live):
        taken.append((live, at))
        at = at + COUNT[select[live, at]]
        more = at < size[live]
        live, at = live[more], at[more]
    row, at = (np.concatenate(x) for x in zip(*taken))
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    chosen = select[row, at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        k = np.flatnonzero(chosen == s)
        for j in range(COUNT[s]):
            words[k] |= wide[row[k], at[k] + j].astype(np.uint64) << np.uint64(j * BITS[s])
    return words, np.searchsorted(row, np.arange(rows + 1))


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The values of all blocks; words of one selector are decoded together."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[chosen]
    total = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begin = total[:-1] - total[offsets[row]] + row * block
    end = np.minimum((row + 1) * block, n)
    for s in np.unique(chosen):
        k = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s]):
            ok = k[begin[k] + j < end[k]]
            out[begin[ok] + j] = (words[ok] >> np.uint64(j * BITS[s])) & mask
    return out


def _write(vocabulary: str, end: int):
    kinds = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64())] + [(x, pa.binary()) for x in ("ranks", "offsets", "words", "message_ids", "null_ids", "sizes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, coder = TaskContext.get().partitionId(), bpe.encoder(vocabulary)
        for segment, b in enumerate(B.slices(batches)):
            ids, first = coder.encode(bpe.texts_of(b.column("text")), end)
            # ids by falling frequency: frequent ones take few bits
            n = np.bincount(ids)
            order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
            rank = np.zeros(len(n), np.uint32)
            rank[order] = np.arange(len(order))
            words, offsets = pack_words(rank[ids])
            m = b.column("message_id")
            parts = (order.astype("<u4"), offsets.astype("<i8"), words.astype("<u8"),
                     m.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), m.is_null().to_numpy(zero_copy_only=False), np.diff(first).astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, segment, len(ids), *(p.tobytes() for p in parts)), kinds)], schema=kinds)

    return run


def write_token_files(messages: DataFrame, path: str, vocabulary: str, end: int = END, message_id: str = "message_id", text: str = "text") -> None:
    """Encode every whole text and write all ids, in ascending message order, as Simple-8b files.

    ``vocabulary`` is the tokenizer file (never copied). A null text is empty;
    ``end`` follows each text. Rows are range-partitioned by ``message_id``
    (nulls first; equal ids by text), so each file holds the next stretch of
    the order. Files are Parquet with one row per segment of some MB of text:
    ``words`` are the 64-bit words of the ids' frequency ranks, ``ranks`` turns
    ranks into ids, ``offsets`` is the first word of each block of
    ``BLOCK_IDS`` ids, and ``message_ids``, ``null_ids`` and ``sizes`` tell the
    messages apart. Other columns are ignored; without rows no segment is
    written.
    """
    m = narrow(messages, message_id=message_id, text=text).withColumn("message_id", F.col("message_id").cast("bigint"))
    ordered = m.repartitionByRange("message_id").sortWithinPartitions("message_id", "text")
    ordered.mapInArrow(_write(vocabulary, end), _SEGMENT).write.parquet(path)


def _read(starts: dict[int, int]):
    kinds = pa.schema([("message_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["sizes"], "<i8")
                rank = unpack_words(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<i8"), r["n_ids"])
                ids = np.frombuffer(r["ranks"], "<u4")[rank.astype(np.int64)]
                edge = np.concatenate([[0], np.cumsum(sizes)])
                start = starts[r["file"], r["segment"]] + edge[:-1]
                data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((edge * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                who = pa.array(np.frombuffer(r["message_ids"], "<i8"), mask=np.frombuffer(r["null_ids"], bool))
                yield pa.RecordBatch.from_arrays([who, pa.array(start), pa.array(sizes), data], schema=kinds)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Messages as the files at ``path`` hold them: ``message_id, start, n_tokens, ids``.

    ``start`` counts the ids of all messages before it, ``ids`` are
    little-endian unsigned 32-bit integers. Only the size of each segment comes
    to the driver: 16 bytes for some MB of text.
    """
    table = spark.read.schema(_SEGMENT).parquet(path)
    starts, at = {}, 0
    for file, segment, n in sorted(tuple(r) for r in table.select("file", "segment", "n_ids").collect()):
        starts[file, segment] = at
        at += n
    return table.mapInArrow(_read(starts), _READ)
