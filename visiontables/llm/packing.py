"""Training sequences of tokenized messages: hierarchical best-fit packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.llm import bpe
from visiontables.llm import textbytes as B
from visiontables.llm.tables import narrow, written

CAPACITY = 2048
END = 0
GROUP_ITEMS = 16_384
NEARLY_FULL = 0.995
_PIECE = "message_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_FIELDS = ("message_id", "piece", "start", "length", "ids_crc32")
_MEMBER = "array<struct<message_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
_BIN = f"done boolean, sequence_id bigint, fill bigint, members {_MEMBER}"


def _cut(vocabulary: str, end: int, capacity: int):
    kinds = pa.schema([("message_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(vocabulary)
        for b in B.slices(batches):
            ids, first = coder.encode(bpe.texts_of(b.column("text")), end)
            n = np.diff(first)
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = B.ragged(np.zeros(len(n), np.int64), parts)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at = first[row] + start
            crc = [bpe.crc32(ids[a : a + k]) for a, k in zip(at, length)]
            yield pa.RecordBatch.from_arrays(
                [b.column("message_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=kinds)

    return run


def cut_messages(messages: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """Token pieces of every whole text: ``message_id, piece, start, length, ids_crc32``.

    A text's ids end with ``end`` (a null text is empty and has only that).
    Messages of more than ``capacity`` ids are cut into pieces of that length,
    the last may be shorter; ``start`` is a piece's place among its message's
    ids. Other columns are ignored.
    """
    m = narrow(messages, message_id=message_id, text=text).withColumn("message_id", F.col("message_id").cast("bigint"))
    return m.mapInArrow(B.tidy(_cut(vocabulary, end, capacity), encoder=True), _PIECE)


def best_fit(length: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by falling length into the fullest bin with room.

    Bins wait in stacks by the room they have left; a bit per stack finds the
    smallest room that suffices at once.
    """
    order = np.argsort(-length, kind="stable")
    out = np.empty(len(length), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0
    for i, n in zip(order.tolist(), length[order].tolist()):
        room = open_ >> n
        if room:
            r = n + (room & -room).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                open_ ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        if r > n:
            if not stacks[r - n]:
                open_ |= 1 << (r - n)
            stacks[r - n].append(b)
    return out


def _pack(capacity: int, least: float, round_: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fill = table.column("fill").to_numpy()
        bin_ = best_fit(fill, capacity)
        order = np.argsort(bin_, kind="stable")
        lists = pa.concat_arrays(table.column("members").chunks)
        edge = lists.offsets.to_numpy().astype(np.int64)
        size = np.diff(edge)
        flat = lists.values.take(pa.array(B.ragged(edge[:-1][order], size[order])))
        # where each item begins in its bin
        before = np.cumsum(fill[order]) - fill[order]
        head = np.flatnonzero(np.diff(bin_[order], prepend=-1))
        before -= np.repeat(before[head], np.diff(np.append(head, len(order))))
        offset = flat.field("offset").to_numpy() + np.repeat(before, size[order])
        flat = pa.StructArray.from_arrays([*[flat.field(f) for f in _FIELDS], pa.array(offset)], names=[*_FIELDS, "offset"])
        n = int(bin_.max()) + 1
        count = np.bincount(bin_, weights=size, minlength=n).astype(np.int64)
        total = np.bincount(bin_, weights=fill, minlength=n).astype(np.int64)
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), flat)
        done = np.full(n, True) if last else total >= least * capacity
        group = key[0].as_py()
        ids = (np.int64(round_) << 56) + (np.int64(group) << 32) + np.arange(n)
        return pa.table({"done": done, "sequence_id": ids, "fill": total, "members": members})

    return run


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Pack pieces into few sequences of at most ``capacity`` ids.

    ``pieces`` are those of ``cut_messages``. They are dealt into groups of
    about ``group_items`` by a hash of their key, and each group is packed by
    best fit, longest first. Sequences filled to ``nearly_full`` leave; the
    others are single items of the next round, dealt into fewer groups, until
    one group holds them all or a round no longer lessens the groups.

    Adds ``sequence_id`` (unique, of no order) and ``offset`` (the place in the
    sequence, gapless from 0). No group or sequence grows with the input.
    Without pieces the result is empty.
    """
    rows = written(pieces.select(*_FIELDS).withColumn("offset", F.lit(0).cast("bigint")), "pieces")
    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    items = rows.where(F.col("length") < capacity)
    items = items.select(F.col("length").alias("fill"), F.array(F.struct(*_FIELDS, "offset")).alias("members"))
    count = items.count()
    groups, round_, done = max(1, -(-count // group_items)), 1, []
    while count:
        last = groups == 1
        packed = items.withColumn("group", F.pmod(F.xxhash64("members"), F.lit(groups))).groupBy("group").applyInArrow(_pack(capacity, nearly_full, round_, last), _BIN)
        packed = written(packed, "sequences")
        done.append(packed.where("done").select("sequence_id", "members"))
        items = packed.where("not done").select("fill", "members")
        count = 0 if last else items.count()
        fewer = max(1, -(-count // group_items))
        if count and fewer >= groups:
            done.append(packed.where("not done").select("sequence_id", "members"))
            break
        groups, round_ = fewer, round_ + 1
    out = full
    for d in done:
        out = out.unionByName(d.select("sequence_id", F.inline("members")).select(*full.columns))
    return out
