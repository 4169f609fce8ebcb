"""Masks as packs: the runs of a mask side by side in one row.

``pack`` gathers the neighbouring runs of a key within an Arrow batch, without
a shuffle: a mask whose runs lie together becomes one row, one that is strewn
about several. Packs are then shuffled instead of runs, and ``by_group`` hands
whole groups of them to numpy kernels, many groups at a time. A task holds one
Arrow batch and one group.

A pack's runs are one binary value (``coded``): the differences of neighbouring
columns, tops and heights, mostly a byte each, where their numbers would take
eight. Packs are what is shuffled and stored, so disk follows from their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.session import spread

RUNS = "_runs"
PACK = f"{RUNS} binary"
# stands for a null where packs hold none
_NONE = -(1 << 62)
# pairs of runs a kernel looks at in one go
_PAIRS = 1 << 21


def _codes(column) -> np.ndarray:
    """Equal numbers for equal values, nulls included."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _changes(table, keys: list[str]) -> np.ndarray:
    """Whether each row has other keys than the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = _codes(table.column(k))
        new[1:] |= code[1:] != code[:-1]
    return new


def kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def pack(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and, as ``_runs``, what ``coded`` makes of neighbouring runs (keys, x, ys, ye) without nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first = np.flatnonzero(_changes(b, keys))
            runs_ = coded(np.append(first, b.num_rows), *[b.column(c).to_numpy() for c in ("x", "ys", "ye")])
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(first)) for k in keys], runs_], [*keys, RUNS])

    big = [F.col(c).cast("bigint").alias(c) for c in ("x", "ys", "ye")]
    return runs.select(*keys, *big).mapInArrow(run, f"{kinds(runs, keys)}, {PACK}")


def is_packed(runs: DataFrame) -> bool:
    return RUNS in runs.columns


def most_runs() -> Column:
    """No pack has more runs than this: each takes three bytes at least."""
    return F.floor(F.octet_length(RUNS) / 3)


def unpack(packs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs (keys, x, ys, ye) of packs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, *runs = flat_runs(pa.Table.from_batches([b]))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in runs], ["x", "ys", "ye"])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.ListArray.from_arrays(ends, runs)], [*keys, "_r"])

    lists = packs.select(*keys, RUNS).mapInArrow(run, f"{kinds(packs, keys)}, _r array<struct<x:bigint,ys:bigint,ye:bigint>>")
    return lists.select(*keys, F.inline("_r"))


def join_packed(runs: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``runs`` (keys, x, ys, ye) joined by ``keys``, where packs are shuffled in place of runs."""
    place = ["x", "ys", "ye"]
    out = pack(runs.select(*keys, *[F.coalesce(F.col(c).cast("bigint"), F.lit(_NONE)).alias(c) for c in place]), keys).join(other, keys, how)
    held = [c for c in out.columns if c != RUNS]
    return unpack(out, held).select(*held, *[F.nullif(F.col(c), F.lit(_NONE)).alias(c) for c in place])


def as_packs(table: pa.Table | pa.RecordBatch, columns: list[str], row: np.ndarray, *runs: np.ndarray) -> pa.RecordBatch:
    """One pack for each row that occurs in ``row``, which is sorted, with ``columns`` of that row."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[:len(row)]
    return pa.RecordBatch.from_arrays([*[table.column(c).take(pa.array(row[first])) for c in columns], coded(np.append(first, len(row)), *runs)], [*columns, RUNS])


def each_pack(packs: DataFrame, numbers: dict[str, Column], kernel: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """``packs`` with the runs ``kernel`` makes of theirs: it gets ``row, x, ys, ye`` and a run's ``numbers``, whole ones, and keeps the order of rows.

    Packs without one of the numbers, or left without runs, are no longer there.
    """
    columns = [c for c in packs.columns if c != RUNS]
    given = packs.select("*", *[v.cast("bigint").alias(f"_{n}_") for n, v in numbers.items()])
    held = [f"_{n}_" for n in numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, x, ys, ye = flat_runs(pa.Table.from_batches([b]))
            row, x, ys, ye = kernel(row, x, ys, ye, **{n.strip("_"): b.column(n).to_numpy()[row] for n in held})
            if len(row):
                yield as_packs(b, columns, row, x, ys, ye)

    return known(given, held).mapInArrow(run, f"{kinds(packs, columns)}, {PACK}")


def by_group(packs: DataFrame, keys: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str,
             order: list[Column] = ()) -> DataFrame:
    """``kernel`` over rows with the number of their group; no group is split between calls."""
    def whole(parts: list) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                tail = held[-1].slice(held[-1].num_rows - 1)
                seam = _changes(pa.Table.from_batches([tail.select(keys), b.slice(0, 1).select(keys)]), keys)[1]
            else:
                seam = False
            new = _changes(b, keys)
            new[0] = seam
            cuts = np.flatnonzero(new)
            if len(cuts):
                done = whole([*held, b.slice(0, int(cuts[-1]))])
                held = [b.slice(int(cuts[-1]))]
                yield from kernel(done, np.cumsum(_changes(done, keys)) - 1)
            else:
                held.append(b)
        if held:
            done = whole(held)
            yield from kernel(done, np.cumsum(_changes(done, keys)) - 1)

    return spread(packs, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def flat_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, x, ys, ye`` of all runs of a table; rows without runs have a null."""
    column = table.column(RUNS).fill_null(b"").cast(pa.large_binary()).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    return decoded(column)


def _places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in packs that end at ``ends``: where a run's first value stands when a pack has all first, then all second, then all third ones, and the size of its pack."""
    size = np.repeat(np.diff(ends), np.diff(ends))
    return np.arange(ends[-1]) + 2 * np.repeat(ends[:-1], np.diff(ends)), size


def coded(ends: np.ndarray, x: np.ndarray, ys: np.ndarray, ye: np.ndarray) -> pa.Array:
    """Packs, from ``ends[i]`` to ``ends[i + 1]`` of the runs each, as bytes.

    A pack is the steps of its columns, of its tops and of its heights, one
    after the other; a step, its sign in the lowest bit, goes in groups of
    seven bits, low first, with the eighth set if more follow. Any whole
    numbers come back as they were, in their order.
    """
    ends = np.asarray(ends, np.int64)
    place, size = _places(ends)
    values = np.empty(3 * len(place), np.int64)
    heads = ends[:-1][np.diff(ends) > 0]
    for k, v in enumerate((x, ys, np.asarray(ye, np.int64) - ys)):
        v = np.asarray(v, np.int64)
        step = np.diff(v, prepend=0)
        step[heads] = v[heads]
        values[place + k * size] = step
    left = ((values << 1) ^ (values >> 63)).view(np.uint64)
    if not len(left) or left.max() < 128:
        data, stop = left.astype(np.uint8), 3 * ends
    else:
        used = np.ones(len(left), np.int64)
        for k in range(1, 10):
            used += left >> np.uint64(7 * k) > 0
        start = np.cumsum(used) - used
        data = np.empty(int(used.sum()), np.uint8)
        for k in range(int(used.max())):
            use = np.flatnonzero(used > k)
            data[start[use] + k] = ((left[use] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(used[use] > k + 1, 128, 0).astype(np.uint8)
        stop = np.append(start, len(data))[3 * ends]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def decoded(packs: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, x, ys, ye`` of the runs of what ``coded`` gives."""
    if not len(packs):
        return (np.zeros(0, np.int64),) * 4
    _, offsets, data = packs.buffers()
    stop = np.frombuffer(offsets, np.int64)[packs.offset:packs.offset + len(packs) + 1]
    data = np.frombuffer(data, np.uint8)[stop[0]:stop[-1]] if data is not None else np.zeros(0, np.uint8)
    stop, last = stop - stop[0], data < 128
    if last.all():
        left, ends = data.astype(np.uint64), stop // 3
    else:
        end = np.flatnonzero(last)
        start = np.append(0, end[:-1] + 1)
        step = np.arange(len(data)) - np.repeat(start, end + 1 - start)
        left = np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (7 * step).astype(np.uint64), start)
        ends = np.append(0, np.cumsum(last))[stop] // 3
    values = (left >> np.uint64(1)).view(np.int64) ^ -(left & np.uint64(1)).view(np.int64)
    place, size = _places(ends)
    heads = ends[:-1][np.diff(ends) > 0]
    out = []
    for k in range(3):
        total = np.cumsum(values[place + k * size])
        before = np.append(0, total[heads[1:] - 1]) if len(heads) else total
        out.append(total - np.repeat(before, np.diff(np.append(heads, len(total)))))
    return np.repeat(np.arange(len(packs)), np.diff(ends)), out[0], out[1], out[1] + out[2]


def _ranges(start: np.ndarray, count: np.ndarray, most: int = _PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``i`` with each number of its range ``start[i] .. start[i] + count[i]``, some at a time."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        n = count[lo:hi]
        if n.sum():
            one = np.repeat(np.arange(lo, hi), n)
            yield one, np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[lo:hi], n)
        lo = hi


def shared_pixels(column: np.ndarray, ys: np.ndarray, ye: np.ndarray, member: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, n``: pixels that runs of members a < b share in their columns.

    A pair may come more than once, with the rest of its pixels. ``member``
    counts up to ``size``.
    """
    order = np.lexsort((ys, column))
    column, ys, ye, member = column[order], ys[order], ye[order], member[order]
    if not len(ys):
        return
    low = min(ys.min(), 0)
    wide = np.int64(max(ye.max(), ys.max()) - low + 2)
    code = np.cumsum(np.append(False, column[1:] != column[:-1])) * wide
    after = np.arange(1, len(ys) + 1)
    # a run meets those that start in its column after it and before its end
    last = np.searchsorted(code + (ys - low), code + (ye - low), side="left")
    for one, two in _ranges(after, np.maximum(last - after, 0)):
        other = member[one] != member[two]
        one, two = one[other], two[other]
        a, b = np.minimum(member[one], member[two]), np.maximum(member[one], member[two])
        pair, back = np.unique(a * size + b, return_inverse=True)
        n = np.bincount(back, np.minimum(ye[one], ye[two]) - ys[two]).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
        yield pair // size, pair % size, n


# ---- greedy de-duplication ---------------------------------------------------------

def _greedy(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Nodes that fall when each kept node drops the later ones it conflicts with; ``first`` ranks before ``second``."""
    gone = np.zeros(size, bool)
    while len(first):
        waits = np.zeros(size, bool)
        waits[second] = True
        wins = ~waits[first]
        gone[second[wins]] = True
        left = ~wins & ~gone[first] & ~gone[second]
        first, second = first[left], second[left]
    return gone


def _box_conflicts(box: np.ndarray, bare: np.ndarray, meets) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one key of which at least one is ``bare`` and whose boxes conflict."""
    full = (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1])
    a, b = np.flatnonzero(full), np.flatnonzero(full & bare)
    p, q = box[a][:, None], box[b][None]
    with np.errstate(invalid="ignore", divide="ignore"):
        inter = np.maximum(0.0, np.minimum(p[..., 2], q[..., 2]) - np.maximum(p[..., 0], q[..., 0])) * np.maximum(
            0.0, np.minimum(p[..., 3], q[..., 3]) - np.maximum(p[..., 1], q[..., 1]))
        area = lambda v: (v[..., 2] - v[..., 0]) * (v[..., 3] - v[..., 1])
        union = area(p) + area(q) - inter
        hit = meets(np.where(union > 0, inter / union, 0.0))
    i, j = np.nonzero(hit)
    return a[i], b[j]


def fold_masks(rows: DataFrame, runs: DataFrame, keys: list[str], ranks: list[str], box: list[str], meets, box_fallback: bool) -> DataFrame:
    """Greedy pass over the rows of a key by mask overlap, one key of bounded size at a time: the kept (keys, _row).

    ``runs`` may be packs. Rows arrive in rank order, followed by the packs of their masks.
    """
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = rows.select(*keys, *ranks, *box, F.lit(0).alias("_kind"), F.lit(None).cast("binary").alias(RUNS))
    packs = runs if is_packed(runs) else pack(runs.where("x is not null and ys is not null and ye is not null"), [*keys, "_row"])
    packs = packs.select(
        *keys, *["_row" if c == "_row" else none(c) for c in ranks], *[none(c) for c in box], F.lit(1).alias("_kind"), RUNS)

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = table.column("_kind").to_numpy() == 0
        ids = _codes(table.column("_row")).astype(np.int64)
        _, node = np.unique(group * np.int64(ids.max() + 1) + ids, return_inverse=True)
        size = int(node.max()) + 1
        place = np.full(size, len(node))
        np.minimum.at(place, node[head], np.flatnonzero(head))
        row, x, ys, ye = flat_runs(table)
        has = np.zeros(size, bool)
        has[node[row]] = True
        area = np.bincount(node[row], (ye - ys).astype(float), size)
        use = (ye > ys) & (place[node[row]] < len(node))
        row, x, ys, ye = row[use], x[use], ys[use], ye[use]
        found = [(np.zeros(0, np.int64),) * 3]
        if len(x):
            column = group[row] * np.int64(x.max() - x.min() + 1) + (x - x.min())
            found += shared_pixels(column, ys, ye, node[row], size)
        a, b, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        pair, back = np.unique(a * size + b, return_inverse=True)
        a, b, n = pair // size, pair % size, np.bincount(back, n, len(pair))
        with np.errstate(invalid="ignore", divide="ignore"):
            hit = meets(n / (area[a] + area[b] - n))
        edges = [(a[hit], b[hit])]
        if box_fallback:
            sides = np.stack([table.column(c).to_numpy().astype(float) for c in box], 1)
            bare = head & ~has[node]
            for g in np.unique(group[bare]):
                lo, hi = np.searchsorted(group, [g, g + 1])
                mine = np.flatnonzero(head[lo:hi]) + lo
                one, two = _box_conflicts(sides[mine], bare[mine], meets)
                edges.append((node[mine[one]], node[mine[two]]))
        a, b = (np.concatenate([e[k] for e in edges]) for k in range(2))
        a, b = a[a != b], b[a != b]
        before = place[a] < place[b]
        gone = _greedy(np.where(before, a, b), np.where(before, b, a), size)
        kept = np.sort(place[~gone & (place < len(node))])
        out = table.select([*keys, "_row"]).take(pa.array(kept))
        yield from out.combine_chunks().to_batches()

    return by_group(heads.unionByName(packs), keys, kernel, kinds(rows, [*keys, "_row"]), [F.col("_kind"), *[F.col(c) for c in ranks]])


# ---- boxes of a key ---------------------------------------------------------------------

def numbers(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns as a matrix of doubles, and where it is null (0 in the matrix)."""
    held = [table.column(c) for c in columns]
    null = np.stack([np.asarray(h.is_null()) for h in held], 1)
    values = np.stack([h.cast(pa.float64()).to_numpy() for h in held], 1)
    return np.where(null, 0.0, values), null


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in ``columns``."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _pairs_of_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of the same group."""
    after = np.arange(1, len(group) + 1)
    return _ranges(after, np.searchsorted(group, group, side="right") - after)


def box_overlaps(group: np.ndarray, box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, inter``: pairs of rows of the same group whose (finite) boxes share any area, each once."""
    use = np.flatnonzero((box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1]))
    if not len(use):
        return
    use = use[np.lexsort((box[use, 0], group[use]))]
    box = box[use]
    # sides as whole numbers of the same order, so that group and side make one exact number
    _, place = np.unique(np.concatenate([box[:, 0], box[:, 2]]), return_inverse=True)
    place = place.reshape(-1) + group[np.concatenate([use, use])] * np.int64(2 * len(use))
    after = np.arange(1, len(use) + 1)
    last = np.searchsorted(place[:len(use)], place[len(use):], side="left")
    left, top, right, bottom = (np.ascontiguousarray(box[:, k]) for k in range(4))
    for i, j in _ranges(after, np.maximum(last - after, 0), 1 << 17):
        h = np.minimum(bottom[i], bottom[j]) - np.maximum(top[i], top[j])
        near = h > 0
        i, j, h = i[near], j[near], h[near]
        inter = (np.minimum(right[i], right[j]) - np.maximum(left[i], left[j])) * h
        near = inter > 0
        yield use[i[near]], use[j[near]], inter[near]


def box_iou(p: np.ndarray, q: np.ndarray, inter: np.ndarray) -> np.ndarray:
    """IoU of boxes, row by row, of the area they share; as in SQL, NaN counts as above 0."""
    area = lambda v: (v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1])
    with np.errstate(invalid="ignore", divide="ignore"):
        union = area(p) + area(q) - inter
        return np.where((union > 0) | np.isnan(union), inter / union, 0.0)


def _conflicts(group: np.ndarray, box: np.ndarray, null: np.ndarray, meets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of the same group whose box IoU ``meets``; a box with a null has IoU 0 with all."""
    apart = bool(meets(np.zeros(1))[0])
    odd = ~np.isfinite(box).all(axis=1) & ~null
    slow = np.zeros(int(group[-1]) + 1, bool)
    slow[group[odd]] = True
    slow = slow[group] | apart
    plain = np.flatnonzero(~slow & ~null)
    for i, j, inter in box_overlaps(group[plain], box[plain]) if len(plain) else ():
        i, j = plain[i], plain[j]
        hit = meets(box_iou(box[i], box[j], inter))
        yield np.minimum(i[hit], j[hit]), np.maximum(i[hit], j[hit])
    rest = np.flatnonzero(slow)
    for i, j in _pairs_of_groups(group[rest]) if len(rest) else ():
        i, j = rest[i], rest[j]
        p, q = box[i], box[j]
        with np.errstate(invalid="ignore"):
            side = lambda k: np.maximum(0.0, np.fmin(p[:, k + 2], q[:, k + 2]) - np.maximum(p[:, k], q[:, k]))
            value = box_iou(p, q, side(0) * side(1))
        value = np.where(null[i] | null[j], 0.0, value)
        hit = meets(value) | np.isnan(value)
        yield i[hit], j[hit]


def _joined(found, parts: int) -> list[np.ndarray]:
    found = [*found, (np.zeros(0, np.int64),) * parts]
    return [np.concatenate([f[k] for f in found]) for k in range(parts)]


def fold_boxes(rows: DataFrame, keys: list[str], order: list[Column], row: str, box: list[str], meets) -> DataFrame:
    """Greedy pass over the boxes of a key, in ``order``: the rows whose id is kept, with all their columns.

    A task holds one key of bounded size at a time. Rows without key or id are not returned.
    """
    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        sides, null = numbers(table, box)
        first, second = _joined(_conflicts(group, sides, null.any(axis=1), meets), 2)
        kept = ~_greedy(first, second, len(group))
        ids = _codes(table.column(row)).astype(np.int64)
        ids += group * np.int64(ids.max() + 1)
        # rows of the same id stay or go together
        out = table.filter(pa.array(np.isin(ids, ids[kept])))
        yield from out.combine_chunks().to_batches()

    return known(by_group(known(rows, keys), keys, kernel, kinds(rows, rows.columns), order), [row])


def fold_centres(rows: DataFrame, keys: list[str], order: list[Column], row: str, distance: float) -> DataFrame:
    """``rows`` with the ``leader`` of each point ``px, py``, walked in ``order``, as ``nms.leader_cluster`` tells them.

    The diagonal of a key is its ``diag``, or else spanned by its largest x2
    and y2. A task holds one key of bounded size at a time. Rows of the same id
    get each other's leaders as well; rows without key or id are not returned.
    """
    given = "diag" in rows.columns

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, null = numbers(table, ["px", "py", *(["diag"] if given else ["x2", "y2"])])
        if not given:
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            none = np.logical_and.reduceat(null[:, 2:], heads)[group].any(axis=1)
            mx, my = np.maximum.reduceat(np.where(null[:, 2:], -np.inf, values[:, 2:]), heads)[group].T
            values = np.column_stack([values[:, :2], np.where(none, 0.0, np.sqrt(mx * mx + my * my))])
            null = np.column_stack([null[:, :2], none])
        size = len(group)
        x, y, diag = values.T
        bad = null[:, 0] | null[:, 1]
        flat = null[:, 2] | ~((diag > 0) | np.isnan(diag))

        def near():
            for i, j in _pairs_of_groups(group):
                with np.errstate(invalid="ignore", divide="ignore"):
                    dx, dy = x[i] - x[j], y[i] - y[j]
                    close = (np.sqrt(dx * dx + dy * dy) / diag[j] < distance) & ~bad[i] & ~bad[j]
                close = np.where(flat[j], 0.0 < distance, close)
                yield i[close], j[close]

        first, second = _joined(near(), 2)
        lead = ~_greedy(first, second, size)
        # the first leader near a row is its own; a leader is not near an earlier one
        leader = np.where(lead, np.arange(size), size)
        use = lead[first]
        np.minimum.at(leader, second[use], first[use])
        # an earlier leader of the same id counts as well
        ids = _codes(table.column(row)).astype(np.int64)
        ids += group * np.int64(ids.max() + 1)
        _, ids = np.unique(ids, return_inverse=True)
        same = np.full(size, size)
        np.minimum.at(same, ids[lead], np.flatnonzero(lead))
        leader = np.minimum(leader, same[ids])
        count = np.bincount(ids)
        take, of = np.arange(size), leader
        if (count > 1).any():
            by = np.argsort(ids, kind="stable")
            take, place = _joined(_ranges((np.cumsum(count) - count)[ids], count[ids]), 2)
            of = leader[by[place]]
        out = table.select(names).take(pa.array(take)).append_column("leader", table.column(row).take(pa.array(of)))
        yield from out.combine_chunks().to_batches()

    names = [c for c in rows.columns if c not in ("px", "py", "diag")]
    schema = f"{kinds(rows, names)}, leader {rows.schema[row].dataType.simpleString()}"
    return known(by_group(known(rows, keys), keys, kernel, schema, order), [row])


# ---- columns of masks ----------------------------------------------------------------

def _flat(table: pa.Table, taken: np.ndarray, columns: list[str], **more) -> Iterator[pa.RecordBatch]:
    held = [table.column(c).take(pa.array(taken)) for c in columns]
    out = pa.table([*held, *[v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in more.values()]], names=[*columns, *more])
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def _striped(runs: DataFrame, keys: list[str], stripe: int) -> DataFrame:
    return pack(runs.where("ye > ys and x is not null").withColumn("_stripe", F.floor(F.col("x") / stripe)), [*keys, "_stripe"])


def _columns(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number for each column of each group."""
    return group * np.int64(x.max() - x.min() + 1) + (x - x.min()) if len(x) else group


def _spans(column: np.ndarray, x: np.ndarray, row: np.ndarray, ys: np.ndarray, ye: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """``column, x, row, from, to, n, m`` between neighbouring ends of a column, with the cover of either side; ``row`` is any of its rows."""
    at = np.concatenate([ys, ye])
    step = np.concatenate([np.ones(len(ys), np.int64), -np.ones(len(ye), np.int64)])
    column, x, row, side = (np.concatenate([v, v]) for v in (column, x, row, side))
    order = np.lexsort((at, column))
    column, at, step, side, x, row = (v[order] for v in (column, at, step, side, x, row))
    new = np.append(True, (column[1:] != column[:-1]) | (at[1:] != at[:-1]))
    first = np.flatnonzero(new)
    # every column ends with nothing open, so sums may run on
    n, m = (np.cumsum(np.add.reduceat(np.where(side == k, step, 0), first)) for k in (0, 1))
    column, at, x, row = column[first], at[first], x[first], row[first]
    inner = np.flatnonzero(column[1:] == column[:-1])
    return column[inner], x[inner], row[inner], at[inner], at[inner + 1], n[inner], m[inner]


def _merge(column: np.ndarray, kind: np.ndarray, ys: np.ndarray, ye: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First span of each run of touching spans of one column and kind, and where the run ends."""
    new = np.append(True, (column[1:] != column[:-1]) | (kind[1:] != kind[:-1]) | (ye[:-1] < ys[1:]))[:len(ys)]
    first = np.flatnonzero(new)
    return first, ye[np.append(first[1:], len(ys)) - 1] if len(first) else ye[:0]


def two_masks(a: DataFrame, b: DataFrame, keys: list[str], kind: Callable[[np.ndarray, np.ndarray], np.ndarray], stripe: int = 1024) -> DataFrame:
    """Runs ``keys, kind, x, ys, ye`` of two masks per key, where ``kind`` of their covers is not 0; a task holds ``stripe`` columns of a key."""
    side = lambda df, s: _striped(df.select(*keys, "x", "ys", "ye"), keys, stripe).withColumn("_side", F.lit(s))

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, x, ys, ye = flat_runs(table)
        which = table.column("_side").to_numpy()[row]
        column, x, row, s, e, n, m = _spans(_columns(group[row], x), x, row, ys, ye, which)
        k = kind(n > 0, m > 0)
        use = k > 0
        column, x, row, s, e, k = (v[use] for v in (column, x, row, s, e, k))
        first, end = _merge(column, k, s, e)
        yield from _flat(table, row[first], keys, kind=k[first], x=x[first], ys=s[first], ye=end)

    return by_group(side(a, 0).unionByName(side(b, 1)), [*keys, "_stripe"], kernel, f"{kinds(a, keys)}, kind bigint, x bigint, ys bigint, ye bigint")


def edge_pixels(runs: DataFrame, keys: list[str], w: int, h: int, stripe: int = 1024) -> DataFrame:
    """Inner pixels (keys, x, y) of a mask whose right or lower neighbour differs; each once."""
    own = runs.select(*keys, "x", "ys", "ye")
    side = lambda df, s: _striped(df, keys, stripe).withColumn("_side", F.lit(s))

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, x, ys, ye = flat_runs(table)
        which = table.column("_side").to_numpy()[row]
        column = _columns(group[row], x)
        low, mine = which == 0, (x >= 1) & (x < w - 1)
        c, cx, cr, s, e, n, m = _spans(column, x, row, ys, ye, which)
        use = ((n > 0) != (m > 0)) & (cx >= 1) & (cx < w - 1)
        c, cx, cr, s, e = (v[use] for v in (c, cx, cr, s, e))
        s, e = np.maximum(s, 1), np.minimum(e, h - 1)
        found = [(c[i], cx[i], cr[i], y) for i, y in _ranges(s, np.maximum(e - s, 0))]
        # the pixel above a start and the last pixel of a run see another value below
        at = low & mine
        found += [(column[at], x[at], row[at], y[at] - 1) for y in (ys, ye)]
        c, cx, cr, y = (np.concatenate([f[k] for f in found]) for k in range(4))
        good = (y >= 1) & (y < h - 1)
        c, cx, cr, y = (v[good] for v in (c, cx, cr, y))
        _, once = np.unique(c * np.int64(h) + y, return_index=True)
        yield from _flat(table, cr[once], keys, x=cx[once], y=y[once])

    packs = side(own, 0).unionByName(side(own.withColumn("x", F.col("x") - 1), 1))
    return by_group(packs, [*keys, "_stripe"], kernel, f"{kinds(runs, keys)}, x bigint, y bigint")


def first_owner(runs: DataFrame, keys: list[str], row: str, order: list[str], stripe: int = 128) -> DataFrame:
    """Runs (keys, row, x, ys, ye) of each mask where none that comes before it by ``order`` and ``row`` has the pixel.

    A task holds ``stripe`` columns of a key.
    """
    there = " and ".join(f"`{k}` is not null" for k in keys)
    packs = _striped(runs.where(there), [*keys, row, *order], stripe)

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        # rows of a group come in order, so the lowest row wins
        at, x, ys, ye = flat_runs(table)
        column = _columns(group[at], x)
        low, wide = ys.min(), np.int64(ye.max() - ys.min() + 1)
        code = column * wide - low
        cuts, place = np.unique(np.concatenate([code + ys, code + ye]), return_inverse=True)
        begin, stop = place[:len(ys)], place[len(ys):]
        owner, xs = np.full(len(cuts), table.num_rows), np.zeros(len(cuts), np.int64)
        xs[begin] = x
        for one, span in _ranges(begin, stop - begin):
            np.minimum.at(owner, span, at[one])
            xs[span] = x[one]
        span = np.flatnonzero(owner < table.num_rows)
        column, s, e, own = cuts[span] // wide, cuts[span] % wide + low, cuts[span + 1] % wide + low, owner[span]
        first, end = _merge(column, _codes(table.column(row))[own], s, e)
        yield from _flat(table, own[first], [*keys, row], x=xs[span][first], ys=s[first], ye=end)

    return by_group(packs, [*keys, "_stripe"], kernel, f"{kinds(runs, [*keys, row])}, x bigint, ys bigint, ye bigint", [F.col(c) for c in [*order, row]])


def lengths(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, counts``: background and foreground lengths in turn, from runs ``ys, ye`` along the whole image, whose area is ``x``.

    Runs of equal start count once, by the longest; any without a place come first, as one pair of nulls.
    ``runs`` may be packs.
    """
    packs = runs if is_packed(runs) else pack(runs.select(*keys, F.coalesce("x", F.lit(-1)).alias("x"), *[F.when(F.col("ys").isNull() | F.col("ye").isNull(), F.lit(_NONE)).otherwise(F.col(c)).alias(c) for c in ("ys", "ye")]), keys)

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, area, s, e = flat_runs(table)
        g = group[row]
        order = np.lexsort((s, g))
        g, s, e, area, row = (v[order] for v in (g, s, e, area, row))
        same = g[1:] == g[:-1]
        known = s > _NONE
        new = np.append(True, ~same | (s[1:] != e[:-1]) | ~known[1:])
        # runs of one start are one
        peers = np.flatnonzero(np.append(True, ~same | (s[1:] != s[:-1])))
        first = peers[np.logical_or.reduceat(new, peers)]
        end, g, s, known = np.maximum.reduceat(e, first), g[first], s[first], known[first]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        before = np.append(0, end[:-1])
        before[head] = 0
        before[before == _NONE] = 0
        top = np.maximum.reduceat(end, head)
        rest = np.where(top > _NONE, area[first][head] - top, 0)
        number = np.diff(np.append(head, len(g)))
        size = 2 * number + (rest > 0)
        start = np.cumsum(size) - size
        out, null = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), bool)
        at = np.repeat(start, number) + 2 * (np.arange(len(g)) - np.repeat(head, number))
        out[at], out[at + 1] = np.where(known, s - before, 0), end - s
        null[at], null[at + 1] = ~known, ~known
        out[(start + size - 1)[rest > 0]] = rest[rest > 0]
        held = [table.column(k).take(pa.array(row[first][head])) for k in keys]
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(out)).astype(np.int32)), pa.array(out, pa.int64(), mask=null))
        yield from pa.table([*[v for v in held], lists], names=[*keys, "counts"]).combine_chunks().to_batches()

    return by_group(packs, keys, kernel, f"{kinds(runs, keys)}, counts array<bigint>")


def pixel_runs(pixels: DataFrame, keys: list[str], stripe: int = 1024) -> DataFrame:
    """Pixels (keys, x, y) to runs, each pixel once however often it comes.

    Pixels that lie together in a column become a piece of a run within their
    Arrow batch, before anything is shuffled; pieces are then united by key.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = np.cumsum(_changes(b, keys))
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            order = np.lexsort((y, x, group))
            group, x, y = group[order], x[order], y[order]
            first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1] + 1)))
            last = np.append(first[1:], len(y)) - 1
            held = [b.column(k).take(pa.array(order[first])) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, *[pa.array(v, pa.int64()) for v in (x[first], y[first], y[last] + 1)]], [*keys, "x", "ys", "ye"])

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, x, ys, ye = flat_runs(table)
        column, x, row, s, e, n, _ = _spans(_columns(group[row], x), x, row, ys, ye, np.zeros(len(row), np.int64))
        column, x, row, s, e = (v[n > 0] for v in (column, x, row, s, e))
        first, end = _merge(column, np.zeros(len(s)), s, e)
        yield from _flat(table, row[first], keys, x=x[first], ys=s[first], ye=end)

    big = pixels.where("x is not null and y is not null").select(*keys, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    schema = f"{kinds(pixels, keys)}, x bigint, ys bigint, ye bigint" if keys else "x bigint, ys bigint, ye bigint"
    return by_group(_striped(big.mapInArrow(pieces, schema), keys, stripe), [*keys, "_stripe"], kernel, schema)


def _unite(group: np.ndarray, x: np.ndarray, ys: np.ndarray, ye: np.ndarray) -> tuple[np.ndarray, ...]:
    """``any row, x, ys, ye`` of the united runs of each group."""
    row, side = np.arange(len(x)), np.zeros(len(x), np.int64)
    column, x, row, s, e, n, _ = _spans(_columns(group, x), x, row, ys, ye, side)
    column, x, row, s, e = (v[n > 0] for v in (column, x, row, s, e))
    first, end = _merge(column, np.zeros(len(s)), s, e)
    return row[first], x[first], s[first], end


def united(runs: DataFrame, keys: list[str], stripe: int = 1024) -> DataFrame:
    """Runs (keys, x, ys, ye) of the union of all runs of a key.

    Runs unite within their Arrow batch before anything is shuffled, and batch
    by batch after it: a task holds one batch and the union of ``stripe``
    columns of a key, however many masks meet there.
    """
    held = [*keys, "_stripe"]
    big = [F.col(c).cast("bigint").alias(c) for c in ("x", "ys", "ye")]
    there = runs.where("ye > ys and x is not null").select(*keys, *big)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = np.cumsum(_changes(b, keys)) if keys else np.zeros(b.num_rows, np.int64)
            row, x, ys, ye = _unite(group, *[b.column(c).to_numpy() for c in ("x", "ys", "ye")])
            new = np.append(True, (group[row][1:] != group[row][:-1]) | (x[1:] // stripe != x[:-1] // stripe))
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(row[first])) for k in keys], pa.array(x[first] // stripe, pa.int64()),
                                              coded(np.append(first, len(x)), x, ys, ye)], [*held, RUNS])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = (pa.concat_tables([tail, table]) if tail is not None else table).combine_chunks()
            group = np.cumsum(_changes(table, held)) - 1
            at, x, ys, ye = flat_runs(table)
            run, x, ys, ye = _unite(group[at], x, ys, ye)
            at = at[run]
            # the last group may go on in the next batch
            done = int(np.searchsorted(group[at], group[-1]))
            yield from _flat(table, at[:done], keys, x=x[:done], ys=ys[:done], ye=ye[:done])
            rest = coded([0, len(x) - done], *[v[done:] for v in (x, ys, ye)])
            end = table.slice(table.num_rows - 1).select(held).combine_chunks()
            tail = pa.table([*[end.column(k) for k in held], rest], schema=table.schema)
        if tail is not None:
            at, x, ys, ye = flat_runs(tail)
            yield from _flat(tail, at, keys, x=x, ys=ys, ye=ye)

    names = ", ".join(filter(None, [kinds(runs, keys), "_stripe bigint"]))
    packs = there.mapInArrow(pieces, f"{names}, {PACK}")
    ends = ", ".join(filter(None, [kinds(runs, keys), "x bigint, ys bigint, ye bigint"]))
    return spread(packs, *held).sortWithinPartitions(*held).mapInArrow(fold, ends)


# ---- pixels under masks ----------------------------------------------------------------

_PLANES = "rgb"


def _pixel_packs(pixels: DataFrame, keys: list[str], stripe: int) -> DataFrame:
    """``keys, _stripe``, the ``coded`` runs of neighbouring pixels (keys, x, y, r, g, b) and their colours ``_v``.

    Colours go plane by plane: as differences in bytes where all fit a byte, else as they are.
    """
    held = [*keys, "_stripe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            group = np.cumsum(_changes(b, held))
            order = np.lexsort((y, x, group))
            group, x, y = group[order], x[order], y[order]
            new = np.append(True, group[1:] != group[:-1])
            first = np.flatnonzero(new)
            piece = np.flatnonzero(new | np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1] + 1)))
            last = np.append(piece[1:], len(x)) - 1
            colours = np.stack([b.column(c).to_numpy()[order] for c in _PLANES])
            narrow = np.logical_and.reduceat(((colours >= 0) & (colours < 256)).all(0), first)
            step = np.diff(colours, axis=1, prepend=0)
            step[:, first] = colours[:, first]
            step = step.astype(np.uint8)
            stop = np.append(first[1:], len(x))
            values = [(step if n else colours)[:, lo:hi].tobytes() for n, lo, hi in zip(narrow, first, stop)]
            runs = coded(np.searchsorted(piece, np.append(first, len(x))), x[piece], y[piece], y[last] + 1)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(order[first])) for k in held], runs, pa.array(values, pa.binary())], [*held, RUNS, "_v"])

    whole = lambda c: F.col(c).cast("bigint").alias(c)
    given = pixels.where("x is not null and y is not null").select(
        *keys, F.floor(F.col("x") / stripe).alias("_stripe"), whole("x"), whole("y"), *[F.coalesce(whole(c), F.lit(0).cast("bigint")).alias(c) for c in _PLANES])
    return given.mapInArrow(run, f"{kinds(given, held)}, {PACK}, _v binary")


def _colours(values: list[bytes], size: np.ndarray) -> np.ndarray:
    """The planes of all pixels of ``_pixel_packs``' rows, ``size`` of each."""
    out = []
    for v, n in zip(values, size):
        if len(v) == 3 * n:
            out.append(np.cumsum(np.frombuffer(v, np.uint8).reshape(3, n), axis=1, dtype=np.uint8).astype(np.int64))
        else:
            out.append(np.frombuffer(v, np.int64).reshape(3, n))
    return np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)


def colour_sums(runs: DataFrame, pixels: DataFrame, keys: list[str], image: str, stripe: int = 64) -> DataFrame:
    """``keys, n, r, g, b``: pixels under each mask and the sums of their colours, some rows per mask.

    Masks and pixels of ``stripe`` columns of an image meet in one task; a run
    is the difference of two running sums down its column.
    """
    place = [image, "_stripe"]
    more = [k for k in keys if k != image]
    packs = _striped(runs.select(*{image: 0, **dict.fromkeys(keys)}, "x", "ys", "ye"), [image, *more], stripe)
    masks = packs.select(*place, *more, RUNS, F.lit(None).cast("binary").alias("_v"))
    blank = [F.lit(None).cast(runs.schema[k].dataType).alias(k) for k in more]
    given = _pixel_packs(pixels.select(image, "x", "y", *_PLANES), [image], stripe).select(*place, *blank, RUNS, "_v")

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        shown = table.column("_v").is_valid().to_numpy()
        row, x, ys, ye = flat_runs(table)
        column = _columns(group[row], x)
        mine = shown[row]
        pieces, spans = np.flatnonzero(mine), np.flatnonzero(~mine)
        if not len(pieces) or not len(spans):
            return
        size = np.bincount(row[pieces], (ye - ys)[pieces], table.num_rows).astype(np.int64)[shown]
        colour = _colours(table.column("_v").filter(pa.array(shown)).to_pylist(), size)
        low, wide = ys.min(), np.int64(ye.max() - ys.min() + 1)
        n = (ye - ys)[pieces]
        code = np.repeat(column[pieces] * wide + ys[pieces] - low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(code, kind="stable")
        total = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(colour[:, order], axis=1)], 1)
        at = [np.searchsorted(code[order], column[spans] * wide + v[spans] - low) for v in (ys, ye)]
        sums = [at[1] - at[0], *[plane[at[1]] - plane[at[0]] for plane in total]]
        _, first, back = np.unique(row[spans], return_index=True, return_inverse=True)
        out = np.zeros((4, len(first)), np.int64)
        for plane, v in zip(out, sums):
            np.add.at(plane, back, v)
        yield from _flat(table, row[spans][first], keys, **dict(zip(("n", *_PLANES), out)))

    both = masks.unionByName(given).where(F.col(image).isNotNull())
    return by_group(both, place, kernel, f"{kinds(runs, keys)}, n bigint, r bigint, g bigint, b bigint")
