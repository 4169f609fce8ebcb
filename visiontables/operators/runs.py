"""Masks as run tables: rows (keys, x, ys, ye), half-open spans down a column.

Set algebra works column by column over packs of runs (``packed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.operators import overlap as O
from visiontables.operators import packed as P


def encode_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Foreground pixels (keys, x, y) to runs."""
    return P.pixel_runs(pixels, keys)


def runs_to_pixels(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.where(F.col("ye") > F.col("ys")).select(*keys, "x", F.explode(F.sequence(F.col("ys"), F.col("ye") - 1)).alias("y"))


def encode_counts(runs: DataFrame, keys: list[str], h: Column, w: Column) -> DataFrame:
    """Runs to column-major run lengths, starting with the background.

    A run that reaches the bottom joins one that starts at the top of the next
    column. The lengths add up to the image area: what is left after the last
    run is a final background length, unless nothing is left. ``runs`` may be
    packs, all of whose masks have a size.
    """
    if P.is_packed(runs):
        along = lambda row, x, ys, ye, h, w: (row, w * h, x * h + ys, x * h + ye)
        return P.lengths(P.each_pack(runs, {"h": h, "w": w}, along), keys)
    at = lambda c: (F.col("x") * h + F.col(c)).alias(c)
    return P.lengths(runs.select(*keys, (w * h).cast("bigint").alias("x"), at("ys"), at("ye")), keys)


def decode_runs(masks: DataFrame, keys: list[str], h: Column, w: Column | None = None, counts: str = "counts",
                row_major: bool = False, packed: bool = False) -> DataFrame:
    """Run lengths to runs; ``row_major`` reads them along rows instead.

    A row holds all lengths of its mask, so its runs follow without a shuffle.
    With ``packed`` they stay together as packs.
    """
    line = (w if row_major else h).cast("bigint").alias("_line")
    rows = masks.select(*keys, line, F.col(counts).cast("array<bigint>").alias("_n")).where("_line > 0 and size(_n) > 0")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            # long masks go through a few at a time
            for stop in _portions(np.diff(whole.column("_n").offsets.to_numpy()), 1 << 20):
                b, at = whole.slice(at, stop - at), stop
                n = b.column("_n").flatten().fill_null(0).to_numpy(zero_copy_only=False)
                size = pa.compute.list_value_length(b.column("_n")).to_numpy()
                for part in _decoded(n, size, b.column("_line").to_numpy(), row_major):
                    if len(part[0]):
                        yield P.as_packs(b, keys, *part)

    out = rows.mapInArrow(decode, f"{P.kinds(masks, keys)}, {P.PACK}")
    return out if packed else P.unpack(out, keys)


def _portions(size: np.ndarray, most: int) -> list[int]:
    """Where to cut rows so that a portion's sizes add up to at most ``most``, or it is one row."""
    total, out, at = np.cumsum(size), [], 0
    while at < len(size):
        at = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        out.append(at)
    return out


def _decoded(n: np.ndarray, size: np.ndarray, line: np.ndarray, row_major: bool) -> Iterator[tuple[np.ndarray, ...]]:
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    end = np.cumsum(n)
    end = end - np.repeat((end - n)[first], size)
    use = ((np.arange(len(n)) - first[row]) % 2 == 1) & (n > 0)
    row, start, end = row[use], (end - n)[use], end[use]
    at, last = start // line[row], (end - 1) // line[row]
    for one, x in P._ranges(at, last - at + 1, *([1 << 62] if row_major else [])):
        base = x * line[row[one]]
        spans = row[one], x, np.maximum(start[one], base) - base, np.minimum(end[one], base + line[row[one]]) - base
        yield from _turned(*spans) if row_major else [spans]


def _turned(row: np.ndarray, line: np.ndarray, first: np.ndarray, stop: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans along lines, sorted by ``row``, as runs down columns; large masks go by bands of columns."""
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    bounds = np.append(head, len(row))
    at = 0
    for rows in _portions(np.add.reduceat(stop - first, head), most):
        part = slice(bounds[at], bounds[rows])
        at = rows
        r, y, lo, hi = row[part], line[part], first[part], stop[part]
        edges = np.unique(np.linspace(lo.min(), hi.max(), int((hi - lo).sum() // most) + 2).astype(np.int64))
        for left, right in zip(edges[:-1], edges[1:]):
            a, n = np.maximum(lo, left), np.minimum(hi, right) - np.maximum(lo, left)
            a, n, q, v = a[n > 0], n[n > 0], r[n > 0], y[n > 0]
            if not len(n):
                continue
            x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            q, v = np.repeat(q, n), np.repeat(v, n)
            order = np.lexsort((v, x, q))
            q, x, v = q[order], x[order], v[order]
            new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (x[1:] != x[:-1]) | (v[1:] != v[:-1] + 1)))
            yield q[new], x[new], v[new], v[np.append(new[1:], len(v)) - 1] + 1


def _decode_text(text: str) -> list[int]:
    """One compressed mask text: groups of five bits, low first, in printable
    characters; from the fourth length on, differences to two lengths before."""
    out: list[int] = []
    value = shift = 0
    for ch in text:
        bits = ord(ch) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            out.append(value + (out[-2] if len(out) > 2 else 0))
            value = shift = 0
    return out


def _decode_texts(texts: list[str]) -> list[np.ndarray]:
    """Many compressed mask texts at once, each as ``_decode_text`` reads it."""
    values, size = _texts_flat(texts)
    return np.split(values, np.cumsum(size)[:-1]) if texts else []


def _texts_flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Many compressed mask texts at once, each as ``_decode_text`` reads it: all lengths, and how many each text has."""
    size = np.array([len(t) for t in texts], np.int64)
    bits = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 48
    text = np.repeat(np.arange(len(texts)), size)
    last = bits & 32 == 0
    # a length begins where its text does or another one has ended; one without an end is no length
    new = np.append(True, last[:-1] | (text[1:] != text[:-1]))[:len(bits)]
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    place = np.arange(len(bits)) - np.repeat(first, np.diff(np.append(first, len(bits))))
    if place.max() > 11:
        lists = [np.array(_decode_text(t), np.int64) for t in texts]
        return np.concatenate(lists), np.array([len(v) for v in lists])
    value = np.add.reduceat((bits & 31) << 5 * place, first)
    end = np.append(first[1:], len(bits)) - 1
    value -= np.where(bits[end] & 16 != 0, np.int64(1) << 5 * (place[end] + 1), 0)
    value, owner = value[last[end]], text[first][last[end]]
    number = np.bincount(owner, minlength=len(texts))
    start = np.cumsum(number) - number
    at = np.arange(len(value)) - start[owner]
    # differences add up along every other length; the first stands alone
    chain = owner * 3 + np.where(at == 0, 0, 2 - at % 2)
    order = np.argsort(chain, kind="stable")
    total = np.cumsum(value[order])
    head = np.flatnonzero(np.append(True, chain[order][1:] != chain[order][:-1]))[:len(value)]
    total -= np.repeat((total - value[order])[head], np.diff(np.append(head, len(value))))
    value[order] = total
    return value, number


def decode_coco_counts(df: DataFrame, text: str = "counts", name: str = "counts") -> DataFrame:
    """Compressed mask texts to run lengths, in Arrow batches."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def decode(texts: pa.Array) -> pa.Array:
        values, size = _texts_flat(texts.drop_null().to_pylist())
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        ends = np.zeros(len(texts) + 1, np.int32)
        ends[1:][known] = size
        # a list without an offset is null
        ends = pa.array(np.cumsum(ends, dtype=np.int32), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(ends, pa.array(values, pa.int64()))

    # a filter on the lengths must not have texts read a second time, ahead of a join
    return df.withColumn(name, decode.asNondeterministic()(F.col(text)))


def encode_texts(values: np.ndarray, size: np.ndarray) -> list[str]:
    """Run lengths of many masks, one after the other, ``size`` of each, as compressed mask texts."""
    values, size = np.asarray(values, np.int64), np.asarray(size, np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    left = values.copy()
    left[2:] -= np.where(at[2:] > 2, values[:-2], 0)
    digits, more = [], np.ones(len(values), bool)
    used = np.zeros(len(values), np.int64)
    while more.any():
        bits, left = left & 31, left >> 5
        used += more
        more = more & (left != np.where(bits & 16, -1, 0))
        digits.append(np.where(more, bits | 32, bits) + 48)
    if not digits:
        return [""] * len(size)
    table = np.stack(digits, 1).astype(np.uint8)
    chars = table[np.arange(len(digits)) < used[:, None]].tobytes().decode("ascii")
    stop = np.append(0, np.cumsum(used))[np.append(0, np.cumsum(size))]
    return [chars[a:b] for a, b in zip(stop[:-1], stop[1:])]


def encode_text(values) -> str:
    """Run lengths as one compressed mask text."""
    return encode_texts(np.array(values, np.int64), np.array([len(values)]))[0]


def encode_coco_counts(df: DataFrame, counts: str = "counts", name: str = "text") -> DataFrame:
    """Run lengths to compressed mask texts, in Arrow batches."""
    @F.pandas_udf(T.StringType())
    def encode(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        lists = [np.asarray(v, np.int64) for v in s[known]]
        out = np.full(len(s), None, object)
        if lists:
            out[known] = encode_texts(np.concatenate(lists), np.array([len(v) for v in lists]))
        return pd.Series(out, index=s.index)

    return df.withColumn(name, encode(F.col(counts)))


def normalize_mask_repr(df: DataFrame, text: str, parsed: str, h: Column, w: Column) -> DataFrame:
    """Either text form or {counts, size}; the image size fills a missing size."""
    return df.select(
        *[c for c in df.columns if c not in (text, parsed)],
        F.coalesce(F.col(f"{parsed}.counts"), F.col(text)).alias("counts"),
        F.coalesce(F.col(f"{parsed}.size"), F.array(h, w)).alias("size"))


# ---- placing and resizing ---------------------------------------------------------

def place_masks(runs: DataFrame, dx: Column, dy: Column, w: Column, h: Column) -> DataFrame:
    """Shift runs and clip them to the image; packs stay packs."""
    if P.is_packed(runs):
        def shift(row, x, ys, ye, dx, dy, w, h):
            x, ys, ye = x + dx, np.maximum(ys + dy, 0), np.minimum(ye + dy, h)
            use = (x >= 0) & (x < w) & (ye > ys)
            return row[use], x[use], ys[use], ye[use]

        return P.each_pack(runs, {"dx": dx, "dy": dy, "w": w, "h": h}, shift)
    moved = runs.withColumns({"x": F.col("x") + dx, "ys": F.greatest(F.col("ys") + dy, F.lit(0).cast("bigint")),
                              "ye": F.least(F.col("ye") + dy, h)})
    return moved.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("ye") > F.col("ys")))


def resize_runs(runs: DataFrame, src_w: int | Column, src_h: int | Column, dst_w: int | Column, dst_h: int | Column) -> DataFrame:
    """Nearest neighbour: target pixel t shows source pixel floor(t * src / dst).

    Sizes are numbers, or columns where masks differ in size. Packs stay packs.
    """
    if P.is_packed(runs):
        sizes = {n: v if isinstance(v, Column) else F.lit(v) for n, v in (("sw", src_w), ("sh", src_h), ("dw", dst_w), ("dh", dst_h))}
        return P.each_pack(runs, sizes, _resized)
    size = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    up = lambda c, dst, src: F.ceil(c * dst / size(src)).cast("bigint")
    r = runs.withColumns({"ys": up(F.col("ys"), dst_h, src_h), "ye": up(F.col("ye"), dst_h, src_h),
                          "_x0": up(F.col("x"), dst_w, src_w), "_x1": up(F.col("x") + 1, dst_w, src_w)})
    r = r.where((F.col("ye") > F.col("ys")) & (F.col("_x1") > F.col("_x0")))
    rest = [c for c in runs.columns if c != "x"]
    return r.select(*rest, F.explode(F.sequence(F.col("_x0"), F.col("_x1") - 1)).alias("x")).select(*runs.columns)


def _resized(row, x, ys, ye, sw, sh, dw, dh):
    up = lambda v, dst, src: np.ceil(v * dst / src.astype(float)).astype(np.int64)
    first, n = up(x, dw, sw), up(x + 1, dw, sw)
    n, ys, ye = n - first, up(ys, dh, sh), up(ye, dh, sh)
    use = np.flatnonzero((ye > ys) & (n > 0))
    n = n[use]
    at = np.repeat(use, n)
    return row[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at], ys[at], ye[at]


# ---- set algebra ---------------------------------------------------------------------

def mask_union(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of all runs of a key, whatever objects they came from."""
    return P.united(runs, keys)


def mask_combine(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``intersect``, ``except`` (a without b), or ``xor`` of two masks per key."""
    keep = {"intersect": lambda n, m: n & m, "except": lambda n, m: n & ~m, "xor": lambda n, m: n != m}[how]
    return P.two_masks(a, b, keys, lambda n, m: keep(n, m).astype(np.int64)).drop("kind")


def error_regions(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """False positive and false negative runs (``kind`` fp or fn) in one sweep."""
    e = P.two_masks(pred, truth, keys, lambda n, m: np.where(n != m, np.where(n, 1, 2), 0))
    return e.select(*keys, F.when(F.col("kind") == 1, "fp").otherwise("fn").alias("kind"), "x", "ys", "ye")


def resolve_overlaps(runs: DataFrame, keys: list[str], row: str, order: list[Column]) -> DataFrame:
    """Give each pixel to one object: the first by ``order``, ties to the lowest id."""
    ranks = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    return P.first_owner(runs.select(*keys, row, "x", "ys", "ye", *ranks), keys, row, [f"_o{i}" for i in range(len(order))])


def drop_shrunk(runs: DataFrame, resolved: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """Original masks of objects that keep at least ``share`` of their area."""
    before, after = O.mask_areas(runs, keys, "_b"), O.mask_areas(resolved, keys, "_a")
    lost = before.join(after, keys, "left").where(
        F.coalesce("_a", F.lit(0)) / F.greatest("_b", F.lit(1)) < share).select(*keys)
    if not set(runs.columns) <= {*keys, "x", "ys", "ye"} or any(dict(runs.dtypes)[c] != "bigint" for c in ("x", "ys", "ye")):
        return runs.join(lost, keys, "left_anti")
    return P.join_packed(runs, lost, keys, "left_anti").select(*runs.columns)


def mask_edges(runs: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """Inner pixels whose right or lower neighbour differs; the runs of a mask
    do not touch each other, as all functions here produce them."""
    return P.edge_pixels(runs, keys, w, h)


# ---- polygons to runs ---------------------------------------------------------------

def rasterize_polygons(polygons: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Polygon parts to runs: pixels whose centre lies inside (even-odd rule).

    Each edge meets the centre lines of the columns it spans; the crossings of a
    column, sorted, pair up into spans. Polygons are shuffled, not crossings; a
    task holds the parts of one mask and the crossings of a batch.
    """
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    side = lambda name, v, c: F.transform(v, lambda p: p[c].cast("double")).alias(name)
    sides = ["_px", "_py", "_qx", "_qy"]
    e = polygons.where(F.size(points) > 0).select(*keys, *[side(n, v, c) for n, v, c in zip(sides, (F.col(points), F.col(points), nxt, nxt), "xyxy")])

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = [table.column(c).combine_chunks() for c in sides]
        lists = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in lists]
        size = pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        px, py, qx, qy = (v.flatten() for v in lists)
        # an edge without an x meets no column; a crossing without a y comes first and bounds nothing
        known = px.is_valid().to_numpy(zero_copy_only=False) & qx.is_valid().to_numpy(zero_copy_only=False)
        blank = ~(py.is_valid().to_numpy(zero_copy_only=False) & qy.is_valid().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(table.num_rows), size)
        px, py, qx, qy = (v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in (px, py, qx, qy))
        row, blank, px, py, qx, qy = (v[known] for v in (row, blank, px, py, qx, qy))
        first, last = (np.ceil(f(px, qx) - 0.5).astype(np.int64) for f in (np.minimum, np.maximum))
        meets = [np.zeros((2, 0), np.int64), *[np.stack(v) for v in P._ranges(first, np.maximum(last - first, 0))]]
        edge, x = np.concatenate(meets, 1)
        y = py[edge] + (x + 0.5 - px[edge]) * (qy[edge] - py[edge]) / (qx[edge] - px[edge])
        y[blank[edge]] = -np.inf
        order = np.lexsort((y, x, group[row[edge]]))
        edge, x, y = edge[order], x[order], y[order]
        g, none = group[row[edge]], blank[edge]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))[:len(x)])
        number = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        top = np.flatnonzero((number[:-1] % 2 == 0) & (number[1:] > number[:-1]) & ~none[:-1] & ~none[1:])
        ys, ye = (np.ceil(v - 0.5).astype(np.int64) for v in (y[top], y[top + 1]))
        top, ys, ye = top[ye > ys], ys[ye > ys], ye[ye > ys]
        yield from P._flat(table, row[edge[top]], keys, x=x[top], ys=ys, ye=ye)

    return P.by_group(e, keys, kernel, f"{P.kinds(polygons, keys)}, x bigint, ys bigint, ye bigint")


# ---- annotations ----------------------------------------------------------------------

def coco_to_tracks(annotations: DataFrame, w: Column, h: Column, prediction: bool) -> DataFrame:
    """Relative xywh boxes, a probability and the object's 0-based position.

    ``annotations`` brings ``pos`` and either ``bbox_x..bbox_h`` or the
    inclusive mask box ``mx1..my2``.
    """
    box = [F.col(f"bbox_{c}") for c in "xywh"]
    absolute = F.greatest(*box) > 1.0
    from_mask = [F.col("mx1") / w, F.col("my1") / h, (F.col("mx2") - F.col("mx1") + 1) / w, (F.col("my2") - F.col("my1") + 1) / h]
    out = {}
    for name, b, dim, m in zip("xywh", box, (w, h, w, h), from_mask):
        given = F.when(absolute, b / dim).otherwise(b)
        out[name] = F.coalesce(F.when(F.col("bbox_x").isNotNull(), given), m, F.lit(0.0))
    return annotations.withColumns({**out, "prob": F.col("score") if prediction else F.lit(1.0), "obj_id": F.col("pos") - 1})


def drop_empty_masks(frames: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    return frames.join(runs.select(*keys).distinct(), keys, "left_semi")
