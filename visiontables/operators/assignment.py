"""One detection per track: assignments of largest total overlap."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.operators import packed as P
from visiontables.operators.nms import keys_above
from visiontables.operators.tracks import FRAME
from visiontables.session import checkpoint, is_empty

# pairs of a frame assigned whole in a task; ways tried at once, for so many matrices at a time
FRAME_PAIRS, _WAYS, _MATRICES = 4096, 120, 4096
_ASSIGNED = "det_id bigint, obj_id bigint, iou double"


def overlap_parts(pairs: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """``pairs`` with the connected part of its frame each belongs to (``part``, one of its tracks).

    Tracks that share a detection are linked, each to the detection's smallest
    track. Each round points every track to the one of lowest rank among itself
    and its neighbours, in an order drawn anew by hash, and moves the links to
    where their ends point, until none is left. However the ids run, links
    shrink by a share per round, and nothing is gathered.
    """
    pairs = checkpoint(pairs.select(*keys, "det_id", "obj_id", "iou"))
    least = pairs.groupBy(*keys, "det_id").agg(F.min("obj_id").alias("u"))
    links = pairs.join(least, [*keys, "det_id"]).select(*keys, "u", F.col("obj_id").alias("v")).where("u < v").distinct()
    links, labels, turn = checkpoint(links), pairs.select(*keys, "obj_id").distinct().withColumn("part", F.col("obj_id")), 0
    while not is_empty(links):
        turn += 1
        ranked = lambda c, name: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("id")).alias(name)
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy(*keys, "u").agg(F.min(ranked("v", "x")).alias("near")).select(*keys, "u", F.least("near", ranked("u", "own"))["id"].alias("p"))
        point = checkpoint(point)
        of = lambda end: point.select(*keys, F.col("u").alias(end), F.col("p").alias(f"p{end}"))
        moved = links.join(of("u"), [*keys, "u"]).join(of("v"), [*keys, "v"]).select(*keys, F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        links = checkpoint(moved.where("u < v").distinct())
        labels = checkpoint(labels.join(of("part"), [*keys, "part"], "left").select(*keys, "obj_id", F.coalesce("ppart", "part").alias("part")))
    return pairs.join(labels, [*keys, "obj_id"])


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row (-1: none) in an assignment of largest total gain.

    Rows are taken in one by one; each finds the shortest way, by reduced
    costs, through the columns taken so far to a free one. ``gain`` has no more
    rows than columns.
    """
    cost = gain.max() - gain if gain.size else gain
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        distance, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, here, reached = start, -1, 0.0
        while True:
            way = reached + cost[row] - row_price[row] - column_price
            better = ~done & (way < distance)
            distance[better], came[better] = way[better], here
            here = int(np.argmin(np.where(done, np.inf, distance)))
            done[here], reached = True, distance[here]
            if owner[here] < 0:
                break
            row = owner[here]
        last = reached
        inner = done & (owner >= 0)
        row_price[owner[inner]] += last - distance[inner]
        column_price[inner] -= last - distance[inner]
        row_price[start] += last
        while here >= 0:
            before = came[here]
            owner[here] = start if before < 0 else owner[before]
            here = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def _assign(table: pa.Table) -> pa.Table:
    table = table.sort_by([("det_id", "ascending"), ("obj_id", "ascending")])
    det, row = np.unique(table.column("det_id").to_numpy(), return_inverse=True)
    obj, column = np.unique(table.column("obj_id").to_numpy(), return_inverse=True)
    gain = np.zeros((len(det), len(obj)))
    gain[row, column] = table.column("iou").to_numpy()
    if len(det) <= len(obj):
        rows, columns = np.arange(len(det)), best_assignment(gain)
    else:
        rows, columns = best_assignment(gain.T), np.arange(len(obj))
    real = gain[rows, columns] > 0
    rows, columns = rows[real], columns[real]
    keys = [c for c in table.column_names if c not in ("det_id", "obj_id", "iou", "part")]
    held = [pa.array([table.column(k)[0].as_py()] * len(rows), table.schema.field(k).type) for k in keys]
    return pa.table([*held, pa.array(det[rows]), pa.array(obj[columns]), pa.array(gain[rows, columns])], names=[*keys, "det_id", "obj_id", "iou"])


def assign_one_to_one(pairs: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Pairs ``det_id, obj_id, iou`` of an assignment with the largest total IoU per frame.

    ``pairs`` are those that overlap. No detection and no track is in two
    pairs. Detections and tracks that do not hang together, directly or by way
    of others, are assigned apart: frames of few pairs (``FRAME_PAIRS``) whole
    in their task, others one connected part at a time. Among assignments of equal total, one is chosen by ids.
    """
    pairs = checkpoint(pairs.where("iou > 0").select(*keys, "det_id", "obj_id", "iou"))
    crowded = keys_above(pairs, keys, FRAME_PAIRS)
    if is_empty(crowded):
        return _assign_frames(pairs, keys)
    parts = overlap_parts(pairs.join(crowded, keys, "left_semi"), keys)
    kinds = [f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys]
    large = parts.groupBy(*keys, "part").applyInArrow(_assign, ", ".join([*kinds, _ASSIGNED]))
    return _assign_frames(pairs.join(crowded, keys, "left_anti"), keys).unionByName(large)


def _assign_frames(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same for frames of few pairs, many frames at a time."""
    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        det, iou = table.column("det_id").to_numpy(), table.column("iou").to_numpy()
        _, obj = np.unique(table.column("obj_id").to_numpy(), return_inverse=True)
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (det[1:] != det[:-1])))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(det))))
        _, some, column = np.unique(group * np.int64(obj.max() + 1) + obj, return_index=True, return_inverse=True)
        # the smallest detection reached marks the connected part
        part = np.arange(len(first))
        while True:
            least = np.full(len(some), len(first))
            np.minimum.at(least, column, part[row])
            near = np.minimum.reduceat(least[column], first)
            near = np.minimum(near, near[near])
            if (near == part).all():
                break
            part = near
        _, part = np.unique(part, return_inverse=True)
        of_column = part[row[some]]
        place, rows_of, n = _places(part)
        place_c, columns_of, m = _places(of_column)
        flip = n > m
        short, long = np.minimum(n, m), np.maximum(n, m)
        mine, r, c = part[row], place[row], place_c[column]
        r, c = np.where(flip[mine], c, r), np.where(flip[mine], r, c)
        for shape in np.unique(short * np.int64(len(det) + 1) + long):
            k, w = int(shape // (len(det) + 1)), int(shape % (len(det) + 1))
            which = np.flatnonzero((short == k) & (long == w))
            number = np.full(len(n), -1)
            number[which] = np.arange(len(which))
            use = number[mine] >= 0
            gain = np.zeros((len(which), k, w))
            gain[number[mine[use]], r[use], c[use]] = iou[use]
            chosen = _best_of_shape(gain)
            value = np.take_along_axis(gain, chosen[:, :, None], 2)[:, :, 0]
            one, i = np.nonzero(value > 0)
            j, p = chosen[one, i], which[one]
            dets = first[rows_of(p, np.where(flip[p], j, i))]
            objs = some[columns_of(p, np.where(flip[p], i, j))]
            taken = pa.array(dets)
            out = pa.table([*[table.column(x).take(taken) for x in keys], table.column("det_id").take(taken), table.column("obj_id").take(pa.array(objs)), pa.array(value[one, i])],
                           names=[*keys, "det_id", "obj_id", "iou"])
            yield from out.combine_chunks().to_batches()

    rows = P.known(pairs, [*keys, "det_id", "obj_id"])
    return P.by_group(rows, keys, kernel, f"{P.kinds(pairs, keys)}, {_ASSIGNED}", [F.col("det_id"), F.col("obj_id")])


def _places(part: np.ndarray):
    """The place of each node in its part, a function from part and place to the node, and the sizes of the parts."""
    order = np.argsort(part, kind="stable")
    size = np.bincount(part)
    start = np.cumsum(size) - size
    place = np.empty(len(part), np.int64)
    place[order] = np.arange(len(part)) - start[part[order]]
    return place, lambda p, k: order[start[p] + k], size


def _best_of_shape(gain: np.ndarray) -> np.ndarray:
    """``best_assignment`` of many matrices of one shape.

    Small ones try all ways at once; where several are as good but for
    rounding, ``best_assignment`` chooses.
    """
    count, n, m = gain.shape
    if math.perm(m, n) > _WAYS or n * m > 62:
        return np.stack([best_assignment(g) for g in gain])
    ways = np.array(list(itertools.permutations(range(m), n)))
    out = np.empty((count, n), np.int64)
    for lo in range(0, count, _MATRICES):
        g = gain[lo:lo + _MATRICES]
        total, pairs = np.zeros((len(g), len(ways))), np.zeros((len(g), len(ways)), np.int64)
        for k in range(n):
            value = g[:, k, ways[:, k]]
            total += value
            pairs |= np.where(value > 0, np.int64(1) << (k * m + ways[:, k]), 0)
        best = total.argmax(axis=1)
        own = np.take_along_axis(pairs, best[:, None], 1)
        open_ = ((total > total.max(axis=1, keepdims=True) - 1e-9) & (pairs != own)).any(axis=1)
        out[lo:lo + len(g)] = ways[best]
        for i in np.flatnonzero(open_):
            out[lo + i] = best_assignment(g[i])
    return out


def associate_one_to_one(dets: DataFrame, tracks: DataFrame, pairs: DataFrame, threshold: float = 0.1, track_threshold: float = 0.5, new_score: float = 0.7) -> DataFrame:
    """Every detection and track of a frame with what it is: ``matched`` pairs, ``new`` detections, ``unmatched`` tracks.

    A track is matched to the detection assigned to it, if they overlap by
    ``track_threshold``. A detection is new if it scores ``new_score`` and
    overlaps no track by ``threshold``, assigned or not; on a frame without
    tracks all are. On a frame without detections no track is unmatched.
    """
    none = F.lit(None).cast("bigint")
    matched = checkpoint(assign_one_to_one(pairs).where(F.col("iou") >= track_threshold))
    lone = dets.join(tracks.select(*FRAME).distinct().withColumn("_t", F.lit(True)), FRAME, "left")
    new = lone.where(F.col("_t").isNull() | (F.col("score") >= new_score))
    new = new.join(pairs.where(F.col("iou") >= threshold).select(*FRAME, "det_id"), [*FRAME, "det_id"], "left_anti")
    left = tracks.join(dets.select(*FRAME).distinct(), FRAME, "left_semi").join(matched.select(*FRAME, "obj_id"), [*FRAME, "obj_id"], "left_anti")
    kind = lambda df, name: df.withColumn("kind", F.lit(name)).select(*FRAME, "kind", "det_id", "obj_id", "iou")
    zero = F.lit(None).cast("double").alias("iou")
    return kind(matched, "matched").unionByName(kind(new.select(*FRAME, "det_id", none.alias("obj_id"), zero), "new")).unionByName(
        kind(left.select(*FRAME, none.alias("det_id"), "obj_id", zero), "unmatched"))
