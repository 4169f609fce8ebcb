"""Greedy de-duplication (non-maximum suppression) and leader clustering.

The greedy answer is: walk the rows of a key in rank order and keep a row
unless a kept row conflicts with it. Two physical forms give that same answer.

* ``fold``: keys of at most ``fold_limit`` rows are gathered into an array and
  folded inside the JVM; one shuffle, and the array has a fixed largest size.
* ``rounds``: any larger key. Rows enter the cells of ``overlap.explode_cells``,
  which every conflicting pair shares. Each round looks at the ``FRONT``
  best-ranked undecided rows of every cell. A row that is among them in all of
  its cells, and conflicts with none ranked before it, is kept; undecided rows
  that conflict with it drop out. A row meets at most ``FRONT`` others per cell,
  so a round is linear in the rows however full a cell is, and no group is
  gathered. The best undecided row of a key always wins, so rounds come to an end.
  Exact copies lose to their best-ranked twin up front. Undecided rows conflict
  only with undecided rows, so a key that has shrunk to ``fold_limit`` of them
  is finished by the fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.operators import overlap as O
from visiontables.operators import packed as P
from visiontables.session import checkpoint, is_empty, spread

Order = list[tuple[str, str]]
FRONT = 64
_ROW = ["x1", "y1", "x2", "y2"]
_BOX_LEVELS = 10_000


def rank_columns(order: Order, row: str) -> list[Column]:
    """Columns that sort ascending in rank order; the row id settles ties."""
    out = []
    for i, (name, way) in enumerate(order):
        out.append((-F.col(name) if way == "desc" else F.col(name)).alias(f"_o{i}"))
    return [*out, F.col(row).alias("_row")]


def keys_above(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys of more than ``limit`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return checkpoint(counts.where(F.col("_n") > limit).select(*keys))


def split_by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with at most ``limit`` rows, and the rest."""
    large = keys_above(df, keys, limit)
    if is_empty(large):
        return df, df.limit(0)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def nms(dets: DataFrame, keys: list[str], threshold: float, order: Order = (("score", "desc"),),
        strict: bool = False, row: str = "det_id", fold_limit: int = 512, sizes: DataFrame | None = None) -> DataFrame:
    """Rows kept by box de-duplication, with all their columns.

    ``strict`` suppresses above the threshold only, otherwise at it as well.
    ``sizes`` has at least the rows of ``dets`` and tells keys of many rows from
    the others in its place, where it takes less to work out.
    """
    if strict and threshold >= 1:
        return dets

    def conflict(a, b) -> Column:
        v = B.iou(a, b)
        return v > threshold if strict else v >= threshold

    meets = (lambda v: v > threshold) if strict else (lambda v: v >= threshold)
    large_keys = keys_above(dets if sizes is None else sizes, keys, fold_limit)
    dets = dets.select(*keys, row, *[c for c in dets.columns if c not in (*keys, row)])
    if is_empty(large_keys):
        return P.fold_boxes(dets, keys, _walk(order, row), row, _ROW, meets)
    small, large = (dets.join(large_keys, keys, how) for how in ("left_anti", "left_semi"))
    rows = large.select(*keys, *rank_columns(list(order), row), *_ROW)
    ranks = [c for c in rows.columns if c.startswith("_o")] + ["_row"]
    kept = _rounds(rows, keys, ranks, _meet_in_cells(keys, ranks, lambda a, b: conflict(
                       [b[c] for c in _ROW], [a[c] for c in _ROW])),
                   lambda df: O.explode_cells(df.withColumns(O.core_columns(threshold)), O.level_span(threshold)),
                   lambda df: P.fold_boxes(df, keys, [F.col(c) for c in [*ranks, *_ROW]], "_row", _ROW, meets).select(*keys, "_row"),
                   fold_limit, copies=_ROW)
    ids = reduce(DataFrame.unionByName, kept).withColumnRenamed("_row", row)
    won = large.join(ids, [*keys, row], "left_semi").select(*dets.columns)
    return P.fold_boxes(small, keys, _walk(order, row), row, _ROW, meets).unionByName(won) if fold_limit > 0 else won


def _walk(order: Order, row: str) -> list[Column]:
    """The order of a greedy pass; boxes settle what ids leave open."""
    return [*[-F.col(name) if way == "desc" else F.col(name) for name, way in order], F.col(row), *[F.col(c) for c in _ROW]]


def _cell(keys: list[str]) -> list[str]:
    return [*keys, "cell_lvl", "cell_x", "cell_y"]


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], ranks: list[str], ordered: bool) -> DataFrame:
    """Rows ``l`` and ``r`` that share a cell; ``ordered`` keeps r ranked before l."""
    pack = lambda df, name: df.select(*_cell(keys), F.struct(*[c for c in df.columns if c not in _cell(keys)]).alias(name))
    j = pack(left, "l").join(pack(right, "r"), _cell(keys))
    if ordered:
        rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in ranks])
        return j.where(rank("r") < rank("l"))
    return j.where(F.col("l._row") != F.col("r._row"))


def _meet_in_cells(keys: list[str], ranks: list[str], conflict) -> Callable[[DataFrame, DataFrame, bool], DataFrame]:
    """Left rows that conflict with a right row of a cell they share."""
    def meet(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        hit = _pairs(left, right, keys, ranks, ordered).where(conflict(F.col("l"), F.col("r")))
        return hit.select(*keys, F.col("l._row").alias("_row")).distinct()

    return meet


def _rounds(rows: DataFrame, keys: list[str], ranks: list[str], meet: Callable[[DataFrame, DataFrame, bool], DataFrame],
            cells: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], fold_limit: int,
            copies: list[str] | None = None) -> list[DataFrame]:
    """Decide all rows in linear rounds; returns the kept (keys, _row) parts."""
    done: list[DataFrame] = []
    positive = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    if copies:
        # a box without area overlaps nothing, not even its own copies
        done.append(checkpoint(rows.where(~positive).select(*keys, "_row")))
        rows = rows.where(positive)
        best = rows.groupBy(*keys, *copies).agg(F.min(F.struct(*ranks)).alias("_r"))
        rows = best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in ranks], *copies)
    open_rows = checkpoint(rows)
    best_first = Window.partitionBy(*_cell(keys)).orderBy(*ranks)
    while True:
        if fold_limit > 0:
            few, open_rows = split_by_size(open_rows, keys, fold_limit)
            if not is_empty(few):
                done.append(checkpoint(finish(few)))
        if is_empty(open_rows):
            return done
        spread = cells(open_rows)
        front = spread.withColumn("_rn", F.row_number().over(best_first)).where(F.col("_rn") <= FRONT).drop("_rn")
        whole = (front.groupBy(*keys, "_row").agg(F.count(F.lit(1)).alias("_n"), F.first("ncells").alias("ncells"))
                 .where(F.col("_n") == F.col("ncells")).select(*keys, "_row"))
        won_ids = whole.join(meet(front, front, True), [*keys, "_row"], "left_anti")
        won = checkpoint(open_rows.join(won_ids, [*keys, "_row"], "left_semi"))
        done.append(won.select(*keys, "_row"))
        gone = meet(spread, cells(won), False).unionByName(won.select(*keys, "_row"))
        open_rows = checkpoint(open_rows.join(gone, [*keys, "_row"], "left_anti"))


# ---- masks --------------------------------------------------------------------

def mask_nms(dets: DataFrame, runs: DataFrame, keys: list[str], threshold: float,
             order: Order = (("score", "desc"),), strict: bool = False, box_fallback: bool = True,
             row: str = "det_id", fold_limit: int = 512, band: int = 64, tile: int = 16, fold_runs: int = 1 << 18) -> DataFrame:
    """De-duplication by mask IoU.

    With ``box_fallback`` a pair of which one side has no mask is compared by
    boxes; otherwise rows without a mask conflict with nothing. ``runs`` holds
    (keys, row, x, ys, ye), or packs of them. Keys of at most ``fold_limit`` rows and
    ``fold_runs`` runs are folded whole in their task, from packs of their
    masks. Keys of more runs fold over conflict lists found by a join; those of
    more rows go through rounds in which masks compete within image squares of
    ``tile`` pixels.
    """
    meets = (lambda c: c > threshold) if strict else (lambda c: c >= threshold)
    if box_fallback:
        O.shrink_factor(threshold)
    rows = dets.select(*keys, *rank_columns(list(order), row), *_ROW)
    ranks = [c for c in rows.columns if c.startswith("_o")] + ["_row"]
    packed = P.is_packed(runs)
    runs = runs.select(*keys, F.col(row).alias("_row"), *((P.RUNS,) if packed else ("x", "ys", "ye")))
    number = F.sum(P.most_runs()) if packed else F.count(F.lit(1))
    crowded = rows.groupBy(*keys).agg((F.count(F.lit(1)) > fold_limit).alias("_many"), F.lit(False).alias("_wide")).where("_many")
    wide = runs.groupBy(*keys).agg(F.lit(False).alias("_many"), (number > fold_runs).alias("_wide")).where("_wide")
    apart = checkpoint(crowded.unionByName(wide).groupBy(*keys).agg(F.bool_or("_many").alias("_many")))
    if is_empty(apart):
        kept = [P.fold_masks(rows, runs, keys, ranks, _ROW, meets, box_fallback)]
    else:
        part = lambda df, which, how: df.join(which.select(*keys), keys, how)
        kept = [P.fold_masks(part(rows, apart, "left_anti"), part(runs, apart, "left_anti"), keys, ranks, _ROW, meets, box_fallback)]
        runs = part(runs, apart, "left_semi")
        runs = P.unpack(runs, [*keys, "_row"]) if packed else runs
        rows = part(rows, apart, "left_semi").join(O.mask_areas(runs, [*keys, "_row"], "_area"), [*keys, "_row"], "left").select(*keys, *ranks, *_ROW, "_area")
        kept.append(_fold_masks(part(rows, apart.where("not _many"), "left_semi"), runs, keys, ranks, meets, threshold, box_fallback, band))
        large = part(rows, apart.where("_many"), "left_semi")
        if not is_empty(large):
            kept += _mask_rounds(large, runs, keys, ranks, meets, threshold, box_fallback, band, tile, fold_limit)
    ids = reduce(DataFrame.unionByName, kept).withColumnRenamed("_row", row)
    return dets.join(ids, [*keys, row], "left_semi")


def _fold_masks(rows, runs, keys, ranks, meets, threshold, box_fallback, band) -> DataFrame:
    mine = runs.join(rows.select(*keys, "_row"), [*keys, "_row"], "left_semi")
    inter = O.mask_intersections(mine, mine, keys, "_row", "_row", once=True)
    size = rows.select(*keys, F.col("_row"), "_area").where(F.col("_area").isNotNull())
    a = size.withColumnsRenamed({"_row": "_a", "_area": "_aa"})
    b = size.withColumnsRenamed({"_row": "_b", "_area": "_ab"})
    pairs = inter.join(a, [*keys, "_a"]).join(b, [*keys, "_b"])
    pairs = pairs.where(meets(F.col("inter") / (F.col("_aa") + F.col("_ab") - F.col("inter")))).select(*keys, "_a", "_b")
    if box_fallback:
        # only pairs that lack a mask; a full comparison costs nothing when all rows have one
        bare = rows.where(F.col("_area").isNull())
        boxed = O.iou_join(rows.withColumn("_m", F.col("_area").isNotNull()), bare, threshold, keys, "_row", "_row", carry_a=["_m"])
        boxed = boxed.where(meets(F.col("iou")) & (F.col("_row") != F.col("_row_2")))
        boxed = boxed.select(*keys, F.col("_row").alias("_a"), F.col("_row_2").alias("_b"))
        pairs = pairs.unionByName(boxed)
    both = pairs.unionByName(pairs.select(*keys, F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    foes = both.groupBy(*keys, F.col("_a").alias("_row")).agg(F.collect_set("_b").alias("_foes"))
    full = rows.join(foes, [*keys, "_row"], "left")
    arr = spread(full, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ranks, "_foes"))).alias("_a"))
    none = F.transform(F.slice("_a", 1, 0), lambda s: s["_row"])
    step = lambda acc, d: F.when(F.coalesce(F.arrays_overlap(acc, d["_foes"]), F.lit(False)), acc).otherwise(
        F.concat(acc, F.array(d["_row"])))
    return arr.select(*keys, F.explode(F.aggregate("_a", none, step)).alias("_row"))


def _mask_rounds(rows, runs, keys, ranks, meets, threshold, box_fallback, band, tile, fold_limit) -> list[DataFrame]:
    span = O.level_span(threshold)
    mine = checkpoint(runs.join(rows.select(*keys, "_row"), [*keys, "_row"], "left_semi"))
    squares = O.split_bands(mine, tile).select(
        *keys, "_row", F.floor(F.col("x") / tile).alias("cell_x"), F.col("band").alias("cell_y")).distinct()
    squares = checkpoint(squares)

    def cells(df: DataFrame) -> DataFrame:
        # masks of similar area compete in shared squares; the level tells the two families apart
        masked = df.where(F.col("_area").isNotNull()).join(squares, [*keys, "_row"])
        lvl = F.ceil(F.log2(F.col("_area") * 1.0001234567)).cast("int")
        masked = masked.withColumn("cell_lvl", F.explode(F.sequence(lvl, lvl + span)))
        if box_fallback:
            boxed = O.explode_cells(df.withColumns(O.core_columns(threshold)), span)
            boxed = boxed.withColumn("cell_lvl", F.col("cell_lvl") + _BOX_LEVELS).select(*masked.columns)
            masked = masked.unionByName(boxed)
        # a private cell keeps rows without any other cell in play
        own = df.select(*df.columns, F.lit(-_BOX_LEVELS).alias("cell_lvl"), F.col("_row").alias("cell_x"),
                        F.lit(0).cast("bigint").alias("cell_y"))
        out = masked.unionByName(own.select(*masked.columns))
        n = out.groupBy(*keys, "_row").agg(F.count(F.lit(1)).cast("int").alias("ncells"))
        return out.join(n, [*keys, "_row"])

    def meet(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        pairs = _pairs(left, right, keys, ranks, ordered)
        bare = F.col("l._area").isNull() | F.col("r._area").isNull()
        both = pairs.where(~bare & (F.col("cell_lvl") < _BOX_LEVELS // 2)).select(
            *keys, F.col("l._row").alias("_a"), F.col("r._row").alias("_b"),
            F.col("l._area").alias("_aa"), F.col("r._area").alias("_ab")).distinct()
        hit = _pair_intersections(both).where(meets(F.col("inter") / (F.col("_aa") + F.col("_ab") - F.col("inter"))))
        out = hit.select(*keys, F.col("_a").alias("_row"))
        if box_fallback:
            box = lambda side: [F.col(f"{side}.{c}") for c in _ROW]
            boxed = pairs.where(bare & meets(B.iou(box("r"), box("l"))))
            out = out.unionByName(boxed.select(*keys, F.col("l._row").alias("_row")))
        return out.distinct()

    def _pair_intersections(near: DataFrame) -> DataFrame:
        left = near.join(mine.withColumnsRenamed({"_row": "_a", "ys": "_ays", "ye": "_aye"}), [*keys, "_a"])
        right = mine.withColumnsRenamed({"_row": "_b", "ys": "_bys", "ye": "_bye"})
        j = left.join(right, [*keys, "_b", "x"]).where((F.col("_ays") < F.col("_bye")) & (F.col("_bys") < F.col("_aye")))
        return j.groupBy(*keys, "_a", "_b", "_aa", "_ab").agg(
            F.sum(F.least("_aye", "_bye") - F.greatest("_ays", "_bys")).alias("inter"))

    def finish(df: DataFrame) -> DataFrame:
        return _fold_masks(df, mine, keys, ranks, meets, threshold, box_fallback, band)

    return _rounds(rows, keys, ranks, meet, cells, finish, fold_limit)


# ---- clustering ---------------------------------------------------------------

def leader_cluster(dets: DataFrame, keys: list[str], distance: float = 0.15, order: Order = (),
                   row: str = "det_id", fold_limit: int = 512) -> DataFrame:
    """Add ``leader``: the row that opened the cluster each row belongs to.

    In input order, a row not yet taken opens a cluster and takes the later
    free rows whose centre is nearer than ``distance`` of the diagonal spanned
    by the largest x2 and y2 of the key. Leaders are thus the rows a
    de-duplication by centre distance keeps, and every other row belongs to the
    first leader near it.
    """
    large_keys = keys_above(dets, keys, fold_limit)
    dets = dets.select(*keys, row, *[c for c in dets.columns if c not in (*keys, row)])
    place = {"px": B.center_x(), "py": B.center_y()}
    fold = lambda df: P.fold_centres(df.withColumns(place), keys, [*_walk(order, row)[:-len(_ROW)], F.col("px"), F.col("py")], row, distance)
    if is_empty(large_keys):
        return fold(dets)
    small, dets = (dets.join(large_keys, keys, how) for how in ("left_anti", "left_semi"))
    reach = dets.groupBy(*keys).agg(F.max("x2").alias("_mx"), F.max("y2").alias("_my"))
    diag = F.sqrt(F.col("_mx") * F.col("_mx") + F.col("_my") * F.col("_my"))
    pts = dets.join(reach, keys).select(
        *keys, *rank_columns(list(order), row),
        B.center_x().alias("px"), B.center_y().alias("py"), diag.alias("diag"))
    ranks = [c for c in pts.columns if c.startswith("_o")] + ["_row"]

    def close(a, b, diag) -> Column:
        dx, dy = a[0] - b[0], a[1] - b[1]
        d = F.sqrt(dx * dx + dy * dy)
        return F.when(diag > 0, d / diag).otherwise(F.lit(0.0)) < distance

    out = _cluster_rounds(pts, keys, ranks, close, distance, fold_limit).withColumnRenamed("_row", row)
    named = dets.join(out, [*keys, row])
    return fold(small).unionByName(named) if fold_limit > 0 else named


def _cluster_rounds(pts: DataFrame, keys: list[str], ranks: list[str], close, distance: float, fold_limit: int) -> DataFrame:
    pts = checkpoint(pts)
    radius = F.greatest(F.col("diag") * distance, F.lit(1e-9))

    def cells(df: DataFrame) -> DataFrame:
        # squares of the radius' size; points within the radius share one that both half-squares touch
        half = radius * 0.5000001
        rng = lambda v: F.sequence(F.floor((F.col(v) - half) / radius), F.floor((F.col(v) + half) / radius))
        grid = F.flatten(F.transform(rng("px"), lambda x: F.transform(rng("py"), lambda y: F.struct(
            x.alias("cell_x"), y.alias("cell_y")))))
        df = df.withColumns({"_g": grid, "cell_lvl": F.lit(0)})
        return df.withColumn("ncells", F.size("_g")).select("*", F.inline("_g")).drop("_g")

    near = lambda l, r: close((r["px"], r["py"]), (l["px"], l["py"]), l["diag"])

    # copies of a point follow its first one: only that one can lead
    best = pts.groupBy(*keys, "px", "py", "diag").agg(F.min(F.struct(*ranks)).alias("_r"))
    firsts = best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in ranks], "px", "py", "diag")
    shaped = firsts.withColumns({c: F.lit(0.0) for c in _ROW})
    def finish(df: DataFrame) -> DataFrame:
        folded = P.fold_centres(df, keys, [F.col(c) for c in [*ranks, "px", "py"]], "_row", distance)
        return folded.where(F.col("_row") == F.col("leader")).select(*keys, "_row")

    ids = reduce(DataFrame.unionByName, _rounds(
        shaped, keys, ranks, _meet_in_cells(keys, ranks, near), cells, finish, fold_limit))
    leaders = checkpoint(firsts.join(ids, [*keys, "_row"], "left_semi"))
    pack = lambda df, name: cells(df).select(*_cell(keys), F.struct(*ranks, "px", "py", "diag").alias(name))
    hit = pack(firsts, "l").join(pack(leaders, "r"), _cell(keys)).where(near(F.col("l"), F.col("r")))
    hit = hit.groupBy(*keys, F.col("l._row").alias("_row")).agg(F.min(F.struct(*[F.col(f"r.{c}") for c in ranks])).alias("_w"))
    # a leader stays its own even where an earlier leader's reach rounds to it
    own = leaders.select(*keys, "_row", F.lit(True).alias("_own"))
    named = firsts.join(hit, [*keys, "_row"]).join(own, [*keys, "_row"], "left").select(
        *keys, "px", "py", F.when(F.col("_own"), F.col("_row")).otherwise(F.col("_w._row")).alias("leader"))
    return pts.join(named, [*keys, "px", "py"]).select(*keys, "_row", "leader")


def cluster_extent(clustered: DataFrame, keys: list[str], images: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """Bounding box and size of each cluster.

    With ``images`` (sizes ``w, h``) each box is put right first: relative ones
    are scaled, inverted corners swapped, all kept inside the image.
    """
    c = clustered
    if images is not None:
        c = c.join(images.select(image, F.col("w").alias("_w"), F.col("h").alias("_h")), image)
        relative = F.greatest("x1", "y1", "x2", "y2").between(0, 1) & F.least("x1", "y1", "x2", "y2").between(0, 1)
        for lo, hi, size in (("x1", "x2", "_w"), ("y1", "y2", "_h")):
            a, b = (F.when(relative, F.col(k) * F.col(size)).otherwise(F.col(k)) for k in (lo, hi))
            small, large = F.least(a, b), F.greatest(a, b)
            c = c.withColumns({"_" + lo: F.greatest(F.lit(0.0), F.least(small, F.col(size) - 1)), "_" + hi: F.greatest(F.lit(0.0), F.least(large, F.col(size)))})
        c = c.drop("x1", "y1", "x2", "y2", "_w", "_h").withColumnsRenamed({"_" + k: k for k in ("x1", "y1", "x2", "y2")})
    return c.groupBy(*keys, "leader").agg(
        F.count(F.lit(1)).alias("members"), F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def nms_report(dets: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows kept and removed per key."""
    a = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    b = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    k = F.coalesce("kept", F.lit(0).cast("bigint"))
    return a.join(b, keys, "left").select(*keys, "total", k.alias("kept"), (F.col("total") - k).alias("removed"))
