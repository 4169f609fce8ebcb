"""What users run on images: count, area, segment, plain inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import text as X
from visiontables.operators import components as C
from visiontables.operators import filters as FL
from visiontables.operators import measure as M
from visiontables.operators import nms as N
from visiontables.operators import packed as P
from visiontables.operators import runs as MR
from visiontables.operators import tiles as T
from visiontables.plans import hooks as H
from visiontables.session import checkpoint, discard, spread, written
from visiontables.sources import results as R

TILE, OVERLAP, SCALES, IOU = 512, 0.15, (1.0, 0.5), 0.5


def hashed_id(*parts) -> Column:
    """An id of 60 bits from what identifies a detection within its image: parts of any range, no packing."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def infer(images: DataFrame, detector: Callable, threshold: float = 0.5, tile: int = TILE, overlap: float = OVERLAP,
          scales: tuple = SCALES, iou: float = IOU, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Detections of tiled images in image pixels, de-duplicated across tiles
    and scales, and the runs ``(image_id, det_id, x, ys, ye)`` of their masks.

    ``keep`` names columns of ``images`` (such as the prompt) the detector sees
    and which separate de-duplication. Masks compete by pixels; where one of
    two detections has none, their boxes do.
    """
    kept, packs = _infer(images, detector, threshold, tile, overlap, scales, iou, keep)
    return kept, P.unpack(packs, ["image_id", "det_id"])


def _infer(images: DataFrame, detector: Callable, threshold: float = 0.5, tile: int = TILE, overlap: float = OVERLAP,
           scales: tuple = SCALES, iou: float = IOU, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """``infer`` with masks as packs: many runs, one row."""
    tiles = T.tile_grid(T.pyramid(images, list(scales)), tile, overlap, "sw", "sh")
    types = dict(images.dtypes)
    extra = ", ".join(f"{k} {types[k]}" for k in keep)
    found = H.detect(tiles.select("image_id", "scale", "tile_id", "tx0", "ty0", "tx1", "ty1", *keep), detector, extra=extra)
    key = ["image_id", "scale", "tile_id", *keep]
    level = F.array_position(F.array(*[F.lit(float(s)) for s in sorted(scales, reverse=True)]), F.col("scale"))
    found = FL.by_confidence(found, threshold).withColumn("det_id", hashed_id(level, "tile_id", "local_id", *keep)).drop("local_id")
    # written once: the steps below read it more than once, and the model must not run again
    found = written(found, "found")
    # tiles are guessed as small as the images they are unrolled from, and must not be broadcast
    grid = lambda *columns: tiles.select(*key, *columns).hint("merge")
    placed = T.tile_to_image(found.drop("counts"), grid("tx0", "ty0", "w", "h"), key)
    placed = written(FL.drop_degenerate(placed).drop("tile_id"), "placed")
    packs = written(_image_packs(found, grid("tx0", "ty0", "tx1", "ty1", "sw", "sh", "w", "h"), key), "packs")
    discard(found)
    kept = written(N.mask_nms(placed, packs, ["image_id", *keep], iou, order=[("score", "desc"), ("scale", "asc")]), "kept")
    discard(placed)
    return kept, _packs_of(packs, kept)


def _image_packs(found: DataFrame, tiles: DataFrame, key: list[str]) -> DataFrame:
    """Packs of tile masks in pixels of the whole image.

    Texts are short beside their runs, so they are spread before they are read.
    """
    masks = spread(found.where(F.col("counts").isNotNull()).select(*key, "det_id", "counts").join(tiles, key), *key)
    masks = MR.decode_coco_counts(masks, "counts", "lengths")
    at = [c for c in tiles.columns if c not in key]
    packs = MR.decode_runs(masks, [*key, "det_id", *at], F.col("ty1") - F.col("ty0"), counts="lengths", packed=True)
    packs = MR.place_masks(packs, F.col("tx0"), F.col("ty0"), F.col("sw"), F.col("sh"))
    packs = MR.resize_runs(packs, F.col("sw"), F.col("sh"), F.col("w"), F.col("h"))
    return packs.select("image_id", *key[3:], "det_id", P.RUNS)


def _packs_of(packs: DataFrame, rows: DataFrame) -> DataFrame:
    ids = rows.select("image_id", "det_id")
    return packs.join(ids, ["image_id", "det_id"], "left_semi").select("image_id", "det_id", P.RUNS)


def count_objects(images: DataFrame, detector: Callable, verifier: Callable, rephrase: Callable | None = None, retries: int = 2,
                  prompt: str = "prompt", **options) -> tuple[DataFrame, DataFrame]:
    """Verified detections, and raw, verified and rejected rows per image.

    With ``rephrase`` (see ``retry_unresolved``) images without any verified
    detection go round again, at most ``retries`` times, under a new
    ``prompt``, which the detector sees; rows then carry their ``attempt``.
    """
    def attempt(todo: DataFrame, n: int) -> DataFrame:
        keep = (prompt,) if rephrase else ()
        found = infer(todo, detector, keep=keep, **options)[0].join(todo.select("image_id", "w", "h"), "image_id")
        return H.verify(B.crop_window(found, "verify"), verifier, ["image_id", "det_id", "cx1", "cy1", "cx2", "cy2"]).drop("w", "h")

    rows = H.retry_unresolved(images, attempt, rephrase, ["image_id"], retries, prompt) if rephrase else checkpoint(attempt(images, 0))
    totals = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if("verified").alias("verified"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    totals = images.select("image_id").join(totals, "image_id", "left").select("image_id", zero("raw"), zero("verified"))
    return rows.where("verified"), totals.withColumn("rejected", F.col("raw") - F.col("verified"))


def count_answer(images: DataFrame, detector: Callable, verifier: Callable, rephrase: Callable | None = None, retries: int = 2,
                 prompt: str = "prompt", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a count answers: its objects, a summary per attempt, and totals per image.

    Objects are the verified rows with their ``object_type`` (from the prompt
    they were found under) and, where they have a mask, its oriented box
    (``cx, cy, bw, bh, angle``) and ``corners``, relative to the image. The
    summary counts raw, verified and rejected rows of each image and attempt;
    totals take the last attempt's verified and all rejected rows, and images
    without any row have zeros.
    """
    masks: list[DataFrame] = []

    def attempt(todo: DataFrame, n: int) -> DataFrame:
        found, packs = _infer(todo, detector, keep=(prompt,), **options)
        masks.append(packs)
        found = found.join(todo.select("image_id", "w", "h"), "image_id")
        return H.verify(B.crop_window(found, "verify"), verifier, ["image_id", "det_id", "cx1", "cy1", "cx2", "cy2"]).drop("w", "h", "cx1", "cy1", "cx2", "cy2")

    rows = H.retry_unresolved(images, attempt, rephrase or (lambda p, n: p), ["image_id"], retries if rephrase else 0, prompt)
    good = checkpoint(rows.where("verified"))
    packs = masks[0]
    for more in masks[1:]:
        packs = packs.unionByName(more)
    box = C.obb_from_mask(_packs_of(packs, good), ["image_id", "det_id"]).join(images.select("image_id", F.col("w").alias("_iw"), F.col("h").alias("_ih")), "image_id")
    box = box.withColumn("corners", B.obb_to_polygon(F.col("_iw"), F.col("_ih"))).drop("_iw", "_ih").withColumnsRenamed({"w": "bw", "h": "bh"})
    objects = good.withColumn("object_type", X.object_type(F.col(prompt))).join(box, ["image_id", "det_id"], "left")
    summary = checkpoint(M.verification_summary(rows, ["image_id"], F.col("verified")))
    totals = images.select("image_id").join(M.verification_totals(summary, ["image_id"]), "image_id", "left")
    return objects, summary, totals.na.fill(0, ["verified", "rejected", "attempts"])


def with_keywords(images: DataFrame, reply: str = "reply", query: str = "query") -> DataFrame:
    """Images with the ``keywords`` a model's reply names, or their query where it names none."""
    return images.withColumn("keywords", X.extract_keywords(F.col(reply), F.col(query)))


def measure_areas(images: DataFrame, detector: Callable, keywords: str = "keywords", verifier: Callable | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas per object and per image over several keywords, and the images
    whose ground resolution is not usable.

    An object found under an earlier keyword is not counted again. The area is
    the mask's, or the box's where there is no mask; with ``verifier`` only
    accepted objects count.
    """
    asked = images.select("*", F.posexplode(keywords).alias("keyword_no", "keyword")).drop(keywords)
    found, packs = _infer(asked, detector, keep=("keyword_no", "keyword"), **options)
    packs = written(packs, "packs")
    once = N.mask_nms(found, packs, ["image_id"], 0.5, order=[("keyword_no", "asc")], strict=True)
    if verifier is not None:
        sized = B.crop_window(once.join(images.select("image_id", "w", "h"), "image_id"), "verify")
        once = H.verify(sized, verifier, ["image_id", "det_id", "cx1", "cy1", "cx2", "cy2"]).where("verified").select(*found.columns)
    objects = M.measure_area(once, M.mask_area(P.unpack(packs, ["image_id", "det_id"]), ["image_id", "det_id"]), images)
    return objects, M.area_totals(objects, images), M.gsd_errors(images)


def segment(images: DataFrame, detector: Callable, prompts: str = "prompts", min_score: float = 0.0, wanted: DataFrame | None = None,
            verdict: Callable | None = None, attributes: dict | None = None, pixels: DataFrame | None = None,
            assess: tuple[Callable, Callable, int] | None = None, confident: tuple[str, ...] = ("HIGH", "MEDIUM"), **options) -> DataFrame:
    """One result document per image over all its prompts, with masks.

    ``attributes`` (see ``filters.by_attributes``) filter by size, aspect, and
    colour, for which ``pixels`` are needed; areas are those of masks, or of
    boxes where there is none. ``assess`` holds two models and a limit (see
    ``hooks.smart_confidence``); rows rated ``confident`` stay. ``verdict``
    replies on each detection; those without an Accept go. An image left
    without any has empty lists.
    """
    asked = images.select("*", F.posexplode(prompts).alias("prompt_no", "prompt")).drop(prompts)
    found, packs = _infer(asked, detector, keep=("prompt_no", "prompt"), **options)
    packs = written(packs, "packs")
    rows = FL.by_confidence(N.mask_nms(found, packs, ["image_id"], 0.4), min_score)
    if attributes:
        rows = _with_attributes(rows, packs, images, pixels, attributes)
    if wanted is not None:
        rows = FL.select_by_index(rows, wanted, ["image_id", "det_id"])
    if assess is not None:
        first, again, limit = assess
        rated = H.smart_confidence(checkpoint(rows), first, again, ["image_id"], limit)
        rows = rated.where(F.col("confidence").isin(*confident)).select(*rows.columns)
    if verdict is not None:
        replies = rows.select("image_id", "det_id", X.verdict(H.ask(verdict, "image_id", "det_id", "prompt", "x1", "y1", "x2", "y2", "score")).alias("verdict"))
        rows = FL.accept_verdicts(rows, replies, ["image_id", "det_id"])
    return infer_documents(rows, images, packs)


def _with_attributes(rows: DataFrame, packs: DataFrame, images: DataFrame, pixels: DataFrame | None, attributes: dict) -> DataFrame:
    key = ["image_id", "det_id"]
    mine = P.unpack(_packs_of(packs, rows), key)
    d = rows.join(M.mask_area(mine, key), key, "left").join(images.select("image_id", "w", "h"), "image_id")
    area = F.coalesce(F.col("area").cast("double"), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    d = d.withColumns({"size_ratio": B.size_ratio(area, F.col("w"), F.col("h")), "aspect": B.aspect_ratio()})
    if pixels is not None:
        d = d.join(M.mean_color(rows, mine, pixels, key), key)
    return FL.by_attributes(d, **attributes).select(*rows.columns)


def infer_documents(rows: DataFrame, images: DataFrame, packs: DataFrame) -> DataFrame:
    """Documents with boxes relative to the image, and masks (given as packs) as compressed texts."""
    rel = B.normalize_boxes(rows.join(images.select("image_id", "w", "h"), "image_id"))
    sized = _packs_of(packs, rows).join(images.select("image_id", "w", "h"), "image_id")
    counts = MR.encode_counts(sized, ["image_id", "det_id", "w", "h"], F.col("h"), F.col("w"))
    text = MR.encode_coco_counts(counts, "counts", "text")
    mask = text.select("image_id", "det_id", F.struct(F.col("text").alias("counts"), F.array("h", "w").alias("size")).alias("mask"))
    return R.to_documents(rel.drop("w", "h").join(mask, ["image_id", "det_id"], "left"), images)
