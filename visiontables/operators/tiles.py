"""Tile grids over tables of image sizes.

A tile's place follows from the image size alone, so every function here is a
projection plus an explode: no join, no shuffle, and tile numbers need no
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pyramid(images: DataFrame, scales: list[float], drop_invalid: bool = False) -> DataFrame:
    """One row per image and scale, with the scaled size ``sw, sh``."""
    if drop_invalid:
        scales = [s for s in scales if s > 0]
    elif any(s <= 0 for s in scales):
        raise ValueError("scales must be positive")
    ordered = sorted(scales, reverse=True)
    levels = F.array(*[F.lit(float(s)) for s in ordered])
    out = images.select("*", F.posexplode(levels).alias("level", "scale"))
    return out.withColumns({"sw": (F.col("w") * F.col("scale")).cast("bigint"),
                            "sh": (F.col("h") * F.col("scale")).cast("bigint")})


def _starts(dim: Column, tile: int, stride: int) -> Column:
    """Starts of full-size tiles up to the first that reaches the edge."""
    steps = F.greatest(F.lit(0), F.ceil((dim - tile) / float(stride)))
    raw = F.sequence(F.lit(0).cast("bigint"), (steps * stride).cast("bigint"), F.lit(stride).cast("bigint"))
    return F.transform(raw, lambda s: F.greatest(F.lit(0).cast("bigint"), F.least(s, dim - tile)))


def tile_grid(images: DataFrame, tile: int, overlap: float, w: str = "w", h: str = "h") -> DataFrame:
    """Tiles whose last row and column are shifted back to stay full size."""
    stride = int(tile * (1 - overlap))
    out = images.withColumns({"_xs": _starts(F.col(w), tile, stride), "_ys": _starts(F.col(h), tile, stride)})
    return _explode_grid(out, tile, w, h)


def tile_grid_truncated(images: DataFrame, tile: int = 1024, overlap: float = 0.2, least: int = 512,
                        w: str = "w", h: str = "h") -> DataFrame:
    """Tiles cut off at the image edge; cut tiles below ``least`` are dropped.

    An image that fits one tile, or that would lose every tile, is one tile.
    """
    stride = tile - int(tile * overlap)

    def starts(dim: Column) -> Column:
        raw = F.sequence(F.lit(0).cast("bigint"), F.greatest(dim - 1, F.lit(0)).cast("bigint"), F.lit(stride).cast("bigint"))
        return F.filter(raw, lambda s: F.least(s + tile, dim) - s >= least)

    W, H = F.col(w), F.col(h)
    whole = ((W <= tile) & (H <= tile)) | (W < least) | (H < least)
    origin = F.array(F.lit(0).cast("bigint"))
    out = images.withColumns({"_whole": whole,
                              "_xs": F.when(whole, origin).otherwise(starts(W)),
                              "_ys": F.when(whole, origin).otherwise(starts(H))})
    return _explode_grid(out, tile, w, h, F.col("_whole")).drop("_whole")


def _explode_grid(df: DataFrame, tile: int, w: str, h: str, whole: Column | None = None) -> DataFrame:
    df = df.select("*", F.posexplode("_ys").alias("_iy", "y0"))
    df = df.select("*", F.posexplode("_xs").alias("_ix", "x0"))
    x1, y1 = F.least(F.col("x0") + tile, F.col(w)), F.least(F.col("y0") + tile, F.col(h))
    if whole is not None:
        x1, y1 = F.when(whole, F.col(w)).otherwise(x1), F.when(whole, F.col(h)).otherwise(y1)
    return df.withColumns({
        "tile_id": (F.col("_iy") * F.size("_xs") + F.col("_ix")).cast("bigint"),
        "tx1": x1, "ty1": y1,
    }).withColumnsRenamed({"x0": "tx0", "y0": "ty0"}).drop("_xs", "_ys", "_ix", "_iy")


def batch_tiles(tiles: DataFrame, size: int = 16) -> DataFrame:
    """Number consecutive chunks of tiles within an image and scale."""
    return tiles.withColumn("batch_id", F.floor(F.col("tile_id") / size).cast("bigint"))


def tile_stats(tiles: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return tiles.groupBy(*keys).agg(
        n.alias("tiles"), F.count_if(failed).alias("failed"), (n - F.count_if(failed)).alias("successful"))


def tile_to_image(dets: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes in tile pixels of a scaled image to pixels of the original.

    ``tiles`` brings ``tx0, ty0, scale`` and the original size ``w, h``.
    """
    j = dets.join(tiles.select(*keys, "tx0", "ty0", "w", "h"), keys)
    out = {}
    for name, off, dim in (("x1", "tx0", "w"), ("y1", "ty0", "h"), ("x2", "tx0", "w"), ("y2", "ty0", "h")):
        moved = (F.col(name) + F.col(off)) / F.col("scale")
        out[name] = F.greatest(F.lit(0.0), F.least(moved, F.col(dim).cast("double")))
    return j.withColumns(out).drop("tx0", "ty0", "w", "h")


def region_to_image(dets: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes relative to a region to boxes relative to the whole image."""
    j = dets.join(regions.select(*keys, "tx0", "ty0", "tx1", "ty1", "w", "h"), keys)
    rw, rh = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    out = {}
    for name, side, off, dim in (("x1", rw, "tx0", "w"), ("y1", rh, "ty0", "h"), ("x2", rw, "tx0", "w"), ("y2", rh, "ty0", "h")):
        out[name] = (F.col(name) * side + F.col(off)) / F.col(dim)
    return j.withColumns(out).drop("tx0", "ty0", "tx1", "ty1", "w", "h")
