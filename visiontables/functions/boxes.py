"""Box arithmetic as Column expressions and small DataFrame helpers.

Boxes are four DOUBLE columns ``x1, y1, x2, y2``; rotated boxes are
``cx, cy, w, h, angle`` with the angle in degrees, counter-clockwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]
RBOX = ["cx", "cy", "w", "h", "angle"]


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))


def box_columns(suffix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c + suffix) for c in BOX)


def area(box) -> Column:
    x1, y1, x2, y2 = box
    return (x2 - x1) * (y2 - y1)


def intersection(a, b) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a, b, guard: str = "union") -> Column:
    """Box IoU. ``guard``: 0 when the union is not positive, 0 when the
    intersection is not positive, or unguarded (0/0 is NaN)."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    if guard == "union":
        return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    if guard == "intersection":
        return F.when(inter > 0, inter / union).otherwise(F.lit(0.0))
    if guard == "none":
        return F.when(union == 0, F.lit(float("nan"))).otherwise(inter / union)
    raise ValueError(f"unknown guard {guard}")


def ioa(a, b) -> Column:
    """Intersection over the area of ``b``, 0 when they do not meet."""
    inter = intersection(a, b)
    return F.when(inter > 0, inter / area(b)).otherwise(F.lit(0.0))


def giou(a, b) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return inter / union - (hull - union) / hull


# ---- format changes -------------------------------------------------------

def convert_boxes(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the box columns from one format to another.

    Formats: ``xyxy`` (x1,y1,x2,y2), ``xywh`` (x,y,w,h), ``cxcywh``
    (cx,cy,w,h), ``xywha`` (cx,cy,w,h,angle).
    """
    if source == target:
        return df
    c = F.col
    half = lambda name: c(name) / 2.0
    if (source, target) == ("xyxy", "xywh"):
        new = {"x": c("x1"), "y": c("y1"), "w": c("x2") - c("x1"), "h": c("y2") - c("y1")}
    elif (source, target) == ("xywh", "xyxy"):
        new = {"x1": c("x"), "y1": c("y"), "x2": c("x") + c("w"), "y2": c("y") + c("h")}
    elif (source, target) == ("xyxy", "cxcywh"):
        new = {"cx": (c("x1") + c("x2")) / 2.0, "cy": (c("y1") + c("y2")) / 2.0,
               "w": c("x2") - c("x1"), "h": c("y2") - c("y1")}
    elif (source, target) == ("cxcywh", "xyxy"):
        new = {"x1": c("cx") - half("w"), "y1": c("cy") - half("h"), "x2": c("cx") + half("w"), "y2": c("cy") + half("h")}
    elif (source, target) == ("xywh", "xywha"):
        new = {"cx": c("x") + half("w"), "cy": c("y") + half("h"), "w": c("w"), "h": c("h"), "angle": F.lit(0.0)}
    elif (source, target) == ("xywha", "xyxy"):
        hw, hh = hull_size()
        new = {"x1": c("cx") - hw / 2.0, "y1": c("cy") - hh / 2.0,
               "x2": c("cx") - hw / 2.0 + hw, "y2": c("cy") - hh / 2.0 + hh}
    else:
        raise NotImplementedError(f"no conversion from {source} to {target}")
    old = {"xyxy": BOX, "xywh": ["x", "y", "w", "h"], "cxcywh": RBOX[:4], "xywha": RBOX}[source]
    rest = [F.col(n) for n in df.columns if n not in old]
    return df.select(*rest, *[e.alias(n) for n, e in new.items()])


def normalize_boxes(df: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    return df.withColumns({"x1": F.col("x1") / F.col(w), "y1": F.col("y1") / F.col(h),
                           "x2": F.col("x2") / F.col(w), "y2": F.col("y2") / F.col(h)})


def denormalize_boxes(df: DataFrame, w: str = "w", h: str = "h", integer: bool = False) -> DataFrame:
    """Relative to pixel boxes; the integer form floors and clamps to [0, dim-1]."""
    out = {}
    for name, dim in zip(BOX, (w, h, w, h)):
        value = F.col(name) * F.col(dim)
        if integer:
            value = clamp(F.floor(value), F.lit(0).cast("bigint"), F.col(dim) - 1)
        out[name] = value
    return df.withColumns(out)


def is_normalized(box=None) -> Column:
    """All four coordinates within [0, 1]."""
    out = F.lit(True)
    for c in box or box_columns():
        out = out & (c >= 0) & (c <= 1.0)
    return out


def is_absolute(box=None) -> Column:
    """Any coordinate above 1."""
    return F.greatest(*(box or box_columns())) > 1


def to_pixels(df: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """Scale only the boxes whose coordinates all lie in [0, 1]."""
    norm = is_normalized()
    return df.withColumns({n: F.when(norm, F.col(n) * F.col(d)).otherwise(F.col(n)) for n, d in zip(BOX, (w, h, w, h))})


# ---- cleaning and measures --------------------------------------------------

def clip_boxes(df: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    return df.withColumns({n: clamp(F.col(n), F.lit(0.0), F.col(d).cast("double"))
                           for n, d in zip(BOX, (w, h, w, h))})


def nonempty(threshold: float = 0.0) -> Column:
    return (F.col("x2") - F.col("x1") > threshold) & (F.col("y2") - F.col("y1") > threshold)


def inside_box(w: Column, h: Column, margin: float = 0.0) -> Column:
    """Inclusive on the low side, exclusive on the high side."""
    x1, y1, x2, y2 = box_columns()
    return (x1 >= -margin) & (y1 >= -margin) & (x2 < w + margin) & (y2 < h + margin)


def center_x() -> Column:
    return (F.col("x1") + F.col("x2")) / 2.0


def center_y() -> Column:
    return (F.col("y1") + F.col("y2")) / 2.0


def scale_boxes(df: DataFrame, sx: float, sy: float) -> DataFrame:
    return df.withColumns({n: F.col(n) * s for n, s in zip(BOX, (sx, sy, sx, sy))})


def aspect_ratio() -> Column:
    """Width over height, 1.0 when the height is not positive."""
    h = F.col("y2") - F.col("y1")
    return F.when(h <= 0, F.lit(1.0)).otherwise((F.col("x2") - F.col("x1")) / h)


def size_ratio(mask_area: Column, w: Column, h: Column) -> Column:
    total = w * h
    return F.when(total <= 0, F.lit(0.0)).otherwise(mask_area / total)


def rescale_coords(df: DataFrame, resolution: float, w: str = "w", h: str = "h") -> DataFrame:
    """Pixel boxes to model input coordinates."""
    return df.withColumns({n: F.col(n) / F.col(d) * float(resolution) for n, d in zip(BOX, (w, h, w, h))})


def jitter_boxes(df: DataFrame, keys: list[str], seed: int, share: float = 0.1, most: float = 20.0,
                 w: str = "w", h: str = "h") -> DataFrame:
    """Move each coordinate by up to ``share`` of the side and ``most`` pixels.

    The noise is a hash of the row keys, so a recomputed task repeats it.
    """
    side_x = F.least((F.col("x2") - F.col("x1")) * share, F.lit(most))
    side_y = F.least((F.col("y2") - F.col("y1")) * share, F.lit(most))
    out = {}
    for i, (name, dim) in enumerate(zip(BOX, (w, h, w, h))):
        unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 30)) / float(1 << 29) - 1.0
        side = side_x if i % 2 == 0 else side_y
        out[name] = clamp(F.col(name) + unit * side, F.lit(0.0), F.col(dim) - 1.0)
    return df.withColumns(out)


def label_text(name: Column, score: Column, crowd: Column | None = None) -> Column:
    text = F.concat(name, F.lit(" "), F.bround(score * 100).cast("bigint").cast("string"), F.lit("%"))
    if crowd is not None:
        text = F.when(crowd, F.concat(text, F.lit("|crowd"))).otherwise(text)
    return text


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def fused_score(logit: Column, presence: Column) -> Column:
    return sigmoid(logit) * sigmoid(presence)


def memory_score(object_logit: Column, predicted_iou: Column) -> Column:
    return F.greatest(F.lit(0.0), 2.0 * sigmoid(object_logit) - 1.0) * predicted_iou


# ---- crop windows -----------------------------------------------------------

def _int(c: Column) -> Column:
    return c.cast("bigint")


def crop_window(df: DataFrame, kind: str, w: str = "w", h: str = "h", area_col: str = "mask_area") -> DataFrame:
    """Add the crop rectangle ``cx1, cy1, cx2, cy2`` of each box.

    ``verify`` truncates and clamps; ``region`` also keeps at least one pixel;
    ``cluster`` pads by a tenth, repairing inverted or relative coordinates;
    ``zoom`` pads by a fifth (at least 16) and grows boxes that their mask
    fills (see ``zoom_windows`` for both of its rectangles).
    """
    W, H = F.col(w), F.col(h)
    x1, y1, x2, y2 = box_columns()
    zero = F.lit(0).cast("bigint")
    if kind == "verify":
        lo_hi = [(clamp(_int(a), zero, d), clamp(_int(b), zero, d)) for a, b, d in ((x1, x2, W), (y1, y2, H))]
    elif kind == "region":
        lo_hi = []
        for a, b, d in ((x1, x2, W), (y1, y2, H)):
            lo = clamp(_int(a), zero, d - 1)
            lo_hi.append((lo, F.greatest(lo + 1, F.least(_int(b), d))))
    elif kind == "cluster":
        lo_hi = []
        norm = is_normalized()
        for a, b, d in ((x1, x2, W), (y1, y2, H)):
            a, b = (F.when(norm, v * d).otherwise(v) for v in (a, b))
            lo = clamp(F.least(a, b), F.lit(0.0), d - 1.0)
            hi = clamp(F.greatest(a, b), F.lit(0.0), d.cast("double"))
            lo_hi.append(padded_span(lo, hi, d))
    elif kind == "zoom":
        return zoom_windows(df, w, h, area_col).withColumns({
            "cx1": F.col("zoom_x"), "cy1": F.col("zoom_y"),
            "cx2": F.col("zoom_x") + F.col("zoom_w"), "cy2": F.col("zoom_y") + F.col("zoom_h"),
        }).drop("zoom_x", "zoom_y", "zoom_w", "zoom_h", "crop_x", "crop_y", "crop_w", "crop_h")
    else:
        raise ValueError(f"unknown crop kind {kind}")
    (cx1, cx2), (cy1, cy2) = lo_hi
    return df.withColumns({"cx1": cx1, "cy1": cy1, "cx2": cx2, "cy2": cy2})


def padded_span(lo: Column, hi: Column, dim: Column, pad: float = 0.1) -> tuple[Column, Column]:
    """One axis of a cluster crop: widen by ``pad``, never empty."""
    hi = F.when(hi <= lo, lo + 10.0).otherwise(hi)
    margin = (hi - lo) * pad
    out_lo = _int(F.greatest(F.lit(0.0), lo - margin))
    out_hi = _int(F.least(dim.cast("double"), hi + margin))
    return out_lo, F.when(out_hi <= out_lo, F.least(out_lo + 10, dim)).otherwise(out_hi)


# Relative mask areas above which the zoom and the context rectangle grow (fixed values).
ZOOM_AREA, CONTEXT_AREA = 0.25, 0.05


def zoom_windows(df: DataFrame, w: str = "w", h: str = "h", area_col: str = "mask_area") -> DataFrame:
    W, H = F.col(w).cast("double"), F.col(h).cast("double")
    x, y = F.col("x1"), F.col("y1")
    bw, bh = F.col("x2") - x, F.col("y2") - y
    df = df.withColumns({
        "_zw": F.least(bw + F.greatest(bw * 0.2, F.lit(16.0)), W),
        "_zh": F.least(bh + F.greatest(bh * 0.2, F.lit(16.0)), H),
    })
    df = df.withColumn("_rel", F.col(area_col) / (F.col("_zw") * F.col("_zh")))
    for name, limit in (("zoom", ZOOM_AREA), ("crop", CONTEXT_AREA)):
        grow = F.when(F.col("_rel") > limit, F.sqrt(F.col("_rel") / limit)).otherwise(F.lit(1.0))
        df = df.withColumns({f"{name}_w": F.least(F.col("_zw") * grow, W), f"{name}_h": F.least(F.col("_zh") * grow, H)})
        for axis, start, size, dim in (("x", x, bw, W), ("y", y, bh, H)):
            new = F.col(f"{name}_{'w' if axis == 'x' else 'h'}")
            shift = (new - size) / 2.0
            shift = F.when(start - shift + new > dim, start + new - dim).otherwise(shift)
            df = df.withColumn(f"{name}_{axis}", start - F.least(start, shift))
    return df.drop("_zw", "_zh", "_rel")


# ---- rotated boxes ----------------------------------------------------------

def hull_size() -> tuple[Column, Column]:
    """Width and height of the axis-parallel rectangle around a rotated box."""
    theta = F.col("angle") * math.pi / 180.0
    c, s = F.abs(F.cos(theta)), F.abs(F.sin(theta))
    return c * F.col("w") + s * F.col("h"), c * F.col("h") + s * F.col("w")


def normalize_angle(angle: Column) -> Column:
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def clip_rotated(df: DataFrame, img_w: str, img_h: str, flat: float = 1.0) -> DataFrame:
    """Clip boxes within ``flat`` degrees of horizontal, leave the others."""
    df = df.withColumn("angle", normalize_angle(F.col("angle")))
    out = {}
    for center, side, dim in (("cx", "w", img_w), ("cy", "h", img_h)):
        lo = clamp(F.col(center) - F.col(side) / 2.0, F.lit(0.0), F.col(dim).cast("double"))
        hi = clamp(F.col(center) + F.col(side) / 2.0, F.lit(0.0), F.col(dim).cast("double"))
        near = F.abs(F.col("angle")) <= flat
        out[center] = F.when(near, (lo + hi) / 2.0).otherwise(F.col(center))
        out[side] = F.when(near, F.least(F.col(side), hi - lo)).otherwise(F.col(side))
    return df.withColumns(out)


def rotated_inside(w: Column, h: Column, margin: float = 0.0) -> Column:
    hw, hh = hull_size()
    return ((F.col("cx") - hw / 2.0 >= -margin) & (F.col("cy") - hh / 2.0 >= -margin)
            & (F.col("cx") + hw / 2.0 < w + margin) & (F.col("cy") + hh / 2.0 < h + margin))


def scale_rotated(df: DataFrame, sx: float, sy: float) -> DataFrame:
    """Scale, refitting a rectangle when the factors differ."""
    theta = F.col("angle") * math.pi / 180.0
    c, s = F.cos(theta), F.sin(theta)
    return df.withColumns({
        "cx": F.col("cx") * sx, "cy": F.col("cy") * sy,
        "w": F.col("w") * F.sqrt((sx * c) * (sx * c) + (sy * s) * (sy * s)),
        "h": F.col("h") * F.sqrt((sx * s) * (sx * s) + (sy * c) * (sy * c)),
        "angle": F.atan2(sx * s, sy * c) * 180.0 / math.pi,
    })


def normalize_obb(df: DataFrame, img_w: str, img_h: str) -> DataFrame:
    valid = (F.col(img_w) > 0) & (F.col(img_h) > 0)
    dims = {"cx": img_w, "cy": img_h, "w": img_w, "h": img_h}
    out = {n: F.when(valid, F.col(n) / F.col(d)) for n, d in dims.items()}
    return df.withColumns({**out, "angle": F.when(valid, F.col("angle"))})


def obb_to_polygon(img_w: Column | None = None, img_h: Column | None = None) -> Column:
    """Four corners, starting at (-,-) and going (+,-), (+,+), (-,+)."""
    theta = F.radians(F.col("angle"))
    c, s = F.cos(theta), F.sin(theta)
    corners = []
    for sign_x, sign_y in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)):
        dx, dy = F.col("w") / 2.0 * sign_x, F.col("h") / 2.0 * sign_y
        x = dx * c - dy * s + F.col("cx")
        y = dx * s + dy * c + F.col("cy")
        if img_w is not None:
            x = F.when((img_w > 0) & (img_h > 0), x / img_w).otherwise(x)
            y = F.when((img_w > 0) & (img_h > 0), y / img_h).otherwise(y)
        corners.append(F.struct(x.alias("x"), y.alias("y")))
    return F.array(*corners)


# ---- polygons ---------------------------------------------------------------

def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) * 0.5


def polygon_box(points: Column) -> list[Column]:
    """Box of a polygon; the upper corner starts at 0, the lower at infinity."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    top = lambda v: F.greatest(F.lit(0.0), F.array_max(v))
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), top(xs).alias("x2"), top(ys).alias("y2")]


def valid_polygon(coords: Column) -> Column:
    """A flat coordinate list of at least three points."""
    return (F.size(coords) % 2 == 0) & (F.size(coords) >= 6)
