"""Queries on tiles, boxes, filters and spatial selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.catalog.registry import query
from visiontables.functions import boxes as B
from visiontables.operators import filters as FL
from visiontables.operators import select as S
from visiontables.operators import tiles as T

# ---- tiles --------------------------------------------------------------------

_GRID = """
, ax as (select image_id, w, h,
   unnest(range(0, cast(case when w <= {t} then 1 else ceil((w - {t}) / {s}.0) + 1 end as bigint))) as ix from {src}),
 xy as (select *, unnest(range(0, cast(case when h <= {t} then 1 else ceil((h - {t}) / {s}.0) + 1 end as bigint))) as iy from ax)
"""


@query("tile_grid", "big_images", _GRID.format(t=512, s=435, src="big_images") + """
select image_id, iy * (case when w <= 512 then 1 else cast(ceil((w - 512) / 435.0) as bigint) + 1 end) + ix as tile_id,
 greatest(0, least(ix * 435 + 512, w) - 512) as tx0, greatest(0, least(iy * 435 + 512, h) - 512) as ty0,
 least(ix * 435 + 512, w) as tx1, least(iy * 435 + 512, h) as ty1 from xy""")
def tile_grid(t):
    return T.tile_grid(t.big_images(), 512, 0.15).select("image_id", "tile_id", "tx0", "ty0", "tx1", "ty1")


@query("tile_grid_truncated", "big_images", """
, ax as (select image_id, w, h, unnest(range(0, w, 820)) as x from big_images),
 xy as (select *, unnest(range(0, h, 820)) as y from ax),
 cut as (select image_id, x as tx0, y as ty0, least(x + 1024, w) as tx1, least(y + 1024, h) as ty1, w, h from xy),
 good as (select * from cut where not (w <= 1024 and h <= 1024) and tx1 - tx0 >= 512 and ty1 - ty0 >= 512),
 al as (select image_id, tx0, ty0, tx1, ty1 from good union all
  select image_id, 0, 0, w, h from big_images where image_id not in (select image_id from good))
select image_id, row_number() over (partition by image_id order by ty0, tx0) - 1 as tile_id, tx0, ty0, tx1, ty1 from al""")
def tile_grid_truncated(t):
    return T.tile_grid_truncated(t.big_images()).select("image_id", "tile_id", "tx0", "ty0", "tx1", "ty1")


@query("pyramid_levels", "big_images", """
select image_id, w, h, cast(level as integer) as level, scale, cast(floor(w * scale) as bigint) as sw, cast(floor(h * scale) as bigint) as sh
 from big_images, (values (0, cast(1.0 as double)), (1, cast(0.5 as double)), (2, cast(0.25 as double))) s(level, scale)""")
def pyramid_levels(t):
    return T.pyramid(t.big_images(), [0.5, 1.0, 0.25])


def _tiles(t):
    levels = T.pyramid(t.big_images(), [1.0, 0.5])
    return T.tile_grid(levels, 512, 0.15, "sw", "sh")


_LEVELED = """
, lv as (select image_id, scale, cast(floor(w * scale) as bigint) as w, cast(floor(h * scale) as bigint) as h from big_images,
  (values (cast(1.0 as double)), (cast(0.5 as double))) s(scale)),
 ax as (select *, unnest(range(0, cast(case when w <= 512 then 1 else ceil((w - 512) / 435.0) + 1 end as bigint))) as ix from lv),
 xy as (select *, unnest(range(0, cast(case when h <= 512 then 1 else ceil((h - 512) / 435.0) + 1 end as bigint))) as iy from ax),
 tl as (select image_id, scale, row_number() over (partition by image_id, scale order by iy, ix) - 1 as tile_id from xy)
"""


@query("tile_batches", "big_images", _LEVELED + "select image_id, scale, tile_id, tile_id // 16 as batch_id from tl")
def tile_batches(t):
    return T.batch_tiles(_tiles(t)).select("image_id", "scale", "tile_id", "batch_id")


@query("tile_stats", "big_images", _LEVELED + """
select image_id, scale, count(*) as tiles, count(*) filter (where (tile_id * 3 + image_id) % 7 = 0) as failed,
 count(*) filter (where (tile_id * 3 + image_id) % 7 <> 0) as successful from tl group by image_id, scale""")
def tile_stats(t):
    return T.tile_stats(_tiles(t), ["image_id", "scale"], (F.col("tile_id") * 3 + F.col("image_id")) % 7 == 0)


@query("tile_to_image", "detections images", """
, lv as (select image_id, 1.0::double as scale, w, h, w as sw, h as sh from images
   union all select image_id, 0.5::double, w, h, w // 2, h // 2 from images),
 ax as (select *, unnest(range(0, cast(case when sw <= 256 then 1 else ceil((sw - 256) / 217.0) + 1 end as bigint))) as ix from lv),
 xy as (select *, unnest(range(0, cast(case when sh <= 256 then 1 else ceil((sh - 256) / 217.0) + 1 end as bigint))) as iy from ax),
 tl as (select image_id, scale, w, h, row_number() over (partition by image_id, scale order by iy, ix) - 1 as tile_id,
   greatest(0, least(ix * 217 + 256, sw) - 256) as ox, greatest(0, least(iy * 217 + 256, sh) - 256) as oy from xy)
select image_id, det_id, scale, tile_id,
 greatest(0.0, least((x1 + ox) / scale, w::double)) as x1, greatest(0.0, least((y1 + oy) / scale, h::double)) as y1,
 greatest(0.0, least((x2 + ox) / scale, w::double)) as x2, greatest(0.0, least((y2 + oy) / scale, h::double)) as y2
from (select *, case when scale = 1.0 then det_id % 9 else det_id % 2 end as tile_id from detections) d
 join tl using (image_id, scale, tile_id)""")
def tile_to_image(t):
    tiles = T.tile_grid(T.pyramid(t.images(), [1.0, 0.5]), 256, 0.15, "sw", "sh")
    dets = t.detections().withColumn(
        "tile_id", F.when(F.col("scale") == 1.0, F.col("det_id") % 9).otherwise(F.col("det_id") % 2))
    out = T.tile_to_image(dets, tiles, ["image_id", "scale", "tile_id"])
    return out.select("image_id", "det_id", "scale", "tile_id", *B.BOX)


@query("region_to_image", "detections images", """
select image_id, det_id, (x1 / 1000 * (w - 64 - 32) + 32) / w as x1, (y1 / 1000 * (h - 32 - 16) + 16) / h as y1,
 (x2 / 1000 * (w - 64 - 32) + 32) / w as x2, (y2 / 1000 * (h - 32 - 16) + 16) / h as y2
from detections join images using (image_id)""")
def region_to_image(t):
    regions = t.images().selectExpr("image_id", "w", "h", "32L as tx0", "16L as ty0", "w - 64 as tx1", "h - 32 as ty1")
    rel = t.detections().select("image_id", "det_id", *[(F.col(c) / 1000).alias(c) for c in B.BOX])
    return T.region_to_image(rel, regions, ["image_id"]).select("image_id", "det_id", *B.BOX)


# ---- box formats ----------------------------------------------------------------

@query("box_formats", "detections", """
select image_id, det_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy,
 (x1 + x2) / 2 - (x2 - x1) / 2 as bx1, (y1 + y2) / 2 + (y2 - y1) / 2 as by2 from detections""")
def box_formats(t):
    d = t.detections().select("image_id", "det_id", *B.BOX)
    xywh = B.convert_boxes(d, "xyxy", "xywh").withColumns({"x0": F.col("x"), "y0": F.col("y")})
    c = B.convert_boxes(B.convert_boxes(xywh, "xywh", "xyxy"), "xyxy", "cxcywh")
    back = B.convert_boxes(c.withColumns({"sw": F.col("w"), "sh": F.col("h"), "mx": F.col("cx"), "my": F.col("cy")}), "cxcywh", "xyxy")
    return back.select("image_id", "det_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("sw").alias("w"), F.col("sh").alias("h"),
                       F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("x1").alias("bx1"), F.col("y2").alias("by2"))


@query("normalized_boxes", "detections images", """
select image_id, det_id, x1 / w as nx1, y1 / h as ny1, x2 / w as nx2, y2 / h as ny2,
 cast(greatest(0, least(floor(x1 / w * w), w - 1)) as bigint) as ix1, cast(greatest(0, least(floor(y2 / h * h), h - 1)) as bigint) as iy2,
 greatest(x1, y1, x2, y2) > 1 as absolute from detections join images using (image_id)""")
def normalized_boxes(t):
    d = t.detections().join(t.images(), "image_id").withColumn("absolute", B.is_absolute())
    n = B.normalize_boxes(d).withColumns({"n" + c: F.col(c) for c in B.BOX})
    i = B.denormalize_boxes(n, integer=True)
    return i.select("image_id", "det_id", "nx1", "ny1", "nx2", "ny2", F.col("x1").alias("ix1"), F.col("y2").alias("iy2"), "absolute")


@query("clip_and_inside", "detections", """
, m as (select image_id, det_id, x1 * 1.25 - 60 as x1, y1 * 1.25 - 60 as y1, x2 * 1.25 - 60 as x2, y2 * 1.25 - 60 as y2 from detections),
 c as (select *, greatest(0.0, least(x1, 400.0)) as cx1, greatest(0.0, least(y1, 420.0)) as cy1,
  greatest(0.0, least(x2, 400.0)) as cx2, greatest(0.0, least(y2, 420.0)) as cy2 from m)
select image_id, det_id, cx1, cy1, cx2, cy2, cx2 - cx1 > 5 and cy2 - cy1 > 5 as nonempty,
 x1 >= -10 and y1 >= -10 and x2 < 400 + 10 and y2 < 420 + 10 as inside, (x1 + x2) / 2 as px, (y1 + y2) / 2 as py from c""")
def clip_and_inside(t):
    d = B.scale_boxes(t.detections(), 1.25, 1.25).withColumns({c: F.col(c) - 60 for c in B.BOX})
    d = d.withColumns({"inside": B.inside_box(F.lit(400.0), F.lit(420.0), 10), "px": B.center_x(), "py": B.center_y(),
                       "fw": F.lit(400.0), "fh": F.lit(420.0)})
    c = B.clip_boxes(d, "fw", "fh").withColumn("nonempty", B.nonempty(5))
    return c.select("image_id", "det_id", *[F.col(n).alias("c" + n) for n in B.BOX], "nonempty", "inside", "px", "py")


@query("box_measures", "detections images", """
select image_id, det_id, (x2 - x1) * (y2 - y1) as area,
 case when y2 - y1 - 40 <= 0 then 1.0::double else (x2 - x1) / (y2 - y1 - 40) end as aspect,
 floor((x2 - x1) * (y2 - y1) / 2) / (w * h) as size_ratio from detections join images using (image_id)""")
def box_measures(t):
    d = t.detections().join(t.images(), "image_id").withColumn("area", B.area(B.box_columns()))
    flat = d.withColumn("y2", F.col("y2") - 40)
    return flat.select("image_id", "det_id", "area", B.aspect_ratio().alias("aspect"),
                       B.size_ratio(F.floor(F.col("area") / 2), F.col("w"), F.col("h")).alias("size_ratio"))


@query("crop_windows", "detections images", """
, m as (select image_id, det_id, case when det_id % 5 = 0 then x1 / 1000 else x1 * 1.3 - 40 end as x1,
   case when det_id % 5 = 0 then y1 / 1000 else y1 * 1.3 - 40 end as y1,
   case when det_id % 5 = 0 then x2 / 1000 else x2 * 1.3 - 40 end as x2,
   case when det_id % 5 = 0 then y2 / 1000 else y2 * 1.3 - 40 end as y2, w, h from detections join images using (image_id)),
 n as (select *, x1 between 0 and 1 and y1 between 0 and 1 and x2 between 0 and 1 and y2 between 0 and 1 as nm from m),
 p as (select *, greatest(0.0, least(case when nm then x1 * w else x1 end, w - 1.0)) as lx,
  greatest(0.0, least(case when nm then x2 * w else x2 end, w::double)) as hx,
  greatest(0.0, least(case when nm then y1 * h else y1 end, h - 1.0)) as ly,
  greatest(0.0, least(case when nm then y2 * h else y2 end, h::double)) as hy from n),
 q as (select * replace (case when hx <= lx then lx + 10.0 else hx end as hx, case when hy <= ly then ly + 10.0 else hy end as hy) from p),
 k as (select *, trunc(greatest(0.0, lx - (hx - lx) * 0.1::double))::bigint as kx1, trunc(greatest(0.0, ly - (hy - ly) * 0.1::double))::bigint as ky1,
  trunc(least(w::double, hx + (hx - lx) * 0.1::double))::bigint as kx2, trunc(least(h::double, hy + (hy - ly) * 0.1::double))::bigint as ky2 from q)
select image_id, det_id, greatest(0, least(trunc(x1)::bigint, w)) as vx1, greatest(0, least(trunc(y2)::bigint, h)) as vy2,
 greatest(0, least(trunc(x1)::bigint, w - 1)) as rx1,
 greatest(greatest(0, least(trunc(x1)::bigint, w - 1)) + 1, least(trunc(x2)::bigint, w)) as rx2,
 kx1, ky1, case when kx2 <= kx1 then least(kx1 + 10, w) else kx2 end as kx2, case when ky2 <= ky1 then least(ky1 + 10, h) else ky2 end as ky2 from k""")
def crop_windows(t):
    d = t.detections().join(t.images(), "image_id")
    d = d.withColumns({c: F.when(F.col("det_id") % 5 == 0, F.col(c) / 1000).otherwise(F.col(c) * 1.3 - 40) for c in B.BOX})
    v = B.crop_window(d, "verify").withColumnsRenamed({"cx1": "vx1", "cy2": "vy2"}).drop("cx2", "cy1")
    r = B.crop_window(v, "region").withColumnsRenamed({"cx1": "rx1", "cx2": "rx2"}).drop("cy1", "cy2")
    k = B.crop_window(r, "cluster").withColumnsRenamed({"cx1": "kx1", "cy1": "ky1", "cx2": "kx2", "cy2": "ky2"})
    return k.select("image_id", "det_id", "vx1", "vy2", "rx1", "rx2", "kx1", "ky1", "kx2", "ky2")


_ZOOM_AXIS = """x{n} - least(x{n}, case when x{n} - ({g} - s{n}) / 2 + {g} > d{n} then x{n} + {g} - d{n} else ({g} - s{n}) / 2 end)"""


@query("zoom_windows", "detections images", """
, b as (select image_id, det_id, x1 as xx, y1 as xy, x2 - x1 as sx, y2 - y1 as sy, w::double as dx, h::double as dy,
   floor((x2 - x1) * (y2 - y1) * score) as ma from detections join images using (image_id)),
 z as (select *, least(sx + greatest(sx * 0.2::double, 16.0), dx) as zw, least(sy + greatest(sy * 0.2::double, 16.0), dy) as zh from b),
 r as (select *, ma / (zw * zh) as rel from z),
 g as (select *, least(zw * case when rel > 0.25 then sqrt(rel / 0.25::double) else 1.0 end, dx) as zoom_w,
  least(zh * case when rel > 0.25 then sqrt(rel / 0.25::double) else 1.0 end, dy) as zoom_h,
  least(zw * case when rel > 0.05 then sqrt(rel / 0.05::double) else 1.0 end, dx) as crop_w,
  least(zh * case when rel > 0.05 then sqrt(rel / 0.05::double) else 1.0 end, dy) as crop_h from r)
select image_id, det_id, zoom_w, zoom_h, crop_w, crop_h, """ + ", ".join(
    _ZOOM_AXIS.format(n=n, g=f"{k}_{'w' if n == 'x' else 'h'}") + f" as {k}_{n}" for k in ("zoom", "crop") for n in "xy") + " from g")
def zoom_windows(t):
    d = t.detections().join(t.images(), "image_id").withColumn("mask_area", F.floor(B.area(B.box_columns()) * F.col("score")))
    return B.zoom_windows(d).select("image_id", "det_id", *[f"{k}_{n}" for k in ("zoom", "crop") for n in "xywh"])


# ---- rotated boxes ----------------------------------------------------------------

_ROT = """
, r as (select image_id, det_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h, (det_id % 1441) / 2.0 - 360 as a from detections),
 n as (select *, ((a + 180) % 360 + 360) % 360 - 180 as angle, abs(cos(a * pi() / 180)) as c, abs(sin(a * pi() / 180)) as s from r)
"""


def _rotated(t):
    d = B.convert_boxes(t.detections().select("image_id", "det_id", *B.BOX), "xyxy", "cxcywh")
    return d.withColumn("angle", (F.col("det_id") % 1441) / 2.0 - 360)


@query("rotated_measures", "detections", _ROT + """
select image_id, det_id, w * h as area, angle, round(cx - (c * w + s * h) / 2, 6) as x1, round(cy - (c * h + s * w) / 2 + (c * h + s * w), 6) as y2,
 w > 60 and h > 60 as nonempty, cx - (c * w + s * h) / 2 >= -5 and cy - (c * h + s * w) / 2 >= -5
  and cx + (c * w + s * h) / 2 < 405 and cy + (c * h + s * w) / 2 < 425 as inside from n""")
def rotated_measures(t):
    r = _rotated(t)
    r = r.withColumns({"area": F.col("w") * F.col("h"), "nonempty": (F.col("w") > 60) & (F.col("h") > 60),
                       "inside": B.rotated_inside(F.lit(400.0), F.lit(420.0), 5), "norm": B.normalize_angle(F.col("angle"))})
    hull = B.convert_boxes(r, "xywha", "xyxy")
    return hull.select("image_id", "det_id", "area", F.col("norm").alias("angle"), F.round("x1", 6).alias("x1"),
                       F.round("y2", 6).alias("y2"), "nonempty", "inside")


@query("rotated_clip", "detections", _ROT + """
, q as (select *, greatest(0.0, least(cx - w / 2, 400.0)) as xa, greatest(0.0, least(cx + w / 2, 400.0)) as xb,
  greatest(0.0, least(cy - h / 2, 420.0)) as ya, greatest(0.0, least(cy + h / 2, 420.0)) as yb, abs(angle) <= 1 as near from n)
select image_id, det_id, angle, case when near then (xa + xb) / 2 else cx end as cx, case when near then (ya + yb) / 2 else cy end as cy,
 case when near then least(w, xb - xa) else w end as w, case when near then least(h, yb - ya) else h end as h from q""")
def rotated_clip(t):
    r = _rotated(t).withColumns({"fw": F.lit(400.0), "fh": F.lit(420.0)})
    return B.clip_rotated(r, "fw", "fh").select("image_id", "det_id", *B.RBOX)


@query("rotated_scale", "detections", """
, r as (select image_id, det_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h,
  cos(((det_id % 1441) / 2.0 - 360) * pi() / 180) as c, sin(((det_id % 1441) / 2.0 - 360) * pi() / 180) as s from detections)
select image_id, det_id, cx * 2 as cx, cy * 0.5::double as cy, round(w * sqrt(4 * c * c + 0.25 * s * s), 6) as w,
 round(h * sqrt(4 * s * s + 0.25 * c * c), 6) as h, round(abs(atan2(2 * s, 0.5 * c) * 180 / pi()), 6) as turn from r""")
def rotated_scale(t):
    s = B.scale_rotated(_rotated(t), 2.0, 0.5)
    # +180 and -180 are the same turn
    return s.select("image_id", "det_id", "cx", "cy", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"),
                    F.round(F.abs("angle"), 6).alias("turn"))


@query("obb_polygons", "detections images", """
, r as (select image_id, det_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, (x2 - x1) / 2 as a, (y2 - y1) / 2 as b,
  radians(det_id % 180) as t, w, h from detections join images using (image_id)),
 c as (select r.*, k.i, k.sx, k.sy from r, (values (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) k(i, sx, sy))
select image_id, det_id, cast(i as integer) as corner, round((a * sx * cos(t) - b * sy * sin(t) + cx) / w, 9) as x,
 round((a * sx * sin(t) + b * sy * cos(t) + cy) / h, 9) as y, cx / w as ncx, 2 * b / h as nh from c""")
def obb_polygons(t):
    r = _rotated(t).withColumn("angle", (F.col("det_id") % 180).cast("double"))
    r = r.join(t.images().withColumnsRenamed({"w": "iw", "h": "ih"}), "image_id")
    r = r.withColumn("poly", B.obb_to_polygon(F.col("iw"), F.col("ih")))
    n = B.normalize_obb(r, "iw", "ih")
    # no row is without corners; the inner form would have Spark test for that at the scan, with the id worked out for every corner
    n = n.select("image_id", "det_id", F.col("cx").alias("ncx"), F.col("h").alias("nh"), F.posexplode_outer("poly").alias("corner", "p"))
    return n.select("image_id", "det_id", "corner", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), "ncx", "nh")


@query("fused_scores", "track_obs", """
select det_id, round(1 / (1 + exp(-(score * 8 - 4))) * (1 / (1 + exp(-(x1 / 100 - 1)))), 12) as fused,
 round(greatest(0.0, 2 * (1 / (1 + exp(-(score * 8 - 4)))) - 1) * (y1 / 100), 12) as memory from track_obs""")
def fused_scores(t):
    o = t.track_obs()
    logit = F.col("score") * 8 - 4
    return o.select("det_id", F.round(B.fused_score(logit, F.col("x1") / 100 - 1), 12).alias("fused"),
                    F.round(B.memory_score(logit, F.col("y1") / 100), 12).alias("memory"))


@query("memory_score_per_frame", "track_obs", """
select video_id, frame_idx, round(avg(greatest(0.0, 2 * (1 / (1 + exp(-(score * 8 - 4)))) - 1) * (y1 / 100)), 9) as memory
 from track_obs group by video_id, frame_idx""")
def memory_score_per_frame(t):
    m = B.memory_score(F.col("score") * 8 - 4, F.col("y1") / 100)
    return t.track_obs().groupBy("video_id", "frame_idx").agg(F.round(F.avg(m), 9).alias("memory"))


@query("polygon_measures", "detections", """
, v as (select image_id, det_id, [{'x': x1, 'y': y1}, {'x': x2, 'y': y1 + 5}, {'x': x2 - 7, 'y': y2}, {'x': (x1 + x2) / 2, 'y': y2 - 20}] as p from detections),
 e as (select image_id, det_id, p, unnest(range(1, 5)) as i from v)
select image_id, det_id, abs(sum(p[i].x * p[i % 4 + 1].y - p[i].y * p[i % 4 + 1].x)) * 0.5 as area,
 min(p[i].x) as x1, min(p[i].y) as y1, max(p[i].x) as x2, max(p[i].y) as y2 from e group by image_id, det_id""")
def polygon_measures(t):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = B.box_columns()
    d = t.detections().withColumn("p", F.array(pt(x1, y1), pt(x2, y1 + 5), pt(x2 - 7, y2), pt((x1 + x2) / 2, y2 - 20)))
    return d.select("image_id", "det_id", B.polygon_area(F.col("p")).alias("area"), *B.polygon_box(F.col("p")))


@query("polygon_validity", "", "select doc_id, len(string_split(text, ' ')) % 2 = 0 and len(string_split(text, ' ')) >= 6 as valid from documents")
def polygon_validity(t):
    d = t.raw("documents").select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", B.valid_polygon(F.col("w")).alias("valid"))


@query("rescaled_coords", "detections images", """
select image_id, det_id, x1 / w * 1008.0::double as x1, y1 / h * 1008.0::double as y1, x2 / w * 1008.0::double as x2, y2 / h * 1008.0::double as y2
 from detections join images using (image_id)""")
def rescaled_coords(t):
    d = t.detections().join(t.images(), "image_id")
    return B.rescale_coords(d, 1008.0).select("image_id", "det_id", *B.BOX)


@query("jittered_boxes")
def jittered_boxes(t):
    d = t.detections().join(t.images(), "image_id")
    return B.jitter_boxes(d, ["image_id", "det_id"], seed=7).select("image_id", "det_id", *B.BOX)


@query("label_texts", "detections", """
select image_id, det_id, prompt || ' ' || cast(cast(round_even(score * 100, 0) as bigint) as varchar) || '%'
 || case when det_id % 3 = 0 then '|crowd' else '' end as label from detections""")
def label_texts(t):
    return t.detections().select("image_id", "det_id", B.label_text(F.col("prompt"), F.col("score"), F.col("det_id") % 3 == 0).alias("label"))


# ---- filters ------------------------------------------------------------------------

@query("confident", "detections", "select image_id, det_id, score, score >= 0.75 as final from detections where score > 0.375")
def confident(t):
    return FL.candidates(t.detections(), 0.75).select("image_id", "det_id", "score", (F.col("score") >= 0.75).alias("final"))


@query("degenerate_dropped", "detections", """
select image_id, det_id from detections where least(x2, 300.0) > least(x1, 300.0) and least(y2, 350.0) > least(y1, 350.0) and score >= 0.5""")
def degenerate_dropped(t):
    d = FL.by_confidence(t.detections(), 0.5).withColumns({"fw": F.lit(300), "fh": F.lit(350)})
    return FL.drop_degenerate(B.clip_boxes(d, "fw", "fh")).select("image_id", "det_id")


@query("away_from_boundary", "detections images", """
select image_id, det_id from detections join images using (image_id)
where (x1 + x2) / 2 / w > 0.1 and (x1 + x2) / 2 / w < 0.9 and (y1 + y2) / 2 / h > 0.1 and (y1 + y2) / 2 / h < 0.9""")
def away_from_boundary(t):
    d = t.detections().join(t.images(), "image_id")
    return FL.drop_near_boundary(d, margin=0.1).select("image_id", "det_id")


def _attributes(t):
    d = t.detections()
    return d.select("image_id", "det_id", (F.col("det_id") % 256).alias("r"), (F.col("det_id") * 7 % 256).alias("g"),
                    (F.col("det_id") * 13 % 256).alias("b"), B.aspect_ratio().alias("aspect"),
                    (B.area(B.box_columns()) / (512.0 * 544.0)).alias("size_ratio"))


_WANT = dict(color="purple", min_size=0.01, max_size=0.03, aspect=(0.6, 1.1))
_ATTR = """
, a as (select image_id, det_id, det_id % 256 as r, det_id * 7 % 256 as g, det_id * 13 % 256 as b,
  (x2 - x1) / (y2 - y1) as aspect, (x2 - x1) * (y2 - y1) / (512.0::double * 544.0::double) as size_ratio from detections),
 c as (select *, greatest(abs(r - 128) / 255.0, abs(g) / 255.0, abs(b - 128) / 255.0) <= 0.3 as hue from a)
"""


@query("attribute_filter", "detections", _ATTR + """
select image_id, det_id from c where hue and size_ratio >= 0.01 and size_ratio <= 0.03 and aspect between 0.6 and 1.1""")
def attribute_filter(t):
    return FL.by_attributes(_attributes(t), **_WANT).select("image_id", "det_id")


@query("color_matches", "detections", _ATTR + ", n as (select image_id, count(*) filter (where hue) as purple, 0::bigint as none from c group by image_id) select * from n")
def color_matches(t):
    a = _attributes(t)
    rgb = [F.col(c) for c in "rgb"]
    return a.groupBy("image_id").agg(F.count_if(FL.color_match(*rgb, "purple")).alias("purple"),
                                     F.count_if(FL.color_match(*rgb, "no such colour")).alias("none"))


@query("filter_reports", "detections", _ATTR + """
, f as (select image_id, det_id, case when not hue then 'color' when size_ratio < 0.01 then 'too small' when size_ratio > 0.03 then 'too large'
  when not aspect between 0.6 and 1.1 then 'aspect' end as reason from c),
 n as (select image_id, count(*) filter (where reason is null) as kept, count(*) filter (where reason is not null) as rejected from f group by image_id),
 o as (select image_id, string_agg(reason, '; ' order by det_id) as txt from (select *, row_number() over (partition by image_id order by det_id) as k
  from f where reason is not null) where k <= 3 group by image_id)
select image_id, kept, rejected, coalesce(txt, '') || case when rejected > 3 then ' + ' || cast(rejected - 3 as varchar) || ' more' else '' end as report
 from n left join o using (image_id)""")
def filter_reports(t):
    rated = _attributes(t).withColumn("reason", FL.reject_reason(**_WANT))
    return FL.filter_report(rated, ["image_id"])


@query("valid_mask_texts", "", "select doc_id from documents where length(text) > 4")
def valid_mask_texts(t):
    d = t.raw("documents").select("doc_id", F.col("text").alias("counts"))
    return FL.valid_mask_text(d).select("doc_id")


@query("selected_by_index", "", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def selected_by_index(t):
    return FL.select_by_index(t.raw("documents"), t.raw("labels").where("quality = 1"), ["doc_id"]).select("doc_id", "lang")


@query("gated_detections", "track_obs", """
select video_id, det_id from track_obs where video_id in (select distinct cast(floor(event_id / 400) as bigint) from events
 where (event_type = 'click' and value > 20) or value > 60)""")
def gated_detections(t):
    prompts = t.raw("events").selectExpr("cast(floor(event_id / 400) as bigint) as video_id",
                                         "case when event_type = 'click' and value > 20 then event_type end as text", "value > 60 as has_box")
    return FL.gate_new_detections(t.track_obs(), prompts).select("video_id", "det_id")


@query("accepted_replies", "", """
, r as (select conv_id, turn, nullif(lower(text), '') as reply from conversations)
select conv_id, turn, coalesce(contains(trim(reply), 'e') and not contains(left(trim(reply), 10), 'no'), true) as keep from r""".replace(", r as", "with r as", 1)
       .replace("contains(trim(reply), 'e')", "contains(trim(reply), 'yes')"))
def accepted_replies(t):
    c = t.raw("conversations").select("conv_id", "turn", FL.accept_yes_no(F.nullif("text", F.lit("")), "lenient").alias("keep"))
    return c


@query("accepted_replies_strict", "", """
select conv_id, turn, coalesce(contains(lower(text), 'yes') and not contains(left(lower(text), 5), 'no'), false) as keep from conversations""")
def accepted_replies_strict(t):
    return t.raw("conversations").select("conv_id", "turn", FL.accept_yes_no(F.col("text"), "strict").alias("keep"))


# ---- selection -----------------------------------------------------------------------

@query("mask_centroids", "detections images", """
select image_id, det_id, (x1 / w + x2 / w) / 2 * w as px, (y1 / h + y2 / h) / 2 * h as py from detections join images using (image_id)""")
def mask_centroids(t):
    rel = B.normalize_boxes(t.detections().join(t.images(), "image_id")).drop("w", "h", "gsd")
    return S.centroids(rel, t.images()).select("image_id", "det_id", "px", "py")


_PTS = ", p as (select image_id, det_id, (x1 + x2) / 2 as px, (y1 + y2) / 2 as py from detections)"


def _nth(order: str, n: int) -> str:
    return (_PTS + f", r as (select *, row_number() over (partition by image_id order by {order}) as k, count(*) over (partition by image_id) as n from p)"
            f" select image_id, det_id from r where k = least({n}, n)")


def _all_of(fn: str, v: str) -> str:
    return _PTS + f", e as (select image_id, {fn}({v}) as v from p group by image_id) select p.image_id, det_id from p join e on p.image_id = e.image_id and {v} = e.v"


_SPATIAL = {
    "leftmost": _nth("px, det_id", 1), "rightmost": _nth("px desc, det_id", 1),
    "topmost": _nth("py, det_id", 1), "bottommost": _nth("py desc, det_id", 1),
    "center": _nth("sqrt((px - 256) * (px - 256) + (py - 272) * (py - 272)), det_id", 1),
    "second_from_left": _nth("px, det_id", 2), "second_from_right": _nth("px desc, det_id desc", 2),
    "third_from_left": _nth("px, det_id", 3), "third_from_right": _nth("px desc, det_id desc", 3),
    "left_of_all": _all_of("min", "px"), "right_of_all": _all_of("max", "px"),
    "above_all": _all_of("min", "py"), "below_all": _all_of("max", "py"),
}


def _spatial(criterion):
    def run(t):
        return S.select_spatial(t.detections(), criterion, F.lit(512.0), F.lit(544.0)).select("image_id", "det_id")

    return run


for _name, _sql in _SPATIAL.items():
    query(f"select_{_name}", "detections", _sql)(_spatial(_name))

_REL = {
    "left_of": "p.px < r.px", "right_of": "p.px > r.px", "above": "p.py < r.py", "below": "p.py > r.py",
    "near": "sqrt((p.px - r.px) * (p.px - r.px) + (p.py - r.py) * (p.py - r.py)) <= sqrt(512.0 * 512.0 + 544.0 * 544.0) * {d}",
    "far_from": "sqrt((p.px - r.px) * (p.px - r.px) + (p.py - r.py) * (p.py - r.py)) > sqrt(512.0 * 512.0 + 544.0 * 544.0) * {d}",
}
_REL_DIST = {"near": 0.05, "far_from": 0.5}


def _relative(relation):
    def run(t):
        d = t.detections()
        refs = d.where("score > 0.95 and prompt = 'p1'").select("image_id", "det_id")
        return S.select_relative(d, relation, refs, F.sqrt(F.lit(512.0 * 512.0 + 544.0 * 544.0)),
                                 _REL_DIST.get(relation, 0.2)).select("image_id", "det_id")

    return run


for _name, _sql in _REL.items():
    query(f"relative_{_name}", "detections", f"""
, p as (select image_id, det_id, (x1 + x2) / 2 as px, (y1 + y2) / 2 as py, score > 0.95 and prompt = 'p1' as ref from detections)
select p.image_id, p.det_id from p where not p.ref and exists (select 1 from p r where r.image_id = p.image_id and r.ref
 and {_sql.format(d=_REL_DIST.get(_name))})""")(_relative(_name))


@query("point_box_distances", "detections", """
, pt as (select image_id, min(x1) + 100 as px, max(y2) - 100 as py from detections group by image_id)
select image_id, det_id, px - x1 as "left", py - y1 as top, x2 - px as "right", y2 - py as bottom from detections join pt using (image_id)""")
def point_box_distances(t):
    d = t.detections()
    pts = d.groupBy("image_id").agg((F.min("x1") + 100).alias("px"), (F.max("y2") - 100).alias("py"))
    return S.point_box_distance(pts, d).select("image_id", "det_id", "left", "top", "right", "bottom")


# ---- windows and set operations ---------------------------------------------------------

@query("top_k_per_image", "detections", """
select image_id, det_id, score, k as rank from (select *, row_number() over (partition by image_id order by score desc, det_id) as k from detections) where k <= 50""")
def top_k_per_image(t):
    return S.top_k(t.detections(), 50).select("image_id", "det_id", "score", "rank")


@query("capacity_limited", "track_obs tracks", """
, u as (select video_id, count(*) as n from tracks group by video_id)
select video_id, det_id from (select *, row_number() over (partition by video_id order by score desc, det_id) as k from track_obs) o
 left join u using (video_id) where k <= 380 - coalesce(n, 0)""")
def capacity_limited(t):
    return S.within_capacity(t.track_obs(), t.tracks(), 380).select("video_id", "det_id")


@query("assigned_ids", "track_obs tracks", """
, u as (select video_id, max(obj_id) as m from tracks group by video_id)
select video_id, det_id, coalesce(m, 0) + row_number() over (partition by video_id order by det_id) as obj_id
 from (select * from track_obs where score >= 0.7) o left join u using (video_id)""")
def assigned_ids(t):
    return S.assign_ids(t.track_obs().where("score >= 0.7"), t.tracks(), span=128).select("video_id", "det_id", "obj_id")


@query("ordered_by_score", "detections", """
select image_id, det_id, score, row_number() over (partition by image_id order by score desc, det_id) as place from detections""")
def ordered_by_score(t):
    from visiontables.operators.numbering import position_in_order

    rows = t.detections().select("image_id", "det_id", "score")
    return position_in_order(rows, ["image_id"], [F.desc("score"), F.asc("det_id")], "place").select("image_id", "det_id", "score", "place")


@query("union_of_prompts", "detections", "select prompt, count(*) as n, sum(cast(score * 10000 as bigint))::bigint as total from detections group by prompt")
def union_of_prompts(t):
    d = t.detections()
    u = d.where("prompt <= 'p3'").unionByName(d.where("prompt > 'p3'"))
    return u.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 10000).cast("bigint")).alias("total"))


@query("id_difference", "", "select doc_id from documents except select doc_id from labels where toxic = 1")
def id_difference(t):
    return t.raw("documents").select("doc_id").join(t.raw("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("processing_order", "track_obs", """
, v as (select video_id, max(frame_idx) + 1 as n, min(frame_idx) filter (where score > 0.995) as s from track_obs group by video_id),
 f as (select video_id, true as forward, unnest(range(s, least(s + 30, n - 1) + 1)) as frame_idx, s from v where s is not null),
 b as (select video_id, false as forward, unnest(range(greatest(s - 30, 0), s)) as frame_idx, s from v where s is not null)
select video_id, forward, frame_idx, case when forward then frame_idx - s else s - 1 - frame_idx end as step from (select * from f union all select * from b)""")
def processing_order(t):
    from visiontables.operators.tracks import processing_order as po

    v = t.track_obs().groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"),
                                              F.min(F.when(F.col("score") > 0.995, F.col("frame_idx"))).alias("start"))
    return po(v, 30, False).unionByName(po(v, 30, True))
