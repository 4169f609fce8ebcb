"""Queries on mask run tables, areas, colours and heat maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.catalog.registry import query
from visiontables.fixtures import MASK_H, MASK_W
from visiontables.operators import measure as M
from visiontables.operators import overlap as O
from visiontables.operators import packed as P
from visiontables.operators import runs as R

KEYS = ["image_id", "det_id"]
_PX = ", px as (select image_id, det_id, x, unnest(range(ys, ye)) as y from mask_runs)"
H, W = MASK_H, MASK_W


@query("mask_areas", "mask_runs", "select image_id, det_id, sum(ye - ys)::bigint as area from mask_runs group by image_id, det_id")
def mask_areas(t):
    return M.mask_area(t.mask_runs(), KEYS)


# the last tenth of the score range has no mask
_SOME = ", held as (select r.* from mask_runs r semi join (select * from detections where score < 0.9) d on r.image_id = d.image_id and r.det_id = d.det_id)"


_HELD = "score < 0.9"


def _some(t):
    d = t.detections()
    return d, t.mask_runs().join(d.where(_HELD).select(*KEYS), KEYS, "left_semi")


def _bbox_sql(exprs: str) -> str:
    return _SOME + f"""
, b as (select image_id, det_id, min(x) as a, min(ys) as b, max(x) as c, max(ye) - 1 as d from held group by image_id, det_id)
select d.image_id, d.det_id, {exprs} from detections d left join b on b.image_id = d.image_id and b.det_id = d.det_id"""


for _conv, _exprs in {
    "exclusive": "coalesce(a, 0) as x1, coalesce(b.b, 0) as y1, coalesce(c + 1, 0) as x2, coalesce(b.d + 1, 0) as y2",
    "inclusive": "coalesce(a, 0) as x1, coalesce(b.b, 0) as y1, coalesce(c, 0) as x2, coalesce(b.d, 0) as y2",
    "inverted": f"coalesce(a, {W}) as x1, coalesce(b.b, {H}) as y1, coalesce(c, 0) as x2, coalesce(b.d, 0) as y2",
    "xywh": "coalesce(a, 0) as x, coalesce(b.b, 0) as y, coalesce(c - a + 1, 0) as w, coalesce(b.d - b.b + 1, 0) as h",
}.items():
    def _bbox(t, conv=_conv):
        dims = {"w": F.lit(W).cast("bigint"), "h": F.lit(H).cast("bigint")} if conv == "inverted" else {}
        return M.mask_bbox(t.detections(), t.mask_runs(), KEYS, conv, held=F.expr(_HELD), **dims)

    query(f"mask_bbox_{_conv}", "detections mask_runs", _bbox_sql(_exprs))(_bbox)


@query("valid_masks", "detections mask_runs", _SOME + "select d.image_id, d.det_id from detections d semi join held s on s.image_id = d.image_id and s.det_id = d.det_id")
def valid_masks(t):
    from visiontables.operators.filters import with_runs

    d, runs = _some(t)
    return with_runs(d, runs, KEYS).select(*KEYS)


_PAIRS = """
, area as (select image_id, det_id, sum(ye - ys)::bigint as area from mask_runs group by image_id, det_id),
 inter as (select a.image_id, a.det_id as a, b.det_id as b, sum(least(a.ye, b.ye) - greatest(a.ys, b.ys))::bigint as inter
  from mask_runs a join mask_runs b on a.image_id = b.image_id and a.x = b.x and a.ys < b.ye and b.ys < a.ye and a.det_id < b.det_id group by 1, 2, 3)
"""


@query("mask_overlap_pairs", "mask_runs", _PAIRS + """
select i.image_id, i.a as det_id, i.b as det_id_2, inter, p.area as area_a, q.area as area_b, inter / greatest(p.area + q.area - inter, 1)::double as iou,
 inter / (greatest(least(p.area, q.area), 1) + 1e-8) as iom from inter i join area p on p.image_id = i.image_id and p.det_id = i.a
 join area q on q.image_id = i.image_id and q.det_id = i.b""")
def mask_overlap_pairs(t):
    r = t.mask_runs()
    return O.mask_overlap_join(r, r, ["image_id"], "det_id", "det_id", once=True)


@query("best_truth_match", "mask_runs detections", """
, d as (select * from detections), area as (select image_id, det_id, sum(ye - ys)::bigint as area from mask_runs group by image_id, det_id),
 inter as (select a.image_id, a.det_id as g, b.det_id as c, sum(least(a.ye, b.ye) - greatest(a.ys, b.ys))::bigint as inter
  from mask_runs a join mask_runs b on a.image_id = b.image_id and a.x = b.x and a.ys < b.ye and b.ys < a.ye
  join d p on p.image_id = a.image_id and p.det_id = a.det_id and p.prompt = 'p1'
  join d q on q.image_id = b.image_id and q.det_id = b.det_id and q.prompt in ('p2', 'p3') group by 1, 2, 3),
 s as (select i.image_id, g, c, inter / (p.area + q.area - inter)::double as iou from inter i join area p on p.image_id = i.image_id and p.det_id = g
   join area q on q.image_id = i.image_id and q.det_id = c),
 b as (select *, row_number() over (partition by image_id, g order by iou desc, c) as k from s),
 z as (select image_id, det_id as c, row_number() over (partition by image_id order by score desc, det_id) as k from d where prompt in ('p2', 'p3'))
select d.image_id, d.det_id, coalesce(b.c, z.c) as candidate, coalesce(b.iou, 0.0::double) as iou from d
 left join b on b.image_id = d.image_id and b.g = d.det_id and b.k = 1 left join z on z.image_id = d.image_id and z.k = 1 where d.prompt = 'p1'""")
def best_truth_match(t):
    from visiontables.operators.tracks import best_gt_match

    d, r = t.detections(), t.mask_runs()
    return best_gt_match(d.where("prompt = 'p1'"), d.where("prompt in ('p2', 'p3')"), r, ["image_id"])


@query("runs_from_pixels", "mask_runs", "select image_id, det_id, x, ys, ye from mask_runs")
def runs_from_pixels(t):
    return R.encode_runs(R.runs_to_pixels(t.mask_runs(), KEYS), KEYS).select(*KEYS, "x", "ys", "ye")


_COUNTS = f"""
, s as (select image_id, det_id, x * {H} + ys as s, x * {H} + ye as e from mask_runs),
 g as (select *, sum(n) over (partition by image_id, det_id order by s) as g from
  (select *, case when lag(e) over (partition by image_id, det_id order by s) = s then 0 else 1 end as n from s)),
 m as (select image_id, det_id, g, min(s) as s, max(e) as e from g group by 1, 2, 3),
 l as (select *, s - coalesce(lag(e) over (partition by image_id, det_id order by s), 0) as gap from m),
 c as (select image_id, det_id, string_agg(gap || ' ' || (e - s), ' ' order by s) ||
  case when max(e) < {W * H} then ' ' || ({W * H} - max(e)) else '' end as counts from l group by 1, 2)
"""


def _counts(t):
    return R.encode_counts(t.mask_runs(), KEYS, F.lit(H), F.lit(W))


@query("mask_counts", "mask_runs", _COUNTS + "select * from c")
def mask_counts(t):
    return _counts(t).withColumn("counts", F.array_join(F.transform("counts", lambda v: v.cast("string")), " "))


@query("decoded_runs", "mask_runs", "select image_id, det_id, x, ys, ye from mask_runs")
def decoded_runs(t):
    return R.decode_runs(_counts(t), KEYS, F.lit(H)).select(*KEYS, "x", "ys", "ye")


@query("decoded_row_major", "mask_runs", _COUNTS + f"""
, n as (select image_id, det_id, unnest(string_split(counts, ' ')) as v, generate_subscripts(string_split(counts, ' '), 1) as i from c),
 e as (select image_id, det_id, i, v::bigint as v, sum(v::bigint) over (partition by image_id, det_id order by i)::bigint as e from n),
 p as (select image_id, det_id, unnest(range(e - v, e)) as p from e where i % 2 = 0)
select image_id, det_id, count(*) as area, sum(p % {W})::bigint as sx, sum(p // {W})::bigint as sy from p group by 1, 2""")
def decoded_row_major(t):
    r = R.decode_runs(_counts(t), KEYS, F.lit(H), F.lit(W), row_major=True)
    p = R.runs_to_pixels(r, KEYS)
    return p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("coco_text_round_trip", "mask_runs", _COUNTS + "select image_id, det_id, counts from c")
def coco_text_round_trip(t):
    texts = R.encode_coco_counts(_counts(t)).drop("counts")
    back = R.decode_coco_counts(texts, "text", "counts")
    return back.select(*KEYS, F.array_join(F.transform("counts", lambda v: v.cast("string")), " ").alias("counts"))


@query("normalized_mask_reprs", "", f"""
select doc_id, case when doc_id % 3 = 0 then text else concat('old ', text) end as counts,
 case when doc_id % 2 = 0 and doc_id % 3 = 0 then 7::bigint else {H} end as h from documents""")
def normalized_mask_reprs(t):
    d = t.raw("documents").select(
        "doc_id", F.concat(F.lit("old "), "text").alias("text"),
        F.when(F.col("doc_id") % 3 == 0, F.struct(
            F.col("text").alias("counts"),
            F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(7).cast("bigint"), F.lit(9).cast("bigint"))).alias("size"))).alias("rle"))
    n = R.normalize_mask_repr(d, "text", "rle", F.lit(H).cast("bigint"), F.lit(W).cast("bigint"))
    return n.select("doc_id", "counts", F.col("size")[0].alias("h"))


@query("placed_masks", "mask_runs", f"""
select image_id, det_id, x + 21 as x, greatest(ys - 9, 0) as ys, least(ye - 9, {H} - 20) as ye from mask_runs
 where x + 21 < {W} and x + 21 >= 0 and least(ye - 9, {H} - 20) > greatest(ys - 9, 0)""")
def placed_masks(t):
    off = lambda v, s: F.lit(int(v / s)).cast("bigint")
    return R.place_masks(t.mask_runs(), off(11, 0.5) - 1, -off(9, 1.0), F.lit(W), F.lit(H - 20)).select(*KEYS, "x", "ys", "ye")


@query("resized_masks", "mask_runs", f"""
, t as (select image_id, det_id, unnest(range(ceil(x * 96 / {W}.0)::bigint, ceil((x + 1) * 96 / {W}.0)::bigint)) as x,
 ceil(ys * 41 / {H}.0)::bigint as ys, ceil(ye * 41 / {H}.0)::bigint as ye from mask_runs) select * from t where ye > ys""")
def resized_masks(t):
    return R.resize_runs(t.mask_runs(), W, H, 96, 41)


_PIX_RUNS = """
, isl as (select {k}, x, y, y - row_number() over (partition by {k}, x order by y) as g from res)
select {k}, x, min(y) as ys, max(y) + 1 as ye from isl group by {k}, x, g"""


@query("mask_unions", "mask_runs", _PX + ", res as (select distinct image_id, x, y from px)" + _PIX_RUNS.format(k="image_id"))
def mask_unions(t):
    return R.mask_union(t.mask_runs(), ["image_id"]).select("image_id", "x", "ys", "ye")


_TWO = _PX + """
, pd as (select image_id, det_id, x + 2 as x, y + 1 as y from px), gt as (select * from px),
 fp as (select 'fp' as kind, * from (select * from pd except select * from gt)), fn as (select 'fn' as kind, * from (select * from gt except select * from pd)),
 res as (select * from fp union all select * from fn)"""


def _pred(t):
    return t.mask_runs().withColumns({"x": F.col("x") + 2, "ys": F.col("ys") + 1, "ye": F.col("ye") + 1})


@query("error_regions", "mask_runs", _TWO + _PIX_RUNS.format(k="image_id, det_id, kind"))
def error_regions(t):
    return R.error_regions(_pred(t), t.mask_runs(), KEYS).select(*KEYS, "kind", "x", "ys", "ye")


@query("mask_intersections", "mask_runs", _TWO.split(",\n fp as")[0] + ", res as (select * from pd intersect select * from gt)" + _PIX_RUNS.format(k="image_id, det_id"))
def mask_intersections(t):
    return R.mask_combine(_pred(t), t.mask_runs(), KEYS, "intersect").select(*KEYS, "x", "ys", "ye")


_RESOLVED = _PX + """
, res as (select image_id, det_id, x, y from (select px.*, row_number() over (partition by px.image_id, x, y order by score desc, px.det_id) as k
   from px join detections d on d.image_id = px.image_id and d.det_id = px.det_id) where k = 1)"""


def _resolved(t):
    scored = P.join_packed(t.mask_runs(), t.detections().select(*KEYS, "score"), KEYS)
    return R.resolve_overlaps(scored, ["image_id"], "det_id", [-F.col("score")])


@query("resolved_overlaps", "detections mask_runs", _RESOLVED + _PIX_RUNS.format(k="image_id, det_id"))
def resolved_overlaps(t):
    return _resolved(t).select(*KEYS, "x", "ys", "ye")


# the area before is that of the runs; the pixels are made once
@query("shrunk_dropped", "detections mask_runs", _RESOLVED.replace(" as (select image_id, det_id, x, y from", " as materialized (select image_id, det_id, x, y from").replace("px as (", "px as materialized (") + """
, a as (select image_id, det_id, sum(ye - ys) as n from mask_runs group by 1, 2), b as (select image_id, det_id, count(*) as n from res group by 1, 2),
 ok as (select a.image_id, a.det_id from a left join b using (image_id, det_id) where coalesce(b.n, 0) / a.n::double >= 0.6)
select r.* from mask_runs r semi join ok on ok.image_id = r.image_id and ok.det_id = r.det_id""")
def shrunk_dropped(t):
    return R.drop_shrunk(t.mask_runs(), _resolved(t), KEYS, 0.6).select(*KEYS, "x", "ys", "ye")


@query("mask_edges", "mask_runs", _PX + f"""
, g as (select image_id, det_id, x + dx as x, y + dy as y from px, (values (0, 0), (-1, 0), (0, -1)) o(dx, dy)),
 c as (select distinct * from g where x between 1 and {W - 2} and y between 1 and {H - 2}),
 v as (select c.*, m.x is not null as cur, r.x is not null as rgt, b.x is not null as bot from c
  left join px m on m.image_id = c.image_id and m.det_id = c.det_id and m.x = c.x and m.y = c.y
  left join px r on r.image_id = c.image_id and r.det_id = c.det_id and r.x = c.x + 1 and r.y = c.y
  left join px b on b.image_id = c.image_id and b.det_id = c.det_id and b.x = c.x and b.y = c.y + 1)
select image_id, det_id, count(*) as edges, sum(x)::bigint as sx, sum(y)::bigint as sy, sum(x * y)::bigint as sxy from v where cur <> rgt or cur <> bot group by 1, 2""")
def mask_edges(t):
    e = R.mask_edges(t.mask_runs(), KEYS, W, H)
    return e.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("edges"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))


@query("rasterized_polygons", "detections", """
, v as (select image_id, det_id, [{'x': x1 / 8, 'y': y1 / 8}, {'x': x2 / 8, 'y': y1 / 8 + 0.6}, {'x': (x1 + x2) / 16, 'y': y1 / 8 + 3}, {'x': x2 / 8 - 0.9, 'y': y2 / 8}, {'x': x1 / 8 + 0.3, 'y': y2 / 8 - 1}] as p from detections),
 e as (select image_id, det_id, p[i] as p, p[i % 5 + 1] as q from (select *, unnest(range(1, 6)) as i from v)),
 c as (select image_id, det_id, p, q, unnest(range(ceil(least(p.x, q.x) - 0.5)::bigint, ceil(greatest(p.x, q.x) - 0.5)::bigint)) as x from e),
 y as (select image_id, det_id, x, p.y + (x + 0.5 - p.x) * (q.y - p.y) / (q.x - p.x) as y from c),
 k as (select *, row_number() over w as i, lead(y) over w as z from y window w as (partition by image_id, det_id, x order by y))
select image_id, det_id, x, ceil(y - 0.5)::bigint as ys, ceil(z - 0.5)::bigint as ye from k where i % 2 = 1 and ceil(z - 0.5) > ceil(y - 0.5)""")
def rasterized_polygons(t):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) / 8 for c in ("x1", "y1", "x2", "y2"))
    mid = (F.col("x1") + F.col("x2")) / 16
    d = t.detections().select(*KEYS, F.array(pt(x1, y1), pt(x2, y1 + 0.6), pt(mid, y1 + 3), pt(x2 - 0.9, y2), pt(x1 + 0.3, y2 - 1)).alias("points"))
    return R.rasterize_polygons(d, KEYS)


@query("masks_as_tracks", "detections mask_runs", _SOME + f"""
, b as (select image_id, det_id, min(x) as a, min(ys) as b, max(x) as c, max(ye) - 1 as d from held group by image_id, det_id),
 n as (select *, row_number() over (partition by image_id order by det_id) as pos from detections)
select n.image_id, n.det_id, n.pos - 1 as obj_id, case when n.det_id % 2 = 0 then n.score else 1.0::double end as prob,
 case when n.det_id % 3 = 0 then x1 / {W} when n.det_id % 3 = 1 then x1 / 1000 else coalesce(a / {W}, 0.0::double) end as x,
 case when n.det_id % 3 = 0 then y1 / {H} when n.det_id % 3 = 1 then y1 / 1000 else coalesce(b.b / {H}, 0.0::double) end as y,
 case when n.det_id % 3 = 0 then (x2 - x1) / {W} when n.det_id % 3 = 1 then (x2 - x1) / 1000 else coalesce((c - a + 1) / {W}, 0.0::double) end as w,
 case when n.det_id % 3 = 0 then (y2 - y1) / {H} when n.det_id % 3 = 1 then (y2 - y1) / 1000 else coalesce((b.d - b.b + 1) / {H}, 0.0::double) end as h
 from n left join b on b.image_id = n.image_id and b.det_id = n.det_id""")
def masks_as_tracks(t):
    from visiontables.operators.numbering import position_in_order

    d, runs = t.detections(), t.mask_runs()
    box = M.mask_bbox(d, runs, KEYS, "inclusive", held=F.expr(_HELD)).withColumnsRenamed({c: "m" + c for c in ("x1", "y1", "x2", "y2")})
    has = runs.select(*KEYS).distinct().join(d.where(_HELD).select(*KEYS), KEYS, "left_semi").withColumn("_has", F.lit(True))
    a = position_in_order(d, ["image_id"], [F.asc("det_id")], "pos").join(box, KEYS).join(has, KEYS, "left")
    a = a.withColumns({"m" + c: F.when(F.col("_has"), F.col("m" + c)) for c in ("x1", "y1", "x2", "y2")})
    kind = F.col("det_id") % 3
    given = {"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    a = a.withColumns({f"bbox_{k}": F.when(kind == 0, v).when(kind == 1, v / 1000) for k, v in given.items()})
    w, h = F.lit(float(W)), F.lit(float(H))
    pred = R.coco_to_tracks(a.where("det_id % 2 = 0"), w, h, True)
    true = R.coco_to_tracks(a.where("det_id % 2 <> 0"), w, h, False)
    return pred.unionByName(true).select(*KEYS, "obj_id", "prob", "x", "y", "w", "h")


@query("empty_masks_dropped", "detections mask_runs", _SOME + "select image_id, det_id, score from detections d where exists (select 1 from held s where s.image_id = d.image_id and s.det_id = d.det_id)")
def empty_masks_dropped(t):
    d, runs = _some(t)
    return R.drop_empty_masks(d, runs, KEYS).select(*KEYS, "score")


# ---- measures ------------------------------------------------------------------------

_AREA = _SOME + """
, a as (select image_id, det_id, sum(ye - ys)::bigint as area from held group by 1, 2),
 o as (select d.image_id, d.det_id, d.score, coalesce(a.area, trunc((x2 - x1) * (y2 - y1))::bigint) as pixel_area
  from detections d left join a on a.image_id = d.image_id and a.det_id = d.det_id),
 ob as (select o.*, round(pixel_area * gsd * gsd, 4) as real_area from o join images using (image_id) where pixel_area > 0)
"""


def _areas(t):
    d, runs = _some(t)
    return M.measure_area(d, M.mask_area(runs, KEYS), t.images())


@query("object_areas", "detections images mask_runs", _AREA + "select image_id, det_id, score, pixel_area, real_area from ob")
def object_areas(t):
    return _areas(t).select(*KEYS, "score", "pixel_area", "real_area")


@query("area_totals", "detections images mask_runs", _AREA + """
select image_id, count(det_id) as objects, coalesce(sum(pixel_area), 0)::bigint as pixel_area, round(coalesce(sum(pixel_area), 0)::bigint * any_value(gsd) * any_value(gsd), 4) as real_area,
 round(coalesce(sum(pixel_area), 0)::bigint / any_value(w * h) * 100, 4) as coverage from images left join ob using (image_id) group by image_id""")
def area_totals(t):
    return M.area_totals(_areas(t), t.images())


@query("verification_summary", "detections", """
select image_id, 1 + cast(substr(prompt, 2) as bigint) % 3 as attempt, count(*) as raw, count(*) filter (where score >= 0.8) as verified,
 count(*) - count(*) filter (where score >= 0.8) as rejected from detections group by 1, 2""")
def verification_summary(t):
    return M.verification_summary(_attempts(t), ["image_id"], F.col("score") >= 0.8)


def _attempts(t):
    return t.detections().withColumn("attempt", 1 + F.substring("prompt", 2, 9).cast("bigint") % 3)


@query("verification_totals", "detections", """
, s as (select image_id, 1 + cast(substr(prompt, 2) as bigint) % 3 as attempt, count(*) filter (where score >= 0.8) as v, count(*) as n from detections group by 1, 2)
select image_id, max_by(v, attempt) as verified, sum(n - v)::bigint as rejected, count(*) as attempts from s group by 1""")
def verification_totals(t):
    return M.verification_totals(M.verification_summary(_attempts(t), ["image_id"], F.col("score") >= 0.8), ["image_id"])


@query("confidence_histogram", "detections", """
select image_id, count(*) filter (where score >= 0.8) as high, count(*) filter (where score >= 0.5 and score < 0.8) as medium, count(*) filter (where score < 0.5) as low
 from detections group by image_id""")
def confidence_histogram(t):
    d = t.detections().withColumn("confidence", F.when(F.col("score") >= 0.8, "high").when(F.col("score") < 0.5, "LOW"))
    return M.confidence_histogram(d, ["image_id"])


@query("frame_stats", "track_obs", "select video_id, frame_idx, count(*) filter (where matched) as tracked, count(*) filter (where not matched) as dropped from track_obs group by 1, 2")
def frame_stats(t):
    return M.frame_stats(t.track_obs(), ~F.col("matched"))


@query("mean_colors", "detections mask_runs pixels", """
, m as (select r.image_id, r.det_id, floor(avg(r))::bigint as r, floor(avg(g))::bigint as g, floor(avg(b))::bigint as b from mask_runs r
 join pixels p on p.image_id = r.image_id and p.x = r.x and p.y >= r.ys and p.y < r.ye group by 1, 2)
select d.image_id, d.det_id, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from detections d left join m on m.image_id = d.image_id and m.det_id = d.det_id""")
def mean_colors(t):
    return M.mean_color(t.detections(), t.mask_runs(), t.pixels(), KEYS)


_PALETTE = {"red": (255, 0, 0), "lime": (0, 255, 0), "navy": (0, 0, 128), "white": (255, 255, 255), "teal": (0, 128, 128)}
_PAL_SQL = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(_PALETTE.items()))


@query("farthest_colors", "pixels", f"""
, m as (select image_id, n, i, round(avg(sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb))), 9) as d from pixels,
 (values {_PAL_SQL}) p(i, n, pr, pg, pb) group by 1, 2, 3)
select image_id, n as color, d as distance from (select *, row_number() over (partition by image_id order by d desc, i) as k from m) where k = 1""")
def farthest_colors(t):
    return M.farthest_palette_color(t.pixels(), _PALETTE, ["image_id"])


@query("segment_histogram", "pixels", """
, l as (select image_id, case when g < 10 then -1 else r // 64 * 1000 + b // 128 end as label from pixels)
select image_id, label, count(*) as area, label // 1000 as category, label // 1000 in (1, 2) as is_thing from l where label <> -1 group by 1, 2 having count(*) >= 40""")
def segment_histogram(t):
    label = F.when(F.col("g") < 10, -1).otherwise(F.floor(F.col("r") / 64) * 1000 + F.floor(F.col("b") / 128))
    s = M.segment_histogram(t.pixels().select("image_id", label.alias("label")), ["image_id"], 1000, [1, 2], 40)
    return s.select("image_id", "label", "area", "category", "is_thing")


@query("keypoint_bins", "detections", """
, k as (select *, x1 + score * 130 - 10 as px, case when det_id % 6 = 0 then y2 else y1 + score * 100 - 20 end as py, det_id % 3 as visible from detections),
 b as (select *, case when px = x2 then 55 else floor((px - x1) * (56 / (x2 - x1)))::bigint end as bx, case when py = y2 then 55 else floor((py - y1) * (56 / (y2 - y1)))::bigint end as bb from k),
 v as (select *, case when bx >= 0 and bb >= 0 and bx < 56 and bb < 56 and visible > 0 then 1::bigint else 0 end as valid from b)
select image_id, det_id, (bb * 56 + bx) * valid as bin, valid from v""")
def keypoint_bins(t):
    d = t.detections().withColumns({
        "px": F.col("x1") + F.col("score") * 130 - 10, "visible": F.col("det_id") % 3,
        "py": F.when(F.col("det_id") % 6 == 0, F.col("y2")).otherwise(F.col("y1") + F.col("score") * 100 - 20)})
    return M.keypoint_bins(d, 56).select(*KEYS, "bin", "valid")


@query("heatmap_peaks", "", """
, p as""".replace(", p as", "with p as") + """ (select vec_id, list_transform(embedding, lambda v: v::double) as v from embeddings), m as (select vec_id, v, list_max(v) as top from p)
select vec_id, (list_position(v, top) - 1)::bigint % 8 as peak_x, (list_position(v, top) - 1)::bigint // 8 as peak_y, top as peak,
 round(1 / list_sum(list_transform(v, lambda x: exp(x - top))), 9) as share from m""")
def heatmap_peaks(t):
    p = M.heatmap_peak(t.raw("embeddings"), "embedding", 8)
    return p.select("vec_id", "peak_x", "peak_y", "peak", F.round("share", 9).alias("share"))


_CANDS = """with s as (select vec_id // 4 as grp, vec_id % 4 as cand, embedding[1]::double as score,
 case when len(list_filter(embedding, lambda v: v > -0.02)) > 0 then len(list_filter(embedding, lambda v: v > 0.02)) / len(list_filter(embedding, lambda v: v > -0.02)) else 1.0::double end as stability from embeddings)
"""


def _cands(t):
    return t.raw("embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("grp"), (F.col("vec_id") % 4).alias("cand"), F.col("embedding")[0].cast("double").alias("score"),
        M.stability_score(F.transform("embedding", lambda v: v.cast("double")), 0.02).alias("stability"))


@query("stability_scores", "", _CANDS + "select grp, cand, score, stability from s")
def stability_scores(t):
    return _cands(t)


@query("chosen_candidates", "", _CANDS + """
select grp, case when max(case when cand = 0 then stability end) >= 0.9 then 0 else max_by(cand, score) filter (where cand <> 0) end as cand from s group by grp""")
def chosen_candidates(t):
    return M.choose_candidate(_cands(t), ["grp"], 0.9)


@query("best_by_logit", "", _CANDS + "select grp, max_by(cand, score) as cand from s group by grp")
def best_by_logit(t):
    return M.best_by_logit(_cands(t), ["grp"])


@query("failed_prompts", "detections", """
, s as (select image_id, prompt from detections group by 1, 2 having count(*) filter (where score >= 0.95) = 0)
select image_id, string_agg(prompt, ', ' order by prompt) as failed, count(*) as failures from s group by 1""")
def failed_prompts(t):
    return M.failed_prompts(M.prompt_summary(t.detections(), ["image_id"], F.col("score") >= 0.95), ["image_id"])


@query("counted_with_zeros", "detections images", """
, p as (select distinct image_id, 'p' || k as prompt from images, range(1, 8) r(k))
select p.image_id, p.prompt, count(d.det_id) as objects from p left join (select * from detections where score >= 0.9) d using (image_id, prompt) group by 1, 2""")
def counted_with_zeros(t):
    asked = t.images().select("image_id", F.explode(F.array(*[F.lit(f"p{k}") for k in range(1, 8)])).alias("prompt"))
    return M.count_objects(asked, t.detections().where("score >= 0.9"), ["image_id", "prompt"])
