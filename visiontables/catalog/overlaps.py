"""Queries on overlap joins, de-duplication and clustering."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from visiontables.catalog.registry import query
from visiontables.functions import boxes as B
from visiontables.operators import filters as FL
from visiontables.operators import nms as N
from visiontables.operators import overlap as O


def duck_iou(a: str, b: str) -> str:
    inter = (f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
             f" * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")
    area = lambda r: f"(({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(case when {union} > 0 then {inter} / {union} else 0.0 end)"


def duck_greedy(src: str, order: str, conflict: str, key: str = "image_id") -> str:
    """Greedy pass per key in DuckDB: a list fold in rank order. ``conflict``
    compares a kept row ``k`` with the next row ``d``."""
    return f"""
select {key}, unnest(kept).det_id as det_id from (select {key}, list_reduce(rows, lambda acc, nx:
  case when len(list_filter(acc, lambda k: {conflict.replace('d.', 'nx[1].')})) > 0 then acc else list_concat(acc, nx) end) as kept
 from (select {key}, list([{{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] order by {order}) as rows from {src} group by {key}))"""


_IOU = duck_iou("k", "d")

# ---- overlap joins --------------------------------------------------------------------


@query("iou_pairs", "detections", f"""
select a.image_id, a.det_id, b.det_id as det_id_2, {duck_iou('a', 'b')} as iou from detections a join detections b
 on a.image_id = b.image_id and a.det_id < b.det_id and {duck_iou('a', 'b')} >= 0.3""")
def iou_pairs(t):
    d = t.detections()
    return O.iou_join(d, d, 0.3, ["image_id"], "det_id", "det_id", once=True)


@query("touching_pairs", "detections", f"""
, p as (select a.image_id, a.det_id, b.det_id as det_id_2, {duck_iou('a', 'b')} as iou,
 greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab,
 (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) as hull
 from detections a join detections b on a.image_id = b.image_id and a.det_id < b.det_id)
select image_id, det_id, det_id_2, inter, iou, inter / ab as ioa, inter / (aa + ab - inter) - (hull - (aa + ab - inter)) / hull as giou from p where inter > 0""")
def touching_pairs(t):
    d = t.detections()
    return O.touch_join(d, d, ["image_id"], "det_id", "det_id", cell=128.0, once=True)


@query("row_matched_iou", "detections", """
, p as (select image_id, det_id, least(x2, y2) - greatest(x1, y1) as iw, least(y2, x2) - greatest(y1, x1) as ih,
  (x2 - x1) * (y2 - y1) as a, (greatest(x2, y2) - least(x1, y1)) * (greatest(y2, x2) - least(y1, x1)) as hull from detections),
 q as (select *, greatest(0.0, iw) * greatest(0.0, ih) as i from p)
select image_id, det_id, case when a + a - i > 0 then i / (a + a - i) else 0.0 end as iou, i / (a + a - i) - (hull - (a + a - i)) / hull as giou from q""")
def row_matched_iou(t):
    # each box against its own mirror image
    return O.matched_iou(t.detections(), ["x1", "y1", "x2", "y2"], ["y1", "x1", "y2", "x2"]).select("image_id", "det_id", "iou", "giou")


@query("unguarded_iou", "detections", """
, p as (select image_id, det_id, (x2 - x1) * (y2 - y1) as a from (select image_id, det_id, x1, least(x2, 300.0) as x2, y1, greatest(y1, least(y2, 300.0)) as y2 from detections) where x1 <= x2)
select image_id, det_id, case when a = 0 then null else a / (a + a - a) end as iou, cast(case when a = 0 then 0 else 1 end as double) as guarded from p""")
def unguarded_iou(t):
    d = t.detections().withColumns({"x2": F.least("x2", F.lit(300.0)), "y2": F.greatest("y1", F.least("y2", F.lit(300.0)))})
    d = d.where("x1 <= x2")
    box = B.box_columns()
    raw = B.iou(box, box, "none")
    return d.select("image_id", "det_id", F.when(~F.isnan(raw), raw).alias("iou"), B.iou(box, box, "intersection").alias("guarded"))


# ---- greedy de-duplication ----------------------------------------------------------------

@query("count_per_image", "detections images", f"""
, f as (select * from detections where score >= 0.5 and x2 > x1 and y2 > y1),
 k as ({duck_greedy('f', 'score desc, det_id', _IOU + ' >= 0.5')})
select image_id, count(k.det_id) as objects from images left join k using (image_id) group by image_id""")
def count_per_image(t):
    d = FL.drop_degenerate(FL.by_confidence(t.detections(), 0.5))
    kept = N.nms(d, ["image_id"], 0.5)
    n = kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return t.images().join(n, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("objects"))


@query("nms_box", "detections", duck_greedy("detections", "score desc, det_id", _IOU + " >= 0.5"))
def nms_box(t):
    return N.nms(t.detections(), ["image_id"], 0.5).select("image_id", "det_id")


@query("nms_report", "detections", f"""
, k as ({duck_greedy('detections', 'score desc, det_id', _IOU + ' >= 0.4')})
select image_id, count(*) as total, (select count(*) from k where k.image_id = d.image_id) as kept,
 count(*) - (select count(*) from k where k.image_id = d.image_id) as removed from detections d group by image_id""")
def nms_report(t):
    d = t.detections()
    return N.nms_report(d, N.nms(d, ["image_id"], 0.4), ["image_id"])


@query("nms_tile_merge", "detections", duck_greedy("detections", "score desc, det_id", _IOU + " > 0.3"))
def nms_tile_merge(t):
    return N.nms(t.detections(), ["image_id"], 0.3, strict=True).select("image_id", "det_id")


@query("nms_keyword_order", "detections", duck_greedy("detections", "prompt, det_id", _IOU + " > 0.5"))
def nms_keyword_order(t):
    return N.nms(t.detections().withColumn("_k", F.substring("prompt", 2, 9).cast("int")), ["image_id"], 0.5,
                 order=[("_k", "asc")], strict=True).select("image_id", "det_id")


@query("nms_across_prompts", "detections", f"""
, one as (select image_id, prompt, unnest(kept) as r from (select image_id, prompt, list_reduce(rows, lambda acc, nx:
   case when len(list_filter(acc, lambda k: {_IOU.replace('d.', 'nx[1].')} >= 0.5)) > 0 then acc else list_concat(acc, nx) end) as kept
  from (select image_id, prompt, list([{{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}}] order by score desc, det_id) as rows
   from detections group by image_id, prompt))),
 u as (select image_id, r.det_id as det_id, r.x1 as x1, r.y1 as y1, r.x2 as x2, r.y2 as y2, r.score as score from one)
""" + duck_greedy("u", "score desc, det_id", _IOU + " >= 0.4"))
def nms_across_prompts(t):
    d = t.detections()
    single = N.nms(d, ["image_id", "prompt"], 0.5)
    return N.nms(single, ["image_id"], 0.4, sizes=d).select("image_id", "det_id")


_MASK_CELLS = """
, area as (select image_id, det_id, sum(ye - ys)::bigint as area from mask_runs group by image_id, det_id),
 inter as (select a.image_id, a.det_id as a, b.det_id as b, sum(least(a.ye, b.ye) - greatest(a.ys, b.ys))::bigint as inter
  from mask_runs a join mask_runs b on a.image_id = b.image_id and a.x = b.x and a.ys < b.ye and b.ys < a.ye and a.det_id <> b.det_id group by 1, 2, 3),
 foe as (select i.image_id, i.a as det_id, list(i.b) as foes from inter i join area p on p.image_id = i.image_id and p.det_id = i.a
  join area q on q.image_id = i.image_id and q.det_id = i.b where i.inter / (p.area + q.area - i.inter)::double {cmp} group by 1, 2)
"""


def duck_mask_greedy(src: str, order: str) -> str:
    return f"""
select image_id, unnest(kept).d as det_id from (select image_id, list_reduce(rows, lambda acc, nx:
  case when len(list_filter(acc, lambda k: list_contains(nx[1].f, k.d))) > 0 then acc else list_concat(acc, nx) end) as kept
 from (select d.image_id, list([{{'d': d.det_id, 'f': coalesce(foe.foes, [])}}] order by {order}) as rows
  from {src} d left join foe on foe.image_id = d.image_id and foe.det_id = d.det_id group by d.image_id))"""


@query("nms_mask_scale", "detections mask_runs", _MASK_CELLS.format(cmp=">= 0.5") + duck_mask_greedy("detections", "d.score desc, d.scale, d.det_id"))
def nms_mask_scale(t):
    return N.mask_nms(t.detections(), t.mask_runs(), ["image_id"], 0.5,
                      order=[("score", "desc"), ("scale", "asc")]).select("image_id", "det_id")


@query("nms_mask_detector", "detections mask_runs", ", d2 as (select * from detections where score > 0.5)" + _MASK_CELLS.format(cmp="> 0.5")
       + duck_mask_greedy("d2", "d.score desc, d.det_id"))
def nms_mask_detector(t):
    d = t.detections().where("score > 0.5")
    return N.mask_nms(d, t.mask_runs(), ["image_id"], 0.5, strict=True, box_fallback=False).select("image_id", "det_id")


_CLUSTER = """
, c as (select d.image_id, det_id, x1, y1, x2, y2, sqrt(mx * mx + my * my) as diag from detections d join
  (select image_id, max(x2) as mx, max(y2) as my from detections group by image_id) m using (image_id)),
 lead as (select image_id, list_reduce(rows, lambda acc, nx: case when len(list_filter(acc, lambda k:
   sqrt((k.px - nx[1].px) * (k.px - nx[1].px) + (k.py - nx[1].py) * (k.py - nx[1].py)) / nx[1].diag < 0.15)) > 0 then acc else list_concat(acc, nx) end) as leads
  from (select image_id, list([{'det_id': det_id, 'px': (x1 + x2) / 2, 'py': (y1 + y2) / 2, 'diag': diag}] order by det_id) as rows from c group by image_id)),
 lf as (select image_id, unnest(leads) as l from lead),
 cl as (select c.image_id, c.det_id, min(l.det_id) as leader, any_value(x1) as x1, any_value(y1) as y1, any_value(x2) as x2, any_value(y2) as y2
  from c join lf on c.image_id = lf.image_id and (l.det_id = c.det_id or
   sqrt((l.px - (x1 + x2) / 2) * (l.px - (x1 + x2) / 2) + (l.py - (y1 + y2) / 2) * (l.py - (y1 + y2) / 2)) / diag < 0.15)
  group by c.image_id, c.det_id)
"""


@query("leader_clusters", "detections", _CLUSTER + "select image_id, det_id, leader from cl")
def leader_clusters(t):
    return N.leader_cluster(t.detections().select("image_id", "det_id", *B.BOX), ["image_id"]).select("image_id", "det_id", "leader")


@query("cluster_extents", "detections", _CLUSTER + """
select image_id, leader, count(*) as members, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from cl group by image_id, leader""")
def cluster_extents(t):
    return N.cluster_extent(N.leader_cluster(t.detections().select("image_id", "det_id", *B.BOX), ["image_id"]), ["image_id"])


# some boxes come relative to the image, some with inverted corners, some beyond the border
_BENT = """case det_id % 4 when 1 then x1 / 2000.0 when 2 then x2 when 3 then x1 - 150 else x1 end as x1, case det_id % 4 when 1 then y1 / 2000.0 else y1 end as y1,
 case det_id % 4 when 1 then x2 / 2000.0 when 2 then x1 when 3 then x2 + 150 else x2 end as x2, case det_id % 4 when 1 then y2 / 2000.0 when 3 then y2 + 900 else y2 end as y2"""


@query("repaired_extents", "detections images", f"""
, b as (select image_id, (det_id % 7)::bigint as leader, {_BENT} from detections),
 s as (select b.image_id, leader, w, h, case when least(x1, y1, x2, y2) >= 0 and greatest(x1, y1, x2, y2) <= 1 then w else 1 end as fw,
  case when least(x1, y1, x2, y2) >= 0 and greatest(x1, y1, x2, y2) <= 1 then h else 1 end as fh, x1, y1, x2, y2 from b join images i on i.image_id = b.image_id)
select image_id, leader, count(*) as members, min(greatest(0.0::double, least(least(x1 * fw, x2 * fw), w - 1))) as x1, min(greatest(0.0::double, least(least(y1 * fh, y2 * fh), h - 1))) as y1,
 max(greatest(0.0::double, least(greatest(x1 * fw, x2 * fw), w))) as x2, max(greatest(0.0::double, least(greatest(y1 * fh, y2 * fh), h))) as y2 from s group by 1, 2""")
def repaired_extents(t):
    bent = t.detections().selectExpr("image_id", "det_id % 7 as leader", *[e.strip() for e in re.split(r",(?=\s*case)", _BENT)])
    return N.cluster_extent(bent, ["image_id"], t.images())


@query("prompt_summaries", "detections", """
select image_id, prompt, count(*) as found, count(*) filter (where score >= 0.9) as strong, count(*) filter (where score >= 0.9) = 0 as failed
 from detections group by image_id, prompt""")
def prompt_summaries(t):
    from visiontables.operators.measure import prompt_summary

    return prompt_summary(t.detections(), ["image_id"], F.col("score") >= 0.9)
