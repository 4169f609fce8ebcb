"""Queries on whole workflows with small stand-in models.

The stand-ins compute boxes and replies from the rows they are given, so that
results can be restated in SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visiontables.catalog.overlaps import duck_iou
from visiontables.catalog.registry import query
from visiontables.operators.runs import encode_texts
from visiontables.plans import hooks as H
from visiontables.plans import images as PI
from visiontables.plans import videos as PV
from visiontables.streaming.lifecycle import TrackerConfig, bidirectional


def two_boxes(tiles: pd.DataFrame) -> pd.DataFrame:
    """Two boxes per tile, placed by the tile's numbers; the first fills its
    box with a mask as far as the tile goes."""
    n = len(tiles)
    i = np.repeat([0, 1], n)
    twice = {c: np.tile(tiles[c].to_numpy(), 2) for c in tiles.columns}
    w, h = twice.pop("tx1") - twice.pop("tx0"), twice.pop("ty1") - twice.pop("ty0")
    im, ti = twice["image_id"], twice["tile_id"]
    x1, y1 = ((im * 7 + ti * 13 + i * 60) % 100).astype(float), ((im * 11 + i * 40) % 90).astype(float)
    x2, y2 = x1 + 60.0 + im % 40, y1 + 50.0 + ti % 30
    counts = np.full(2 * n, None, object)
    counts[:n] = _filled(*[v[:n].astype(np.int64) for v in (w, h, x1, y1, x2, y2)])
    found = {"local_id": i, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "score": ((im * 31 + ti * 17 + i * 29) % 100) / 100.0, "counts": counts}
    return pd.DataFrame(twice | found)


def _filled(w: np.ndarray, h: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """The mask texts of rectangles in tiles; none if nothing of one is inside."""
    texts = np.full(len(w), None, object)
    x2, y2 = np.minimum(x2, w), np.minimum(y2, h)
    use = (x1 < x2) & (y1 < y2)
    w, h, x1, y1, x2, y2 = (v[use] for v in (w, h, x1, y1, x2, y2))
    whole = y2 - y1 == h
    # a background length, then foreground and background in turn, one of either less at the end
    size = np.where(whole, 2, 2 * (x2 - x1))
    rest = w * h - np.where(whole, x2 * h, (x2 - 1) * h + y2)
    size = size + (rest > 0)
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    tall = y2 - y1
    values = np.where((np.arange(len(row)) - first[row]) % 2 == 1, np.where(whole, (x2 - x1) * h, tall)[row], (h - tall)[row])
    values[first] = np.where(whole, x1 * h, x1 * h + y1)
    values[(first + size - 1)[rest > 0]] = rest[rest > 0]
    texts[use] = encode_texts(values, size)
    return texts


def says_yes(rows: pd.DataFrame) -> pd.Series:
    return pd.Series(["yes" if v % 3 else "No." for v in rows["det_id"] + rows["image_id"]], index=rows.index)


def _overlap(a: str, b: str) -> str:
    """Overlap of masks (rectangles here), of boxes where one has no mask."""
    masks = duck_iou(a, b)
    for box, mask in (("x1", "u1"), ("y1", "v1"), ("x2", "u2"), ("y2", "v2")):
        masks = masks.replace("." + box, "." + mask)
    return f"(case when {a}.m and {b}.m then {masks} else {duck_iou(a, b)} end)"


def _greedy(src: str, order: str, meets: str, key: str) -> str:
    row = "{" + ", ".join(f"'{c}': {c}" for c in ("det_id", "x1", "y1", "x2", "y2", "m", "u1", "v1", "u2", "v2")) + "}"
    return f"""
select {key}, unnest(kept).det_id as det_id from (select {key}, list_reduce(rows, lambda acc, nx:
  case when len(list_filter(acc, lambda k: {_overlap('k', 'nx[1]')} {meets})) > 0 then acc else list_concat(acc, nx) end) as kept
 from (select {key}, list([{row}] order by {order}) as rows from {src} group by {key}))"""


def _found(*asked: str) -> str:
    """``kd``: what inference keeps for each of the words asked for (none: without words)."""
    words = ", ".join(f"({k}, '{w}')" for k, w in enumerate(asked)) or "(0, '')"
    name = "concat_ws('|', lev, t, i" + (", no, ask" if asked else "") + ")"
    return f"""
, lv as (select image_id, scale, lev, w as ow, h as oh, cast(floor(w * scale) as bigint) as w, cast(floor(h * scale) as bigint) as h from big_images,
  (values (cast(1.0 as double), 1), (cast(0.5 as double), 2)) s(scale, lev)),
 ax as (select *, unnest(range(0, cast(case when w <= 512 then 1 else ceil((w - 512) / 435.0) + 1 end as bigint))) as ix from lv),
 xy as (select *, unnest(range(0, cast(case when h <= 512 then 1 else ceil((h - 512) / 435.0) + 1 end as bigint))) as iy from ax),
 tl as (select *, row_number() over (partition by image_id, scale order by iy, ix) - 1 as t, greatest(0, least(ix * 435, w - 512)) as ox, greatest(0, least(iy * 435, h - 512)) as oy from xy),
 bx as (select *, (image_id * 7 + t * 13 + i * 60) % 100 as a, (image_id * 11 + i * 40) % 90 as b, ((image_id * 31 + t * 17 + i * 29) % 100) / 100.0::double as score from tl, (values (0), (1)) k(i)),
 ms as (select *, i = 0 and a < least(512, w) and b < least(512, h) as m, least(a + 60 + image_id % 40, least(512, w)) as c, least(b + 50 + t % 30, least(512, h)) as d,
  cast(concat('0x', substr(md5({name}), 1, 15)) as bigint) as det_id from bx, (values {words}) q(no, ask)),
 pl as (select image_id, scale, no, ask, det_id, score, m, ceil((a + ox) * ow / w::double)::bigint as u1, ceil((b + oy) * oh / h::double)::bigint as v1, ceil((c + ox) * ow / w::double)::bigint as u2, ceil((d + oy) * oh / h::double)::bigint as v2,
  greatest(0.0, least((a + ox) / scale, ow::double)) as x1, greatest(0.0, least((b + oy) / scale, oh::double)) as y1,
  greatest(0.0, least((a + 60 + image_id % 40 + ox) / scale, ow::double)) as x2, greatest(0.0, least((b + 50 + t % 30 + oy) / scale, oh::double)) as y2 from ms),
 fd as (select * from pl where score >= 0.3 and x2 > x1 and y2 > y1),
 kp as ({_greedy("fd", "score desc, scale, det_id", ">= 0.5", "image_id, no")}),
 kd as (select fd.* from fd join kp on kp.image_id = fd.image_id and kp.no = fd.no and kp.det_id = fd.det_id)
"""


@query("inferred_boxes", "big_images", _found() + "select image_id, det_id, score, x1, y1, x2, y2 from kd")
def inferred_boxes(t):
    return PI.infer(t.big_images(), two_boxes, 0.3)[0].select("image_id", "det_id", "score", "x1", "y1", "x2", "y2")


@query("inferred_masks", "big_images", _found() + "select image_id, det_id, u2 - u1 as columns, (u2 - u1) * (v2 - v1) as area from kd where m")
def inferred_masks(t):
    runs = PI.infer(t.big_images(), two_boxes, 0.3)[1]
    return runs.groupBy("image_id", "det_id").agg(F.count(F.lit(1)).alias("columns"), F.sum(F.col("ye") - F.col("ys")).alias("area"))


@query("counted_objects", "big_images", _found() + """
select b.image_id, count(det_id) as raw, count(det_id) filter (where (det_id + b.image_id) % 3 <> 0) as verified, count(det_id) filter (where (det_id + b.image_id) % 3 = 0) as rejected
 from big_images b left join kd on kd.image_id = b.image_id group by 1""")
def counted_objects(t):
    _, totals = PI.count_objects(t.big_images(), two_boxes, says_yes, threshold=0.3)
    return totals.select("image_id", "raw", "verified", "rejected")


def _with_gsd(t, field, values):
    return t.big_images().withColumns({"gsd": F.when(F.col("image_id") % 50 > 0, 0.5), field: F.array(*[F.lit(v) for v in values])})


_AREAS = """
, ob as (select image_id, case when m then (u2 - u1) * (v2 - v1) else trunc((x2 - x1) * (y2 - y1))::bigint end as px from kd where no = 0)
select b.image_id, count(px) as objects, coalesce(sum(px), 0)::bigint as pixel_area, round(coalesce(sum(px), 0)::bigint * 0.25::double, 4) as real_area,
 round(coalesce(sum(px), 0)::bigint / any_value(w * h) * 100, 4) as coverage from big_images b left join (select * from ob where px > 0) o on o.image_id = b.image_id where b.image_id % 50 > 0 group by 1"""


@query("measured_areas", "big_images", _found("tank") + _AREAS)
def measured_areas(t):
    return PI.measure_areas(_with_gsd(t, "keywords", ["tank"]), two_boxes, threshold=0.3)[1]


# the stand-in finds the same objects under every keyword, so later keywords add nothing
@query("areas_over_keywords", "big_images", _found("tank") + _AREAS)
def areas_over_keywords(t):
    return PI.measure_areas(_with_gsd(t, "keywords", ["tank", "ship", "tank"]), two_boxes, threshold=0.3)[1]


@query("images_without_resolution", "big_images", "select image_id from big_images where image_id % 50 = 0")
def images_without_resolution(t):
    from visiontables.operators.measure import gsd_errors

    return gsd_errors(_with_gsd(t, "keywords", ["tank"]))


def accepts(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([f"<verdict>{'Accept' if v % 4 else 'Reject'}</verdict>" for v in rows["det_id"]], index=rows.index)


@query("segmented_documents", "big_images", _found("tank", "ship") + f"""
, k2 as ({_greedy("kd", "score desc, det_id", ">= 0.4", "image_id")}),
 s as (select kd.*, b.w from kd join k2 on k2.image_id = kd.image_id and k2.det_id = kd.det_id join big_images b on b.image_id = kd.image_id where score >= 0.4 and kd.det_id % 4 <> 0)
select b.image_id, count(det_id)::integer as n, max(score) as best, list(x2 / s.w order by score desc, det_id) filter (where det_id is not null)[1] as first_x2, count(det_id) filter (where m)::integer as masks
 from big_images b left join s on s.image_id = b.image_id group by 1""")
def segmented_documents(t):
    docs = PI.segment(_with_gsd(t, "prompts", ["tank", "ship"]), two_boxes, threshold=0.3, min_score=0.4, verdict=accepts)
    return docs.select("image_id", F.size("pred_scores").alias("n"), F.get("pred_scores", F.lit(0)).alias("best"), F.get(F.get("pred_boxes", F.lit(0)), F.lit(2)).alias("first_x2"),
                       F.size(F.filter("pred_masks", lambda m: m.isNotNull())).alias("masks"))


@query("areas_from_replies", "big_images", _found("tank") + _AREAS.replace("from kd where no = 0", "from kd where no = 0 and (det_id + image_id) % 3 <> 0"))
def areas_from_replies(t):
    reply = F.when(F.col("image_id") % 2 == 0, F.lit('Here: {"primary_object": "tank", "keywords": ["tank", "ship"], "reasoning": "x"}')).otherwise(F.lit("no idea"))
    asked = PI.with_keywords(_with_gsd(t, "unused", []).withColumns({"reply": reply, "query": F.lit("tank")})).drop("unused", "reply", "query")
    return PI.measure_areas(asked, two_boxes, verifier=says_yes, threshold=0.3)[1]


@query("count_answers", "big_images", _found("army tanks").replace(", no, ask)", ", ask)") + """
select image_id, det_id, 'tank' as object_type, case when ok then greatest(u2 - u1, v2 - v1)::double - 1 end as bw, case when ok then least(u2 - u1, v2 - v1)::double - 1 end as bh
 from (select *, m and (u2 - u1) * (v2 - v1) >= 10 and least(u2 - u1, v2 - v1) - 1 >= 5 as ok from kd) where (det_id + image_id) % 3 <> 0""")
def count_answers(t):
    objects, _, _ = PI.count_answer(t.big_images().withColumn("prompt", F.lit("army tanks")), two_boxes, says_yes, threshold=0.3)
    return objects.select("image_id", "det_id", "object_type", F.round("bw", 6).alias("bw"), F.round("bh", 6).alias("bh"))


def rates(rows: pd.DataFrame) -> str:
    word = lambda p: ("HIGH", "MEDIUM", "LOW")[int(p) % 3]
    return "\n".join(f"Mask {p}: {word(p)}" for p in rows["pos"])


def rates_again(rows: pd.DataFrame) -> str:
    return "\n".join(f"Mask {p}: high" for p in rows["pos"] if p % 2)


@query("confident_documents", "big_images", _found("tank", "ship") + f"""
, k2 as ({_greedy("kd", "score desc, det_id", ">= 0.4", "image_id")}),
 s as (select kd.*, w, h, case when m then (u2 - u1) * (v2 - v1) else (x2 - x1) * (y2 - y1) end as area from kd join k2 on k2.image_id = kd.image_id and k2.det_id = kd.det_id join big_images b on b.image_id = kd.image_id),
 f as (select * from s where area / (w * h) >= 0.002 and area / (w * h) <= 0.2 and (x2 - x1) / (y2 - y1) between 0.5 and 2),
 n as (select *, row_number() over (partition by image_id order by det_id) as pos from f), d as (select *, count(*) filter (where pos % 3 <> 0) over (partition by image_id) as doubt from n),
 c as (select * from d where pos % 3 <> 2 or (doubt > 1 and pos % 2 = 1))
select b.image_id, count(det_id)::integer as n, max(score) as best from big_images b left join c on c.image_id = b.image_id group by 1""")
def confident_documents(t):
    docs = PI.segment(_with_gsd(t, "prompts", ["tank", "ship"]), two_boxes, threshold=0.3, attributes={"min_size": 0.002, "max_size": 0.2, "aspect": (0.5, 2.0)},
                      assess=(rates, rates_again, 1))
    return docs.select("image_id", F.size("pred_scores").alias("n"), F.get("pred_scores", F.lit(0)).alias("best"))


@query("assessed_confidences", "detections", """
select image_id, row_number() over (partition by image_id order by det_id) as pos,
 case (row_number() over (partition by image_id order by det_id)) % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence from detections""")
def assessed_confidences(t):
    from visiontables.operators.numbering import position_in_order

    rows = position_in_order(t.detections().select("image_id", "det_id"), ["image_id"], [F.asc("det_id")], "pos").select("image_id", "pos")
    return H.assess_confidence(rows, rates, ["image_id"])


@query("smart_confidences", "detections", """
, n as (select image_id, det_id, row_number() over (partition by image_id order by det_id) as pos, count(*) over (partition by image_id) as c from detections),
 d as (select *, count(*) filter (where pos % 3 <> 0) over (partition by image_id) as doubt from n)
select image_id, det_id, case when doubt > 10 and pos % 3 <> 0 and pos % 2 = 1 then 'HIGH' when pos % 3 = 0 then 'HIGH' when pos % 3 = 1 then 'MEDIUM' else 'LOW' end as confidence from d""")
def smart_confidences(t):
    return H.smart_confidence(t.detections(), rates, rates_again, ["image_id"], limit=10).select("image_id", "det_id", "confidence")


@query("retried_keys", "images", """
, a as (select image_id, unnest(range(1, 4)) as attempt from images), v as (select *, (image_id + attempt * attempt) % 4 = 0 as verified from a)
select image_id, cast(attempt as integer) as attempt, verified from v where not exists (select 1 from v u where u.image_id = v.image_id and u.attempt < v.attempt and u.verified)""")
def retried_keys(t):
    work = t.images().select("image_id", F.lit("tanks").alias("prompt"))
    attempt = lambda todo, n: todo.select("image_id", ((F.col("image_id") + (n + 1) * (n + 1)) % 4 == 0).alias("verified"))
    out = H.retry_unresolved(work, attempt, lambda p, n: F.concat(p, F.lit("s")), ["image_id"])
    return out.select("image_id", "attempt", "verified")


@query("tile_function", "big_images", """
, ax as (select image_id, w, h, unnest(range(0, cast(case when w <= 512 then 1 else ceil((w - 512) / 435.0) + 1 end as bigint))) as ix from big_images),
 xy as (select *, unnest(range(0, cast(case when h <= 512 then 1 else ceil((h - 512) / 435.0) + 1 end as bigint))) as iy from ax)
select image_id, row_number() over (partition by image_id order by iy, ix) - 1 as tile_id, greatest(0, least(ix * 435, w - 512)) as x0, greatest(0, least(iy * 435, h - 512)) as y0 from xy""")
def tile_function(t):
    H.register_tile_function(t.spark)
    t.big_images().createOrReplaceTempView("tile_function_images")
    return t.spark.sql("select image_id, tile_id, x0, y0 from tile_function_images, lateral tile_grid(w, h, 512, 0.15)")


@query("prompt_features", "detections", "select image_id, det_id, length(prompt)::integer + 1 as width from detections")
def prompt_features(t):
    def features(s: pd.Series) -> pd.Series:
        return s.map(lambda p: [float(len(p))] * (len(p) + 1))

    d = H.with_prompt_features(t.detections(), features)
    return d.select("image_id", "det_id", F.size("prompt_features").alias("width"))


# ---- videos ------------------------------------------------------------------------------

_CONFIG = TrackerConfig(delay=6, unmatched=4, confirm=2)


@query("tracked_objects")
def tracked_objects(t):
    v = t.track_obs().select("video_id").distinct().selectExpr("video_id", "512D as w", "144D as h")
    return PV.track_video(t.track_obs(), v, _CONFIG)


@query("tracked_both_ways")
def tracked_both_ways(t):
    sure = F.min(F.when(F.col("score") > 0.9, F.col("frame_idx")))
    starts = t.track_obs().groupBy("video_id").agg(F.coalesce(sure, F.min("frame_idx")).alias("start"))
    return bidirectional(t.track_obs(), starts, _CONFIG)


def _runs(df, rid):
    c = lambda n: F.floor(F.col(n) / 4)
    df = df.where("floor(x2 / 4) > floor(x1 / 4) and floor(y2 / 4) > floor(y1 / 4)")
    return df.select("video_id", "frame_idx", F.col(rid).alias("obj_id"), F.explode(F.sequence(c("x1"), c("x2") - 1)).alias("x"), c("y1").alias("ys"), c("y2").alias("ye"))


_VR = "floor(x1 / 4)::bigint, floor(x2 / 4)::bigint)) as x, floor(y1 / 4)::bigint as ys, floor(y2 / 4)::bigint as ye"


@query("separated_masks", "tracks", f"""
, r as (select video_id, frame_idx, obj_id, tracker_score as s, unnest(range({_VR} from tracks),
 p as (select *, unnest(range(ys, ye)) as y from r),
 b as (select *, row_number() over (partition by video_id, frame_idx, x, y order by s desc, obj_id) as k from p)
select video_id, frame_idx, obj_id, count(*) as area from b where k = 1 group by 1, 2, 3""")
def separated_masks(t):
    s = t.tracks().withColumn("score", F.col("tracker_score"))
    d = PV.separate_masks(_runs(s, "obj_id"), s)
    return d.groupBy("video_id", "frame_idx", "obj_id").agg(F.sum(F.col("ye") - F.col("ys")).alias("area"))


@query("reviewed_annotations", "track_obs tracks", f"""
, tr as (select video_id, frame_idx, obj_id, unnest(range({_VR} from tracks where floor(y2 / 4) > floor(y1 / 4)), pr as (select video_id, frame_idx, det_id, unnest(range({_VR} from track_obs),
 ta as (select video_id, frame_idx, obj_id, sum(ye - ys)::bigint as a from tr group by 1, 2, 3), pa as (select video_id, frame_idx, det_id, sum(ye - ys)::bigint as a from pr group by 1, 2, 3),
 it as (select tr.video_id, tr.frame_idx, tr.obj_id, pr.det_id, sum(least(tr.ye, pr.ye) - greatest(tr.ys, pr.ys))::bigint as i from tr join pr on tr.video_id = pr.video_id and tr.frame_idx = pr.frame_idx
  and tr.x = pr.x and tr.ys < pr.ye and pr.ys < tr.ye group by 1, 2, 3, 4),
 ok as (select it.* from it join ta using (video_id, frame_idx, obj_id) join pa on pa.video_id = it.video_id and pa.frame_idx = it.frame_idx and pa.det_id = it.det_id where i / (ta.a + pa.a - i)::double >= 0.5),
 k as (select distinct video_id, frame_idx from (select video_id, frame_idx from tr union all select video_id, frame_idx from pr))
select video_id, frame_idx, (select count(*) from ta where ta.video_id = k.video_id and ta.frame_idx = k.frame_idx) as truth, (select count(*) from pa where pa.video_id = k.video_id and pa.frame_idx = k.frame_idx) as predicted,
 (select count(distinct obj_id) from ok where ok.video_id = k.video_id and ok.frame_idx = k.frame_idx) as matched, (select count(*) from ta where ta.video_id = k.video_id and ta.frame_idx = k.frame_idx) - (select count(distinct obj_id) from ok where ok.video_id = k.video_id and ok.frame_idx = k.frame_idx) as missed,
 (select count(*) from pa where pa.video_id = k.video_id and pa.frame_idx = k.frame_idx) - (select count(distinct det_id) from ok where ok.video_id = k.video_id and ok.frame_idx = k.frame_idx) as extra from k""")
def reviewed_annotations(t):
    return PV.review_annotations(_runs(t.tracks(), "obj_id"), _runs(t.track_obs(), "det_id"), ["video_id", "frame_idx"])


# micro-batches the observations come in
_STREAM_FILES = 4


@query("streamed_tracks")
def streamed_tracks(t):
    """The lifecycle as a stream over the event file, run to its end."""
    import os
    import uuid

    from visiontables.session import shared_folder
    from visiontables.streaming.lifecycle import frame_stream, track_stream, use_rocksdb

    spark = t.spark
    use_rocksdb(spark)
    folder = os.path.join(shared_folder(spark), f"streamed-tracks-{uuid.uuid4().hex}")
    obs = t.track_obs().withColumn("end_of_video", F.lit(False))
    ends = obs.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("frame_idx")).withColumn("end_of_video", F.lit(True))
    # a video lies in one file: files arrive in any order, and a frame that comes after a later one is late
    obs.repartition(_STREAM_FILES, "video_id").write.parquet(folder + "/in/part=0")
    obs.limit(0).unionByName(ends, allowMissingColumns=True).write.parquet(folder + "/in/part=1")
    rows = frame_stream(spark, folder + "/in", obs.schema, files_per_batch=1)
    q = (track_stream(rows, _CONFIG).writeStream.outputMode("update").option("checkpointLocation", folder + "/state")
         .trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start())
    q.awaitTermination()
    return spark.read.parquet(folder + "/out").where("not late").drop("batch", "late")
