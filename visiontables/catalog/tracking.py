"""Queries on association and per-object histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.catalog.overlaps import duck_iou
from visiontables.catalog.registry import query
from visiontables.functions import boxes as B
from visiontables.operators import tracks as K

_IOU = f"""
, o as (select * from track_obs), t as (select * from tracks),
 pr as (select o.video_id, o.frame_idx, o.det_id, t.obj_id, {duck_iou('o', 't')} as iou from o join t on o.video_id = t.video_id and o.frame_idx = t.frame_idx
  and {duck_iou('o', 't')} >= 0.1)
"""
_OT = "track_obs tracks"


def _pairs(t):
    return K.box_pairs(t.track_obs(), t.tracks(), 0.1)


@query("track_pairs", _OT, _IOU + "select * from pr")
def track_pairs(t):
    return _pairs(t)


_CELLS = """
, {n} as (select video_id, frame_idx, {id}, unnest(range(floor(x1 / 4)::bigint, floor(x2 / 4)::bigint)) as x, floor(y1 / 4)::bigint as ys, floor(y2 / 4)::bigint as ye from {src})
"""


def _box_runs(df, rid):
    """Boxes as filled masks at a quarter of the resolution."""
    c = lambda n: F.floor(F.col(n) / 4)
    df = df.where("floor(x2 / 4) > floor(x1 / 4)")
    return df.select("video_id", "frame_idx", rid, F.explode(F.sequence(c("x1"), c("x2") - 1)).alias("x"), c("y1").alias("ys"), c("y2").alias("ye"))


@query("track_mask_pairs", _OT, _CELLS.format(n="dr", id="det_id", src="track_obs") + _CELLS.format(n="tr", id="obj_id", src="tracks where floor(y2 / 4) > floor(y1 / 4)") + """
, da as (select video_id, frame_idx, det_id, sum(ye - ys)::bigint as a from dr group by 1, 2, 3), ta as (select video_id, frame_idx, obj_id, sum(ye - ys)::bigint as a from tr group by 1, 2, 3),
 it as (select dr.video_id, dr.frame_idx, dr.det_id, tr.obj_id, sum(least(dr.ye, tr.ye) - greatest(dr.ys, tr.ys))::bigint as i from dr join tr
  on dr.video_id = tr.video_id and dr.frame_idx = tr.frame_idx and dr.x = tr.x and dr.ys < tr.ye and tr.ys < dr.ye group by 1, 2, 3, 4)
select it.video_id, it.frame_idx, it.det_id, it.obj_id, i / greatest(da.a + ta.a - i, 1)::double as iou from it join da using (video_id, frame_idx, det_id)
 join ta on ta.video_id = it.video_id and ta.frame_idx = it.frame_idx and ta.obj_id = it.obj_id""")
def track_mask_pairs(t):
    return K.mask_pairs(_box_runs(t.track_obs(), "det_id"), _box_runs(t.tracks(), "obj_id"))


@query("new_detections", _OT, _IOU + """
select video_id, frame_idx, det_id from o where (score >= 0.7 or (video_id, frame_idx) not in (select (video_id, frame_idx) from t))
 and not exists (select 1 from pr where pr.video_id = o.video_id and pr.frame_idx = o.frame_idx and pr.det_id = o.det_id and iou >= 0.6)""")
def new_detections(t):
    return K.new_detections(t.track_obs(), t.tracks(), _pairs(t), threshold=0.6).select("video_id", "frame_idx", "det_id")


@query("unmatched_tracks", _OT, _IOU + """
select video_id, frame_idx, obj_id, false as empty from t where x2 > x1 and y2 > y1 and not exists
 (select 1 from pr where pr.video_id = t.video_id and pr.frame_idx = t.frame_idx and pr.obj_id = t.obj_id and iou >= 0.5)
union all select video_id, frame_idx, obj_id, true from t where not (x2 > x1 and y2 > y1)""")
def unmatched_tracks(t):
    k = ["video_id", "frame_idx", "obj_id"]
    u = K.unmatched_tracks(t.tracks(), _pairs(t)).select(*k, F.lit(False).alias("empty"))
    return u.unionByName(K.empty_tracks(t.tracks()).select(*k, F.lit(True).alias("empty")))


_CONF = _IOU + """
, bt as (select video_id, frame_idx, det_id, obj_id, iou from (select *, row_number() over (partition by video_id, frame_idx, det_id order by iou desc, obj_id) as k from pr) where k = 1 and iou >= 0.6),
 cf as (select * from (select b.*, o.score, row_number() over (partition by b.video_id, b.frame_idx, b.obj_id order by b.det_id desc) as k from bt b join o
   on o.video_id = b.video_id and o.frame_idx = b.frame_idx and o.det_id = b.det_id where o.score >= 0.8) where k = 1)
"""


def _confident(t):
    return K.confident_matches(t.track_obs(), _pairs(t), 0.8, 0.6)


@query("confident_matches", _OT, _CONF + "select video_id, frame_idx, obj_id, det_id, score, iou from cf")
def confident_matches(t):
    return _confident(t)


@query("recondition_candidates", _OT, _CONF + f"""
, j as (select c.*, {duck_iou('o', 't')} as d from cf c join o on o.video_id = c.video_id and o.frame_idx = c.frame_idx and o.det_id = c.det_id
  join t on t.video_id = c.video_id and t.frame_idx = c.frame_idx and t.obj_id = c.obj_id where t.x2 > t.x1 and t.y2 > t.y1),
 f as (select video_id, frame_idx, obj_id, det_id, d < 0.7 and score >= 0.85 as drifted, frame_idx % 16 = 0 as periodic from j)
select * from f where drifted or periodic""")
def recondition_candidates(t):
    return K.recondition_candidates(_confident(t), t.track_obs(), t.tracks(), 0.7, 0.85, 16)


# ---- lookups in time -----------------------------------------------------------------------

def _keyframes(t):
    return t.track_obs().where("score > 0.9").select("video_id", "frame_idx").distinct()


_NEAR = """
, k as (select distinct video_id, frame_idx as kf from track_obs where score > 0.9), q as (select distinct video_id, frame_idx from track_obs),
 j as (select q.video_id, q.frame_idx, kf, max(case when kf < frame_idx then kf end) over w as bf, min(case when kf >= frame_idx then kf end) over w as af,
   min(kf) over w as fi, max(kf) over w as la from q join k using (video_id) window w as (partition by q.video_id, q.frame_idx)),
 c as (select *, case when {first} then 0 when kf = bf then 1 when kf = af then 2 else 3 end as cl from j),
 r as (select *, row_number() over (partition by video_id, frame_idx order by cl, abs(kf - frame_idx), kf) as n from c)
select video_id, frame_idx, kf as key_frame from r where n <= {k} or cl < 3"""


@query("nearest_keyframes", "track_obs", _NEAR.format(first="false", k=4))
def nearest_keyframes(t):
    return K.nearest_keyframes(t.track_obs(), _keyframes(t), 4, span=32)


@query("nearest_keyframes_first", "track_obs", _NEAR.format(first="(bf is not null and kf = fi) or (bf is null and kf = la and la > frame_idx)", k=5))
def nearest_keyframes_first(t):
    return K.nearest_keyframes(t.track_obs(), _keyframes(t), 5, keep_first=True, span=32)


@query("recent_good_frames", "track_obs", """
, s as (select video_id, frame_idx, max(score) as score from track_obs group by 1, 2),
 c as (select a.video_id, a.frame_idx, b.frame_idx as m, row_number() over (partition by a.video_id, a.frame_idx order by b.frame_idx desc) as n
  from s a join s b on a.video_id = b.video_id and b.frame_idx < a.frame_idx and b.frame_idx > 0 and (a.frame_idx - 1 - b.frame_idx) % 3 = 0 and b.score > 0.8)
select video_id, frame_idx, m as memory_frame from c where n <= 5 union select video_id, frame_idx, frame_idx - 1 from s where frame_idx > 0""")
def recent_good_frames(t):
    s = t.track_obs().groupBy("video_id", "frame_idx").agg(F.max("score").alias("score"))
    return K.recent_good_frames(s, s, 3, 6, 0.8, span=32)


@query("frame_annotations", "", """
with a as (select doc_id as video_id, lang as noun_phrase, unnest(string_split(text, chr(10))) as seg, generate_subscripts(string_split(text, chr(10)), 1) - 1 as frame_idx from documents),
 v as (select doc_id as video_id, unnest(range(0, 3 + quality * 4)) as frame_idx from (select distinct on (doc_id) doc_id, quality from labels order by doc_id, quality))
select a.video_id, noun_phrase, cast(a.frame_idx as integer) as frame_idx, a.video_id || '/' || a.frame_idx || '.jpg' as file_name, case when length(seg) < 20 then '' else seg end as segmentation
 from a join v on a.video_id = v.video_id and a.frame_idx = v.frame_idx""")
def frame_annotations(t):
    a = t.raw("documents").select(F.col("doc_id").alias("video_id"), F.col("lang").alias("noun_phrase"),
                                  F.transform(F.split("text", "\n", -1), lambda s: F.when(F.length(s) >= 20, s)).alias("segmentations"))
    v = t.raw("labels").groupBy(F.col("doc_id").alias("video_id")).agg(F.min("quality").alias("q"))
    names = F.transform(F.sequence(F.lit(0), F.col("q") * 4 + 2), lambda i: F.concat(F.col("video_id").cast("string"), F.lit("/"), i.cast("string"), F.lit(".jpg")))
    out = K.frame_annotations(a, v.select("video_id", names.alias("file_names")))
    return out.select("video_id", "noun_phrase", "frame_idx", "file_name", "segmentation")


@query("video_reference_errors", "", """
with n as (select doc_id, count(*) as listed from labels group by 1)
select d.doc_id as video_id, coalesce(listed, 0) as listed from documents d left join n using (doc_id) where coalesce(listed, 0) <> 1""")
def video_reference_errors(t):
    as_video = lambda name: t.raw(name).select(F.col("doc_id").alias("video_id"))
    return K.video_reference_errors(as_video("documents"), as_video("labels"))


# ---- output shaping ---------------------------------------------------------------------------

def _frames(t):
    return t.track_obs().groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))


@query("dense_tracks", _OT, """
, f as (select video_id, max(frame_idx) + 1 as n from track_obs group by 1),
 g as (select video_id, obj_id, unnest(range(0, n)) as frame_idx from (select distinct video_id, obj_id from tracks) join f using (video_id))
select g.video_id, g.obj_id, g.frame_idx, coalesce(x1, 0.0::double) as x1, coalesce(x2, 0.0::double) as x2, coalesce(tracker_score, -1.0::double) as tracker_score
 from g left join tracks t on t.video_id = g.video_id and t.obj_id = g.obj_id and t.frame_idx = g.frame_idx""")
def dense_tracks(t):
    rows = t.tracks().select("video_id", "obj_id", "frame_idx", "x1", "x2", "tracker_score")
    return K.densify_tracks(rows, _frames(t), {"x1": 0.0, "x2": 0.0, "tracker_score": -1.0})


@query("hidden_objects", "tracks", """
select video_id, frame_idx, obj_id from tracks t where not exists (select 1 from tracks r where r.video_id = t.video_id and r.obj_id = t.obj_id and r.tracker_score > 0.995)
 and tracker_score >= 0.2 and not (frame_idx < 3 and obj_id = 2)""")
def hidden_objects(t):
    tr = t.tracks()
    return K.hide_objects(tr, tr.where("tracker_score > 0.995"), tr.where("tracker_score < 0.2"), tr.where("frame_idx < 3 and obj_id = 2")).select("video_id", "frame_idx", "obj_id")


@query("overridden_masks", _OT, """
, r as (select video_id, frame_idx, slot + 2 as obj_id, x1, y1 from track_obs where score > 0.6)
select coalesce(t.video_id, r.video_id) as video_id, coalesce(t.frame_idx, r.frame_idx) as frame_idx, coalesce(t.obj_id, r.obj_id) as obj_id,
 coalesce(r.x1, t.x1) as x1, coalesce(r.y1, t.y1) as y1 from tracks t full join r on r.video_id = t.video_id and r.frame_idx = t.frame_idx and r.obj_id = t.obj_id""")
def overridden_masks(t):
    r = t.track_obs().where("score > 0.6").withColumn("obj_id", F.col("slot") + 2)
    return K.override_masks(t.tracks(), r, ["video_id", "frame_idx", "obj_id"], ["x1", "y1"])


@query("object_removed", "tracks", "select video_id, frame_idx, obj_id from tracks where not ((video_id % 3 = 0 and obj_id = 1) or (video_id % 2 = 0 and obj_id = 4))")
def object_removed(t):
    gone = t.tracks().where("(video_id % 3 = 0 and obj_id = 1) or (video_id % 2 = 0 and obj_id = 4)").select("video_id", "obj_id").distinct()
    return K.remove_object(t.tracks(), gone).select("video_id", "frame_idx", "obj_id")


@query("merged_confidence", "track_obs", """
select video_id, det_id, case when score > 0.8 then 'HIGH' when score > 0.5 then (case when matched then 'MEDIUM' else 'HIGH' end) else 'LOW' end as confidence from track_obs""")
def merged_confidence(t):
    o = t.track_obs()
    first = o.where("score > 0.5").select("video_id", "det_id", F.when(F.col("matched"), "MEDIUM").otherwise("HIGH").alias("confidence"))
    again = o.where("score > 0.8").select("video_id", "det_id", F.lit("HIGH").alias("confidence"))
    return K.merge_confidence(o, first, again, ["video_id", "det_id"]).select("video_id", "det_id", "confidence")


# ---- histories -----------------------------------------------------------------------------------

def _history(t):
    return t.track_obs().select("video_id", (F.col("slot") + 1).alias("obj_id"), "frame_idx", "matched")


_HIST = ", h as (select video_id, slot + 1 as obj_id, frame_idx, matched from track_obs)"
_STREAK = _HIST + """
, i as (select *, sum(case when matched then 0 else 1 end) over (partition by video_id, obj_id order by frame_idx) as isl from h),
 s as (select *, count(*) filter (where matched) over (partition by video_id, obj_id, isl order by frame_idx) as streak from i),
 st as (select *, case when max(streak) over (partition by video_id, obj_id order by frame_idx) >= 3 then 2 else 1 end as status from s)
"""


@query("confirmation_streaks", "track_obs", _STREAK + "select video_id, obj_id, frame_idx, matched, streak, cast(status as integer) as status from st")
def confirmation_streaks(t):
    return K.confirmation_streak(_history(t), 3, span=32)


@query("unconfirmed_ahead", "track_obs", _STREAK + """
, f as (select distinct video_id, frame_idx, max(frame_idx) over (partition by video_id) as la from h)
select f.video_id, f.frame_idx, st.obj_id from f join st on st.video_id = f.video_id and st.frame_idx = least(f.frame_idx + 2, la) where status = 1""")
def unconfirmed_ahead(t):
    return K.confirmed_lookahead(K.confirmation_streak(_history(t), 3, span=32), _frames(t), 3)


@query("unconfirmed_behind", "track_obs", _STREAK + """
, f as (select distinct video_id, frame_idx from h)
select f.video_id, f.frame_idx, st.obj_id from f join st on st.video_id = f.video_id and st.frame_idx = greatest(f.frame_idx - 2, 0) where status = 1""")
def unconfirmed_behind(t):
    return K.confirmed_lookahead(K.confirmation_streak(_history(t), 3), _frames(t), 3, reverse=True)


@query("first_seen", "tracks", "select video_id, obj_id, min(frame_idx) as first_frame from tracks group by 1, 2")
def first_seen(t):
    return K.first_seen(t.tracks())


# several slots share a detection when their ids agree
_MATCH = ", m as (select video_id, frame_idx, det_id // 2 as det_id, slot + 1 as obj_id from track_obs where matched), f as (select video_id, obj_id, min(frame_idx) as ff from m group by 1, 2)"


def _matched(t):
    return t.track_obs().where("matched").select("video_id", "frame_idx", F.floor(F.col("det_id") / 2).alias("det_id"), (F.col("slot") + 1).alias("obj_id"))


@query("earliest_matches", "track_obs", _MATCH + """
select m.video_id, m.frame_idx, m.det_id, min_by(m.obj_id, ff * 1000 + m.obj_id) as first_obj, count(*) as objects from m join f using (video_id, obj_id) group by 1, 2, 3""")
def earliest_matches(t):
    m = _matched(t)
    return K.earliest_match(m, K.first_seen(m))


@query("unmatched_removals", "track_obs", _HIST + """
, c as (select *, sum(case when matched then 0 else 1 end) over (partition by video_id, obj_id order by frame_idx) as n from h),
 r as (select video_id, obj_id, min(frame_idx) as removed_at from c where n >= 2 group by 1, 2), f as (select video_id, obj_id, min(frame_idx) as ff from h group by 1, 2)
select video_id, obj_id, removed_at from r join f using (video_id, obj_id) where ff > removed_at - 15""")
def unmatched_removals(t):
    h = _history(t)
    return K.unmatched_removals(h, K.first_seen(h), 2, 15, span=32)


_DUP = _MATCH + """
, e as (select m.video_id, m.frame_idx, m.det_id, min_by(m.obj_id, ff * 1000 + m.obj_id) as lead, count(*) as n from m join f using (video_id, obj_id) group by 1, 2, 3),
 p as (select m.video_id, m.obj_id, e.lead as first_obj, m.frame_idx, count(*) as c from m join e on e.video_id = m.video_id and e.frame_idx = m.frame_idx and e.det_id = m.det_id
  where e.n > 1 and m.obj_id <> e.lead group by 1, 2, 3, 4)
"""


@query("duplicate_pairs", "track_obs", _DUP + "select video_id, obj_id, first_obj, sum(c)::bigint as shared from p group by 1, 2, 3")
def duplicate_pairs(t):
    m = _matched(t)
    return K.duplicate_pairs(m, K.first_seen(m))


@query("duplicate_removals", "track_obs", _DUP + """
, q as (select *, sum(c) over (partition by video_id, obj_id, first_obj order by frame_idx) as s from p)
select video_id, obj_id, min(frame_idx) as removed_at from q join f using (video_id, obj_id) where s >= 8 and ff > frame_idx - 15 group by 1, 2""")
def duplicate_removals(t):
    m = _matched(t)
    return K.duplicate_removals(m, K.first_seen(m), 8, 15, span=32)


@query("keep_alive", "track_obs", _HIST + """
, a as (select video_id, obj_id, list({'f': frame_idx, 'd': case when matched then 1 else -1 end} order by frame_idx) as s from h group by 1, 2),
 r as (select video_id, obj_id, list_reduce(list_transform(s, lambda v: [v]), lambda acc, v: list_concat(acc,
   [{'f': v[1].f, 'd': greatest(-1, least(6, acc[len(acc)].d + v[1].d))}]), [{'f': -1::bigint, 'd': 4}]) as o from a)
select video_id, obj_id, u.f as frame_idx, u.d::bigint as alive from (select video_id, obj_id, unnest(o) as u from r) where u.f >= 0""")
def keep_alive(t):
    return K.keep_alive(_history(t), 4, 6, -1, span=32)


def _removals(t):
    h = _history(t)
    return K.unmatched_removals(h, K.first_seen(h), 2, 15, span=32)


@query("delayed_emission", "track_obs", _HIST + """
, c as (select *, sum(case when matched then 0 else 1 end) over (partition by video_id, obj_id order by frame_idx) as n from h),
 r as (select video_id, obj_id, min(frame_idx) as removed_at from c where n >= 2 group by 1, 2), f as (select video_id, obj_id, min(frame_idx) as ff from h group by 1, 2),
 g as (select video_id, obj_id, removed_at from r join f using (video_id, obj_id) where ff > removed_at - 15), l as (select video_id, max(frame_idx) as la from h group by 1)
select h.video_id, h.frame_idx, h.obj_id, least(h.frame_idx + 5 - 1, la) as emitted_at from h join l using (video_id) left join g on g.video_id = h.video_id and g.obj_id = h.obj_id
 where removed_at is null or removed_at > least(h.frame_idx + 5 - 1, la)""")
def delayed_emission(t):
    h = _history(t)
    last = h.groupBy("video_id").agg(F.max("frame_idx").alias("last"))
    return K.delayed_emit(h, _removals(t), last, 5).select("video_id", "frame_idx", "obj_id", "emitted_at")


@query("both_directions", "track_obs", """
, v as (select video_id, max(frame_idx) + 1 as n, min(frame_idx) filter (where score > 0.9) as s from track_obs group by video_id),
 d as (select video_id, true as forward, unnest(range(s, n)) as frame_idx from v where s is not null union all
  select video_id, false, unnest(range(0, s)) from v where s is not null)
select d.video_id, d.forward, d.frame_idx, o.det_id from d join track_obs o on o.video_id = d.video_id and o.frame_idx = d.frame_idx""")
def both_directions(t):
    v = t.track_obs().groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"), F.min(F.when(F.col("score") > 0.9, F.col("frame_idx"))).alias("start"))
    both = K.processing_order(v, None, False).unionByName(K.processing_order(v, None, True))
    return both.join(t.track_obs(), ["video_id", "frame_idx"]).select("video_id", "forward", "frame_idx", "det_id")


_PLAN = """
, l as (select session_id, max(seq) as ls, max(seq) filter (where type like 'propagation%') as lp from actions group by 1),
 a as (select l.*, x.type as lt, x.frame_idx as lf, x.obj_id as lo, (select type from actions y where y.session_id = l.session_id and y.seq < l.ls order by seq desc limit 1) as pt from l
  join actions x on x.session_id = l.session_id and x.seq = l.ls),
 e as (select x.session_id, string_agg(distinct x.obj_id::varchar, ',' order by x.obj_id::varchar) as ids from actions x join l on l.session_id = x.session_id
  where x.type in ('add', 'refine') and (lp is null or x.seq > lp) group by 1),
 b as (select a.*, ids, lt in ('propagation_full', 'propagation_partial') as ran, coalesce(pt in ('propagation_full', 'propagation_partial'), false) or lf in (0, 9) as fin from a left join e using (session_id))
select session_id, case when lt = 'propagation_fetch' then lt when ran and fin then 'propagation_fetch' when ran then lt when ids is not null then 'propagation_partial' else 'propagation_fetch' end as plan,
 case when ran and not fin then lo::varchar when lt not like 'propagation%' then ids end as obj_ids from b"""


@query("propagation_plans", "actions", _PLAN)
def propagation_plans(t):
    s = t.actions().select("session_id").distinct().withColumn("n", F.lit(10).cast("bigint"))
    p = K.propagation_plan(t.actions(), s)
    return p.withColumn("obj_ids", F.array_join(F.transform("obj_ids", lambda v: v.cast("string")), ","))


@query("tombstones", "tracks actions", """
, r as (select distinct video_id, obj_id from tracks where tracker_score > 0.99), g as (select distinct session_id as video_id, obj_id from actions where type in ('add', 'refine'))
select t.video_id, t.frame_idx, t.obj_id, r.obj_id is not null as removed, g.obj_id is not null as refined, case when r.obj_id is not null then -10000.0::double else tracker_score end as score
 from tracks t left join r on r.video_id = t.video_id and r.obj_id = t.obj_id left join g on g.video_id = t.video_id and g.obj_id = t.obj_id""")
def tombstones(t):
    tr = t.tracks().withColumn("score", F.col("tracker_score"))
    return K.tombstones(tr, tr.where("tracker_score > 0.99"), t.actions()).select("video_id", "frame_idx", "obj_id", "removed", "refined", "score")
