"""Queries on prompts, replies, message logs, documents and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.catalog.registry import query
from visiontables.functions import text as X
from visiontables.sources import results as R

_WORDS = "list_filter(regexp_split_to_array({t}, '" + X.SPACE + "+'), lambda w: w <> '')"


def _w(t: str) -> str:
    return _WORDS.replace("{t}", t)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("fallback_prompts", "", f"""
with w as (select doc_id, list_filter({_w('lower(text)')}, lambda w: w not in {_in(X.SHORT_STOP_WORDS)}) as ws from documents)
select doc_id, case when len(ws) > 0 then array_to_string(ws[1:3], ' ') else 'object' end as prompt from w""")
def fallback_prompts(t):
    return t.raw("documents").select("doc_id", X.fallback_prompt(F.col("text")).alias("prompt"))


_RICH = ", ".join(
    f"nullif(array_to_string(list_filter({_w('regexp_extract(low, ' + chr(39) + p + chr(39) + ', 1)')}, lambda w: w not in {_in(X.GENERIC_WORDS)})[1:3], ' '), '')"
    for p in X.OBJECT_PATTERNS)


@query("fallback_prompts_rich", "", f"""
with d as (select doc_id, lower(text) as low from documents),
 w as (select *, list_filter({_w('low')}, lambda w: w not in {_in(X.GENERIC_WORDS)} and length(w) > 2) as ws from d)
select doc_id, coalesce({_RICH}, case when len(ws) > 0 then array_to_string(ws[1:3], ' ') else 'object' end) as prompt from w""")
def fallback_prompts_rich(t):
    return t.raw("documents").select("doc_id", X.fallback_prompt_rich(F.col("text")).alias("prompt"))


_REPH = f"""
with p as (select doc_id, text as q, array_to_string({_w('text')}[1:1 + doc_id % 2], ' ') as prev, doc_id % 4 as attempt,
  ['large ' || {_w('text')}[1], {_w('text')}[1]] as used from documents),
 w as (select *, {_w('prev')} as ws from p),
 n as (select *, coalesce({', '.join(f"nullif(regexp_extract(lower(q), '{p}', 1), '')" for p in X.NOUN_PATTERNS)}, prev || 's') as noun,
  coalesce(list_filter(['large ' || prev, 'small ' || prev, 'circular ' || prev, 'rectangular ' || prev], lambda d: not list_contains(used, d))[1], prev) as des from w),
 k as (select *, case when attempt = 0 then case when len(ws) > 1 then ws[-1] else noun end when attempt = 1 then case when len(ws) > 1 then ws[1] else des end
  else case when len(ws) > 1 then array_to_string(ws[2:], ' ') else prev end end as pick from n)
select doc_id, case when lower(pick) = lower(prev) or list_contains(used, pick) then case when len(ws) > 1 then case when ws[-1] <> prev then ws[-1] else ws[1] end else prev || 's' end else pick end as prompt from k"""


@query("rephrased_prompts", "", _REPH)
def rephrased_prompts(t):
    ws = X.words(F.col("text"))
    d = t.raw("documents").select(
        "doc_id", "text", F.array_join(F.slice(ws, F.lit(1), (F.col("doc_id") % 2 + 1).cast("int")), " ").alias("prev"),
        (F.col("doc_id") % 4).alias("attempt"), F.array(F.concat(F.lit("large "), ws[0]), ws[0]).alias("used"))
    return d.select("doc_id", X.rephrase_fallback(F.col("prev"), F.col("text"), F.col("attempt"), F.col("used")).alias("prompt"))


@query("object_types", "", f"""
select doc_id, case when len({_w('lower(text)')}) > 0 then regexp_replace({_w('lower(text)')}[-1], 's+$', '') else '' end as object_type from documents""")
def object_types(t):
    return t.raw("documents").select("doc_id", X.object_type(F.col("text")).alias("object_type"))


@query("confidence_lines", "replies", r"""
, l as (select conv_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from replies),
 h as (select conv_id, i, try_cast(regexp_extract(line, '(?i)(?:Mask\s*)?(\d+)\s*[:\-]\s*(HIGH|MEDIUM|LOW)', 1) as bigint) as mask_no,
  upper(regexp_extract(line, '(?i)(?:Mask\s*)?(\d+)\s*[:\-]\s*(HIGH|MEDIUM|LOW)', 2)) as c from l)
select conv_id, mask_no, max_by(c, i) as confidence from h where mask_no is not null group by 1, 2""")
def confidence_lines(t):
    return X.confidence_lines(t.replies(), ["conv_id"])


_VERDICT = """
, v as (select conv_id, string_split(string_split(text, '<verdict>')[-1], '</verdict>')[1] as v from replies),
 w as (select conv_id, case when contains(v, 'Accept') and not contains(v, 'Reject') then 'Accept' when contains(v, 'Reject') and not contains(v, 'Accept') then 'Reject' end as verdict from v)
"""


@query("verdicts", "replies", _VERDICT + "select conv_id, verdict from w")
def verdicts(t):
    return t.replies().select("conv_id", X.verdict(F.col("text")).alias("verdict"))


@query("accepted_documents", "replies", _VERDICT + "select doc_id, lang from documents join w on conv_id = doc_id where verdict = 'Accept'")
def accepted_documents(t):
    from visiontables.operators.filters import accept_verdicts

    v = t.replies().select(F.col("conv_id").alias("doc_id"), X.verdict(F.col("text")).alias("verdict"))
    return accept_verdicts(t.raw("documents"), v, ["doc_id"]).select("doc_id", "lang")


@query("verdict_errors", "replies", _VERDICT + "select conv_id from w where verdict is null")
def verdict_errors(t):
    from visiontables.operators.filters import verdict_errors as errors

    return errors(t.replies().select("conv_id", X.verdict(F.col("text")).alias("verdict"))).select("conv_id")


_CALL_TEXT = """case doc_id % 6 when 0 then concat(text, '{"name": "segment_phrase_batch", "arguments": {"text_prompts": ["', lang, '"]}}')
 when 1 then concat(text, 'segment_phrase_batch {"text_prompts": ["', lang, ' tank"]}') when 2 then concat('select_masks_and_return: [', cast(doc_id as string), ', 2] ', lang)
 when 3 then concat(lang, ' examine_each_mask please') when 4 then concat('use segment_phrase with "text_prompt": "', lang, '" now') else text end"""


@query("tool_calls", "", f"""
with d as (select doc_id, lang, {_CALL_TEXT.replace('as string', 'as varchar')} as t from documents)
select doc_id, case doc_id % 6 when 0 then 'segment_phrase_batch' when 1 then 'segment_phrase_batch' when 2 then 'select_masks_and_return' when 3 then 'examine_each_mask' when 4 then 'segment_phrase_batch' end as name,
 case doc_id % 6 when 0 then regexp_extract(t, '"arguments"\\s*:\\s*(\\{{[^{{}}]*\\}})', 1) when 1 then regexp_extract(t, 'segment_phrase_batch\\s*(\\{{[^{{}}]*\\}})', 1)
 when 2 then '{{"final_answer_masks": [' || regexp_extract(t, '\\[([^\\]]+)\\]', 1) || ']}}' when 3 then '{{}}' when 4 then '{{"text_prompts": ["' || regexp_extract(t, '"text_prompt"\\s*:\\s*"([^"]+)"', 1) || '"]}}' end as arguments
 from d where doc_id % 6 <> 5""")
def tool_calls(t):
    d = t.raw("documents").selectExpr("doc_id", _CALL_TEXT + " as t")
    c = d.select("doc_id", F.explode(X.extract_tool_calls(F.col("t"))).alias("c"))
    return c.select("doc_id", "c.name", "c.arguments")


_KW_TEXT = """case doc_id % 5 when 0 then concat('```json {"keywords": ["', lang, '", " ", "', source, '"], "primary_object": "', lang, '"}```')
 when 1 then concat('Sure: {"keywords": ["', lang, '"], "reasoning": "none"} ok') when 2 then concat('{broken "keywords" ', lang, '} {"keywords": [1], "primary_object": "x"}')
 when 3 then concat('{"keywords": ["a", "', source, '"], "primary_object": "b", "reasoning": "r", "more": {"x": 1}}') else text end"""


@query("keywords", "", """
select doc_id, case doc_id % 5 when 0 then lang || '|' || source when 3 then 'a|' || source else lang end as keywords from documents""")
def keywords(t):
    d = t.raw("documents").selectExpr("doc_id", "lang", _KW_TEXT + " as reply")
    return d.select("doc_id", F.array_join(X.extract_keywords(F.col("reply"), F.col("lang")), "|").alias("keywords"))


@query("valid_replies", "", """
select event_id, event_id % 5 in (0, 1) and value / 100 <= 1 as valid from events""")
def valid_replies(t):
    text = F.concat(F.lit('{"is_valid": '), F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "false").when(
        F.col("event_id") % 5 == 2, '"maybe"').when(F.col("event_id") % 5 == 3, "null").otherwise("12"),
        F.lit(', "confidence": '), (F.col("value") / 100).cast("decimal(20,6)").cast("string"), F.lit("}"))
    return t.raw("events").select("event_id", X.validate_reply(text).alias("valid"))


_UN1 = "replace(replace(replace(replace(replace(replace(replace(replace({t}, '&middot;', chr(183)), '&copy;', chr(169)), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_UN = _UN1.format(t=_UN1.format(t="text"))
_UN_HTML = _UN1.format(t=_UN1.format(t="html"))


@query("canonical_texts", "", f"""
select doc_id, trim(regexp_replace(lower(translate(replace({_UN}, '_', ' '), '!"#$%&''()*+,-./:;<=>?@[\\]^`{{|}}~', '')), '{X.SPACE}+', ' ', 'g')) as canonical from documents""")
def canonical_texts(t):
    return t.raw("documents").select("doc_id", X.canonicalize_text(F.col("text")).alias("canonical"))


@query("clean_texts", "", f"""
select page_id, trim(regexp_replace({_UN_HTML}, '{X.SPACE}+', ' ', 'g')) as clean, trim(regexp_replace(lower({_UN_HTML}), '{X.SPACE}+', ' ', 'g')) as lowered from pages""")
def clean_texts(t):
    c = F.col("html")
    return t.raw("pages").select("page_id", X.canonicalize_text(c, "whitespace").alias("clean"), X.canonicalize_text(c, "lower").alias("lowered"))


@query("parsed_scales", "", """
with s as (select event_id, value || ', x' || event_id || ',' || (event_id % 7) || ' , ' || event_type as t from events),
 p as (select event_id, list_filter(list_transform(string_split(t, ','), lambda v: try_cast(trim(v) as double)), lambda v: v is not null) as s from s)
select event_id, len(s)::integer as n, s[1] as first, s[len(s)] as last from p""")
def parsed_scales(t):
    e = t.raw("events").select("event_id", X.parse_scales(F.concat(
        F.col("value").cast("string"), F.lit(", x"), F.col("event_id").cast("string"), F.lit(","), (F.col("event_id") % 7).cast("string"), F.lit(" , "), "event_type")).alias("s"))
    return e.select("event_id", F.size("s").alias("n"), F.col("s")[0].alias("first"), F.element_at("s", -1).alias("last"))


@query("image_counts", "", "select conv_id, sum(case when role = 'user' then 1 else 0 end + case when length(text) > 300 then 1 else 0 end)::bigint as images from conversations group by conv_id")
def image_counts(t):
    part = lambda kind, when: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit("").alias("value")))
    m = t.raw("conversations").select("conv_id", F.array_compact(F.array(
        part("image", F.col("role") == "user"), part("text", F.lit(True)), part("image", F.length("text") > 300))).alias("parts"))
    return X.count_images(m)


@query("pruned_contexts", "", """
with c as (select conv_id, max(turn) filter (where role = 'assistant' and turn >= 2 and contains(text, 'a')) as cut from conversations group by 1)
select m.conv_id, m.turn, m.role from conversations m join c using (conv_id) where turn < 2 or turn >= cut""")
def pruned_contexts(t):
    return X.prune_context(t.raw("conversations"), F.col("text").contains("a")).select("conv_id", "turn", "role")


# ---- documents and references --------------------------------------------------------------------

@query("document_rows", "detections images", """
select image_id, det_id, x1, y1, x2, y2, score, h as orig_img_h from detections join images using (image_id)""")
def document_rows(t):
    docs = R.to_documents(t.detections(), t.images())
    return R.from_documents(docs).select("image_id", "det_id", "x1", "y1", "x2", "y2", "score", "orig_img_h")


@query("document_sizes", "detections images", """
select image_id, count(*)::integer as n, max(score) as best, list(x1 order by score desc, det_id)[1] as first_x1 from detections group by 1""")
def document_sizes(t):
    docs = R.to_documents(t.detections(), t.images())
    return docs.select("image_id", F.size("pred_scores").alias("n"), F.col("pred_scores")[0].alias("best"), F.col("pred_boxes")[0][0].alias("first_x1"))


@query("region_rows", "", """
with d as (select doc_id, string_split(text, chr(10)) as l from documents),
 r as (select doc_id, unnest(case doc_id % 3 when 0 then [lang] when 1 then l else l[1:greatest(len(l) - 1, 0)] end) as mask,
  generate_subscripts(case doc_id % 3 when 0 then [lang] when 1 then l else l[1:greatest(len(l) - 1, 0)] end, 1) - 1 as pos from d join documents using (doc_id))
select doc_id, cast(pos as integer) as pos, mask, case when doc_id % 3 = 2 and pos = 0 then 0.5::double end as score from r""")
def region_rows(t):
    region = lambda m: F.struct(F.array(F.lit(0.0)).alias("bbox"), m.alias("mask"), F.lit(None).cast("double").alias("score"))
    lines = F.split("text", "\n", -1)
    none = F.slice(F.array(region(F.lit(""))), 1, 0)
    kind = F.col("doc_id") % 3
    d = t.raw("documents").select(
        "doc_id", F.when(kind == 0, F.array(region(F.col("lang")))).otherwise(none).alias("regions"), none.alias("objects"),
        F.when(kind == 1, F.transform(lines, region)).otherwise(none).alias("instances"),
        F.transform(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), lambda m: F.array(F.lit(0.0))).alias("pred_boxes"),
        lines.alias("pred_masks"), F.array(F.lit(0.5)).alias("pred_scores"))
    return R.regions_of(d, ["doc_id"]).select("doc_id", "pos", "mask", "score")


@query("result_paths", "", r"""
with p as (select page_id, url, string_split(url, '/')[-1] as base, html from pages),
 s as (select *, regexp_replace(regexp_replace(base, '([^.])\.[^.]*$', '\1'), '[/\\]', '_', 'g') as stem, regexp_replace(html, '[/\\]', '_', 'g') as slug from p)
select page_id, case when stem = '' then 'output' when starts_with(stem, '-') then 'image_' || stem else stem end || '/' ||
 case when length(slug) > 50 then left(slug, 50) || '_' || left(md5(html), 8) else slug end as path from s""")
def result_paths(t):
    return t.raw("pages").select("page_id", R.result_path(F.col("url"), F.col("html")).alias("path"))


@query("only_new_documents", "", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def only_new_documents(t):
    return R.only_new(t.raw("documents").select("doc_id"), t.raw("labels"), ["doc_id"])


@query("image_references", "", """
select page_id, case when page_id % 5 = 0 then 'missing' when page_id % 5 in (1, 2, 3) then 'data' else 'url' end as kind,
 case when page_id % 5 = 1 then octet_length(encode(html))::integer end as bytes,
 case page_id % 5 when 0 then 'no reference' when 2 then 'no data after the comma' when 3 then 'bad base64' end as error from pages""")
def image_references(t):
    k = F.col("page_id") % 5
    p = t.raw("pages").withColumn("ref", F.when(k == 1, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("html").cast("binary"))))
                                  .when(k == 2, F.lit("data:image/png;base64")).when(k == 3, F.lit("data:image/png;base64,%%%")).when(k == 4, F.col("url")))
    r = R.resolve_image_refs(p, "ref")
    return r.select("page_id", "kind", F.length("content").alias("bytes"), "error")


@query("ordered_frames", "", r"""
with f as (select source as folder, case when source in ('src1', 'src2') then doc_id || '.jpg' when doc_id % 9 = 0 then 'x' || doc_id || '.PNG' when doc_id % 4 = 0 then doc_id || '.txt' else doc_id || '.webp' end as name from documents),
 i as (select *, try_cast(regexp_extract(name, '^(.*)\.[^.]*$', 1) as bigint) as n from f where not name like '%.txt'),
 a as (select *, bool_and(n is not null) over (partition by folder) as num from i)
select folder, name, row_number() over (partition by folder order by case when num then n end nulls first, name) - 1 as frame_idx from a""")
def ordered_frames(t):
    d = F.col("doc_id").cast("string")
    f = t.raw("documents").select(F.col("source").alias("folder"), F.when(F.col("source").isin("src1", "src2"), F.concat(d, F.lit(".jpg")))
                                  .when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), d, F.lit(".PNG")))
                                  .when(F.col("doc_id") % 4 == 0, F.concat(d, F.lit(".txt"))).otherwise(F.concat(d, F.lit(".webp"))).alias("name"))
    return R.order_frames(f).select("folder", "name", "frame_idx")


@query("routed_media", "", """
select doc_id, case lang when 'en' then '/media/en' when 'fr' then '/media/fr' end as root, case when lang not in ('en', 'fr') then 'unknown dataset ' || lang end as error from documents""")
def routed_media(t):
    d = t.raw("documents").select("doc_id", F.col("lang").alias("dataset"))
    roots = d.where("dataset in ('en', 'fr')").select("dataset").distinct().withColumn("root", F.concat(F.lit("/media/"), "dataset"))
    return R.route_media(d, roots).select("doc_id", "root", "error")
