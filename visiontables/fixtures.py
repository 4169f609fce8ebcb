"""Detection, mask and track tables derived from the given TPC-H-like tables.

Every table is a projection (plus an explode for masks and pixels) of one
input table, so it needs no shuffle and grows with its input. The column
expressions are plain SQL that Spark and DuckDB both understand; ``duck``
returns the same table as a DuckDB subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A row's id is 52 bits of the md5 of its identifying columns: stable, needs no
# numbering pass over the table, and unique within an image.
_ID_TEXT = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint))"
)
_ID_SPARK = f"cast(conv(substr(md5({_ID_TEXT}), 1, 13), 16, 10) as bigint)"
_ID_DUCK = f"cast(concat('0x', substr(md5({_ID_TEXT}), 1, 13)) as bigint)"

_IMAGE = "cast(floor(l_orderkey / 16) as bigint)"

IMAGE_W, IMAGE_H = 512, 544
MASK_STRIDE = 8
MASK_W, MASK_H = IMAGE_W // MASK_STRIDE, IMAGE_H // MASK_STRIDE

_DETECTION_BASE = {
    "image_id": _IMAGE,
    "prompt": "concat('p', cast(l_linenumber as string))",
    "bx": "(l_partkey * 37 + l_linenumber * 11) % 400",
    "bz": "(l_suppkey * 53 + l_partkey * 7) % 400",
    "bw": "40 + cast(l_quantity as bigint)",
    "bh": "30 + cast(l_quantity as bigint) * 2",
    "score": "cast(3000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 7000 as double) / 10000",
    "scale": "case when l_linenumber % 2 = 0 then cast(0.5 as double) else cast(1.0 as double) end",
}
_DETECTION = {
    "image_id": "image_id",
    "det_id": "det_id",
    "prompt": "prompt",
    "x1": "cast(bx as double)",
    "y1": "cast(bz as double)",
    "x2": "cast(bx + bw as double)",
    "y2": "cast(bz + bh as double)",
    "score": "score",
    "scale": "scale",
}
_IMAGES = {
    "image_id": _IMAGE,
    "w": f"cast({IMAGE_W} as bigint)",
    "h": f"cast({IMAGE_H} as bigint)",
    "gsd": f"cast(0.25 as double) + ({_IMAGE} % 4) * cast(0.25 as double)",
}
_BIG_IMAGES = {
    "image_id": "c_custkey",
    "w": "200 + (c_custkey * 37) % 2500",
    "h": "200 + (c_custkey * 53) % 2500",
}
# 100 frames of 4 observations per video
_OBS = {
    "video_id": "cast(floor(event_id / 400) as bigint)",
    "frame_idx": "cast(floor(event_id / 4) as bigint) % 100",
    "slot": "event_id % 4",
    "det_id": "event_id",
    "x1": "cast((event_id % 4) * 100 + ((cast(floor(event_id / 4) as bigint) % 100) * 3) % 45 + user_id % 9 as double)",
    "y1": "cast(40 + user_id % 13 as double)",
    "x2": "cast((event_id % 4) * 100 + ((cast(floor(event_id / 4) as bigint) % 100) * 3) % 45 + user_id % 9 + 60 as double)",
    "y2": "cast(40 + user_id % 13 + 50 as double)",
    "score": "cast(3000 + (event_id * 7919 + user_id * 31) % 7000 as double) / 10000",
    "matched": "event_type <> 'error'",
}
# the tracker's own boxes: same slots, other jitter; now and then another object takes a slot
_TRACKS = {
    "video_id": "cast(floor(event_id / 400) as bigint)",
    "frame_idx": "cast(floor(event_id / 4) as bigint) % 100",
    "obj_id": "event_id % 4 + 1 + case when user_id % 10 = 0 then 10 else 0 end",
    "x1": "cast((event_id % 4) * 100 + ((cast(floor(event_id / 4) as bigint) % 100) * 3) % 45 + 4 + (user_id * 7) % 23 as double)",
    "y1": "cast(44 + (user_id * 5) % 17 as double)",
    "x2": "cast((event_id % 4) * 100 + ((cast(floor(event_id / 4) as bigint) % 100) * 3) % 45 + 4 + (user_id * 7) % 23 + 60 as double)",
    "y2": "cast(44 + (user_id * 5) % 17 + case when user_id % 11 = 3 then 0 else 50 end as double)",
    "tracker_score": "cast((event_id * 613 + user_id * 17) % 1000 as double) / 1000",
}
_ACTIONS = {
    "session_id": "user_id",
    "seq": "event_id",
    "type": "case event_id % 6 when 0 then 'add' when 1 then 'refine' when 2 then 'remove'"
    " when 3 then 'propagation_full' when 4 then 'propagation_partial' else 'propagation_fetch' end",
    "frame_idx": "event_id % 10",
    "obj_id": "event_id % 7",
}
_REPLIES = {
    "conv_id": "doc_id",
    "text": "concat('Mask ', cast(1 + doc_id % 9 as string), ': ', case doc_id % 3 when 0 then 'HIGH'"
    " when 1 then 'medium' else 'Low' end, chr(10), cast(2 + doc_id % 5 as string), ' - LOW', chr(10),"
    " text, chr(10), '<verdict>', case when doc_id % 2 = 0 then 'Accept' when doc_id % 7 = 1 then 'Maybe'"
    " else 'Reject' end, '</verdict>', chr(10), 'segment_phrase_batch {\"text_prompts\": [\"', lang, ' tank\"]}')",
}


def _cols(spec: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in spec.items()]


def _sel(spec: dict[str, str]) -> str:
    return ", ".join(_cols(spec)).replace("as string)", "as varchar)")


class Tables:
    """The derived tables at one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def detections(self) -> DataFrame:
        base = self.raw("lineitem").selectExpr(*_cols({"det_id": _ID_SPARK, **_DETECTION_BASE}))
        return base.selectExpr(*_cols(_DETECTION))

    def images(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*_cols(_IMAGES)).distinct()

    def big_images(self) -> DataFrame:
        return self.raw("customer").selectExpr(*_cols(_BIG_IMAGES))

    def mask_runs(self) -> DataFrame:
        return self.detections().selectExpr(*_RUN_ORIGIN).selectExpr(
            "image_id", "det_id", "px", "py", "pye",
            f"explode(sequence(px, pxe - 1)) as x",
        ).selectExpr(*_RUN_SPAN).selectExpr(
            "image_id", "det_id", "x", "inline(" + _RUN_PARTS.format(arr="array", st="named_struct",
                                                                     a="'ys', ", b="'ye', ") + ")",
        )

    def pixels(self) -> DataFrame:
        g = self.images().selectExpr("image_id", f"explode(sequence(0L, {MASK_W - 1}L)) as x")
        g = g.selectExpr("image_id", "x", f"explode(sequence(0L, {MASK_H - 1}L)) as y")
        return g.selectExpr(*_PIXEL)

    def track_obs(self) -> DataFrame:
        return self.raw("events").selectExpr(*_cols(_OBS))

    def tracks(self) -> DataFrame:
        return self.raw("events").selectExpr(*_cols(_TRACKS))

    def actions(self) -> DataFrame:
        return self.raw("events").selectExpr(*_cols(_ACTIONS))

    def replies(self) -> DataFrame:
        return self.raw("documents").selectExpr(*_cols(_REPLIES))


_RUN_ORIGIN = [
    "image_id", "det_id",
    f"cast(floor(x1 / {MASK_STRIDE}) as bigint) as px", f"cast(floor(x2 / {MASK_STRIDE}) as bigint) as pxe",
    f"cast(floor(y1 / {MASK_STRIDE}) as bigint) as py", f"cast(floor(y2 / {MASK_STRIDE}) as bigint) as pye",
]
_RUN_SPAN = [
    "image_id", "det_id", "x", "x - px as rel",
    "py + (x - px) % 3 as top", "pye - (x - px) % 2 as bot",
]
# every fourth column with room for it has a one-cell hole
_RUN_PARTS = (
    "case when rel % 4 = 2 and bot - top >= 3"
    " then {arr}({st}({a}top, {b}top + 1), {st}({a}top + 2, {b}bot))"
    " else {arr}({st}({a}top, {b}bot)) end"
)
_PIXEL = [
    "image_id", "x", "y",
    "(x * 3 + y * 5 + image_id * 7) % 256 as r", "(x * 11 + y + image_id) % 256 as g", "(x + y * 13) % 256 as b",
]


def _duck_tables() -> dict[str, str]:
    det = f"select {_sel(_DETECTION)} from (select {_sel({'det_id': _ID_DUCK, **_DETECTION_BASE})} from lineitem) q"
    parts = ("case when rel % 4 = 2 and bot - top >= 3"
             " then [{'ys': top, 'ye': top + 1}, {'ys': top + 2, 'ye': bot}]"
             " else [{'ys': top, 'ye': bot}] end")
    runs = (
        "select image_id, det_id, x, s.ys as ys, s.ye as ye from (select image_id, det_id, x, unnest("
        + parts + f") as s from (select {', '.join(_RUN_SPAN)} from (select *, unnest(range(px, pxe)) as x"
        f" from (select {', '.join(_RUN_ORIGIN)} from ({det}) d0) d1) d2) d3) d4"
    )
    images = f"select distinct {_sel(_IMAGES)} from lineitem"
    pixels = (
        f"select {', '.join(_PIXEL)} from (select image_id, x, unnest(range(0, {MASK_H})) as y from"
        f" (select image_id, unnest(range(0, {MASK_W})) as x from ({images}) i0) i1) i2"
    )
    return {
        "detections": det,
        "images": images,
        "big_images": f"select {_sel(_BIG_IMAGES)} from customer",
        "mask_runs": runs,
        "pixels": pixels,
        "track_obs": f"select {_sel(_OBS)} from events",
        "tracks": f"select {_sel(_TRACKS)} from events",
        "actions": f"select {_sel(_ACTIONS)} from events",
        "replies": f"select {_sel(_REPLIES)} from documents",
    }


DUCK = _duck_tables()


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB query text: ``body`` with the named derived tables as CTEs.

    ``body`` may open with further CTEs by starting with a comma.
    """
    head = ", ".join(f"{n} as ({DUCK[n]})" for n in names.split())
    word = "with recursive" if recursive else "with"
    sep = " " if not body.lstrip().startswith(",") else ""
    return f"{word} {head}{sep}{body}"
