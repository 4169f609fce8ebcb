"""Where models plug in: functions over Arrow batches of table rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from visiontables.functions.text import confidence_lines
from visiontables.operators import nms as N
from visiontables.operators import packed as P
from visiontables.operators.filters import accept_yes_no
from visiontables.operators.numbering import position_in_order
from visiontables.operators.tracks import merge_confidence
from visiontables.session import checkpoint, is_empty, written

DETECTED = "image_id bigint, scale double, tile_id bigint, local_id bigint, x1 double, y1 double, x2 double, y2 double, score double, counts string"

_HANDED = 4096
# tasks a core gets at most: what a plan keeps per task must not grow with the tiles
_TASKS = 16
# rows of a key that are numbered in one task
_WHOLE = 1 << 16


def detect(tiles: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 16, extra: str = "",
           tasks: int | None = None, rows_per_task: int = 256) -> DataFrame:
    """Run a detector over tiles, ``batch`` of them per call.

    Tile rows are small and the model is slow, so they are dealt out evenly
    before it runs: over ``tasks``, or else ``rows_per_task`` to a task, or
    more where that would make over ``_TASKS`` tasks a core.

    The model gets tile rows and returns rows of ``DETECTED`` (and the columns
    ``extra`` declares) in tile pixels; ``local_id`` counts within a tile.
    ``counts`` is the compressed mask text over the tile, null (or no column at
    all) where there is no mask.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[pd.DataFrame] = []
            for lo in range(0, len(pdf), batch):
                out = model(pdf.iloc[lo:lo + batch])
                out = out if "counts" in out.columns else out.assign(counts=None)
                # answers go on some thousand rows at a time, as long as they are of one kind
                if held and (sum(map(len, held)) + len(out) > _HANDED or not held[0].dtypes.equals(out.dtypes)):
                    yield pd.concat(held)
                    held = []
                held.append(out)
            if held:
                yield pd.concat(held)

    if tasks is None:
        cores = tiles.sparkSession.sparkContext.defaultParallelism
        tasks = max(cores, min(_TASKS * cores, -(-tiles.count() // rows_per_task)))
    return tiles.repartition(tasks).mapInPandas(run, DETECTED + (", " + extra if extra else ""))


def with_prompt_features(rows: DataFrame, features: Callable[[pd.Series], pd.Series], prompt: str = "prompt", kind: str = "array<float>") -> DataFrame:
    """Compute a model's text side once per distinct prompt and join it on."""
    fn = F.pandas_udf(features, kind)
    table = rows.select(prompt).distinct().withColumn("prompt_features", fn(F.col(prompt)))
    return rows.join(table, prompt)


def ask(model: Callable[[pd.DataFrame], pd.Series], *columns: str) -> Column:
    """Reply text of a model for each row, from a struct of the named columns."""
    def reply(rows: pd.DataFrame) -> pd.Series:
        return model(rows)

    reply.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(reply, StringType())(F.struct(*columns))


def verify(dets: DataFrame, model: Callable[[pd.DataFrame], pd.Series], columns: list[str], policy: str = "lenient") -> DataFrame:
    """Add ``verified``: the model's yes or no on each row's crop; an empty
    crop is never accepted."""
    crop = (F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")) if "cx1" in dets.columns else F.lit(True)
    return dets.withColumn("verified", crop & accept_yes_no(ask(model, *columns), policy))


def _one_call_each(rows: DataFrame, keys: list[str], number: str, model: Callable[[pd.DataFrame], str]) -> DataFrame:
    """(keys, text): the model's reply to the rows of each key, by ``number``; calls are many and small, so a batch is cut up in its task."""
    held = [*keys, *[c for c in rows.columns if c not in keys]]

    def kernel(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        pdf = table.select(held).to_pandas()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        texts = [model(pdf.iloc[lo:hi]) for lo, hi in zip(first, np.append(first[1:], len(group)))]
        out = table.select(keys).take(pa.array(first)).append_column("text", pa.array(texts, pa.string()))
        yield from out.combine_chunks().to_batches()

    return P.by_group(rows, keys, kernel, P.kinds(rows, keys) + ", text string", [F.asc(number)])


def assess_confidence(rows: DataFrame, model: Callable[[pd.DataFrame], str], keys: list[str], number: str = "pos", group: int = 10) -> DataFrame:
    """Confidence words from replies on ``group`` rows at a time.

    Rows carry their number within the key; replies name rows by that number.
    Returns (keys, number, confidence) for the rows that got a word.
    """
    cut = rows.withColumn("_call", F.floor((F.col(number) - 1) / group))
    replies = _one_call_each(cut, [*keys, "_call"], number, model)
    lines = confidence_lines(replies, [*keys, "_call"]).drop("_call")
    return lines.withColumnRenamed("mask_no", number).join(rows.select(*keys, number), [*keys, number], "left_semi")


def smart_confidence(rows: DataFrame, first: Callable[[pd.DataFrame], str], again: Callable[[pd.DataFrame], str], keys: list[str],
                     limit: int, row: str = "det_id", group: int = 10) -> DataFrame:
    """Assess all rows, then look again at the doubtful ones, cluster by cluster.

    Doubtful is any row not rated HIGH, rated or not. Only keys with more than
    ``limit`` of them are looked at again (0: all); the model sees a cluster in
    one call. The later word wins; rows without any word are LOW.
    """
    numbered = written(position_in_order(rows, keys, [F.asc(row)], "pos", whole=_WHOLE), "numbered")
    one = written(assess_confidence(numbered, first, keys, group=group), "assessed")
    # keys and numbers tell which rows are doubtful; only those are moved whole
    doubt = numbered.select(*keys, "pos").join(one.where("confidence = 'HIGH'").select(*keys, "pos"), [*keys, "pos"], "left_anti")
    many = doubt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    doubt = written(numbered.join(doubt.join(many, keys, "left_semi"), [*keys, "pos"], "left_semi"), "doubtful")
    two = one.limit(0)
    if not is_empty(doubt):
        clusters = N.leader_cluster(doubt, keys, row=row)
        replies = _one_call_each(clusters, [*keys, "leader"], "pos", again)
        said = confidence_lines(replies, [*keys, "leader"]).drop("leader")
        two = said.withColumnRenamed("mask_no", "pos").join(doubt.select(*keys, "pos"), [*keys, "pos"], "left_semi")
    return merge_confidence(numbered, one, two, [*keys, "pos"])


def retry_unresolved(work: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], rephrase: Callable[[Column, int], Column],
                     keys: list[str], most: int = 2, prompt: str = "prompt") -> DataFrame:
    """Run keys until they have a verified row, at most ``most`` more times.

    ``attempt`` maps the open keys to candidate rows with ``verified``; a key
    without any goes round again under a new prompt. Result: all candidate rows
    with their ``attempt`` number.
    """
    done = None
    todo = work
    for n in range(most + 1):
        out = checkpoint(attempt(todo, n).withColumn("attempt", F.lit(n + 1)))
        done = out if done is None else done.unionByName(out)
        solved = out.where("verified").select(*keys).distinct()
        if n == most:
            break
        todo = checkpoint(todo.join(solved, keys, "left_anti").withColumn(prompt, rephrase(F.col(prompt), n)))
        if is_empty(todo):
            break
    return done


def register_tile_function(spark, name: str = "tile_grid") -> None:
    """Tile grids for SQL: ``SELECT * FROM images, LATERAL tile_grid(w, h, 512, 0.15D)``.

    A SQL table function, so the optimizer sees through it.
    """
    spark.sql(f"""
        create or replace temporary function {name}(w bigint, h bigint, tile int, overlap double)
        returns table (tile_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint)
        return select iy * nx + ix, x0, y0, least(x0 + tile, w), least(y0 + tile, h)
          from (select ix, iy, nx, greatest(0L, least(ix * stride, w - tile)) as x0, greatest(0L, least(iy * stride, h - tile)) as y0
            from (select stride, nx, ix, explode(sequence(0L, ny - 1)) as iy
              from (select stride, nx, ny, explode(sequence(0L, nx - 1)) as ix
                from (select stride, greatest(0L, ceil((w - tile) / stride)) + 1 as nx, greatest(0L, ceil((h - tile) / stride)) + 1 as ny
                  from (select cast(floor(tile * (1 - overlap)) as bigint) as stride)))))""")
