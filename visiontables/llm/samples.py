"""Bounded samples of labelled messages for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(messages: DataFrame, labels: DataFrame, size: int, message_id: str, text: str, label: str, extra: dict[str, Column] | None = None) -> pd.DataFrame:
    """At most ``size`` labelled messages with their whole texts: columns ``text, label`` and ``extra``.

    The ids with the smallest hashes are taken, so the choice does not depend
    on how rows are dealt. Only these ids, at most ``size`` of them, are
    broadcast. Null ids or labels are left out; an id labelled twice has its
    larger label, and a repeated message counts once.
    """
    ids = labels.select(labels[message_id].alias("_id"), labels[label].cast("int").alias("label")).where("_id is not null and label is not null")
    ids = ids.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(size)
    m = messages.select(messages[message_id].alias("_id"), F.coalesce(messages[text], F.lit("")).alias("text"), *[c.alias(k) for k, c in (extra or {}).items()])
    return m.join(F.broadcast(ids), "_id").toPandas().sort_values(["_id", "text"]).drop_duplicates("_id").drop(columns="_id").reset_index(drop=True)
