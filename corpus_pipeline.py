"""A corpus of messages made ready for training, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet in the shared folder and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.llm import benchmark_match, jaccard_join, packing, quality_model, secret_scan
from visiontables.llm.queries import remainder, table, vocabulary
from visiontables.llm.tables import written
from visiontables.session import is_empty


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    model = quality_model.fit_quality(docs, labels, ("n_chars",), message_id="doc_id")
    return quality_model.keep_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of similar ones; those without words or id all stay.

    Documents are similar when they share 80 of 100 five-word shingles, whatever ``op7_jaccard_join`` asks for.
    """
    groups = jaccard_join.join_messages(docs, jaccard_join.Join(width=5, percent=80), message_id="doc_id").where(F.col("component_id") == F.col("doc_id"))
    groups = written(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept-ids")
    kept = docs.join(groups.where("rows = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    repeated = groups.where("rows > 1")
    if is_empty(repeated):
        return kept
    return kept.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return benchmark_match.keep_clean(docs, table(spark, sf_dir, "benchmark"), noun_phrase="text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    found, _ = secret_scan.scan_secrets(docs, message_id="doc_id")
    hit = found.where(F.size("found") > 0).dropDuplicates(["doc_id", "blob"])
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = docs.withColumn("_blob", blob).join(hit.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_hit"), "found"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_blob") == F.col("_hit")), "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(secret_scan.mask_secrets(F.col("text"), F.col("found")))
    size = F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.length("_masked").cast(docs.schema["n_chars"].dataType))
    return d.withColumn("_masked", text).withColumns({"n_chars": size, "text": F.col("_masked")}).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048."""
    pieces = packing.cut_messages(docs, vocabulary(), message_id="doc_id")
    return packing.pack_sequences(pieces).withColumnRenamed("message_id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

# A trained classifier and a tokenizer are beyond SQL: tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
