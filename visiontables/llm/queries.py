"""The ``opN_`` queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.llm import benchmark_match, embedding_links, jaccard_join, language_model, packing, phrase_index, prefix_trie, quality_model, quality_rules, repeated_spans, secret_scan, token_files, toxicity_model
from visiontables.llm.oracles import ORACLES as _SQL
from visiontables.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(_SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text."""
    found, _ = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), message_id="doc_id")
    n = lambda kind: F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = secret_scan.listed(F.col("found"), secret_scan.BASE)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), sha256_of(base).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def scored(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three folds of four."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    model = toxicity_model.fit_toxicity(documents, labels, message_id="doc_id")
    return scored(toxicity_model.score_toxicity(documents, model, message_id="doc_id"), remainder(4) == 2)


@query
def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings linked by a cosine of 0.9 or more."""
    linked = embedding_links.link_embeddings(table(spark, sf_dir, "embeddings"), det_id="vec_id")
    return linked.select("vec_id", "n_links", "component_id", "kept")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four folds of five."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    model = quality_model.fit_quality(documents, labels, ("n_chars",), message_id="doc_id")
    return scored(quality_model.score_quality(documents, model, message_id="doc_id"), remainder(5) == 0)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Simple-8b files and read back."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), message_id="doc_id")
    read = token_files.read_token_files(spark, path)
    return read.select(F.col("message_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of 2048."""
    pieces = packing.cut_messages(table(spark, sf_dir, "documents"), vocabulary(), message_id="doc_id")
    return packing.pack_sequences(pieces).withColumnRenamed("message_id", "doc_id")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 of 100 four-word shingles."""
    groups = jaccard_join.join_messages(table(spark, sf_dir, "documents"), message_id="doc_id")
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of the benchmark."""
    marked = benchmark_match.mark_phrases(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), message_id="doc_id", noun_phrase="text")
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        sha256_of(names).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document, learnt from six folds of seven."""
    documents = table(spark, sf_dir, "documents")
    scores = language_model.score_messages(documents, remainder(7) != 2, message_id="doc_id")
    return scores.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that earlier documents hold."""
    cut = repeated_spans.remove_repeats(table(spark, sf_dir, "documents"), message_id="doc_id")
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), sha256_of(F.col("kept")).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, each rebuilt with the first turns of its twenty's first one."""
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string").cast("binary")) % 4
    turns, ids = prefix_trie.first_messages(table(spark, sf_dir, "conversations"), shared, c - c % 20)
    trie = prefix_trie.prefix_trie(turns, ids)
    nodes = trie.nodes.join(prefix_trie.ends_digest(trie.ends), ["depth", "a", "b"], "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", sha256_of(F.lit("").cast("binary"))).alias("ends_sha256"))


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two or three words that stick together most."""
    return phrase_index.mine_phrases(table(spark, sf_dir, "documents"), role="lang").withColumnRenamed("role", "lang")


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of rules learnt from the labels."""
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(documents, table(spark, sf_dir, "labels"), ["doc_id"])
    rated = quality_rules.rate_messages(documents, rules, ["doc_id"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
