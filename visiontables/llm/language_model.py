"""Log-likelihood of messages by word counts and a gated recurrent language model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.llm import gru
from visiontables.llm import textbytes as B
from visiontables.llm.tables import most_frequent, written

SYMBOLS = 1024
WIDTH = 16
#: Words whose counts every task holds; the counts of all others are joined.
COMMON = 1 << 17
_SLICE = 12 << 20
_U = np.uint64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, bounds = B.flat(column)
    start, end, first = B.words(buf, bounds, B.SPACED)
    return B.word_hashes(buf, start, end).view(np.int64), first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in B.slices(batches, most=_SLICE):
        word, n = np.unique(_words(b.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "c"])


class _Vocabulary:
    """The common words and their counts, and the model's symbols: most frequent words, text end, and one for all others."""

    def __init__(self, word: np.ndarray, count: np.ndarray, ends: int, total: int):
        """``word`` by falling count; ``total`` counts all words in training."""
        own = min(SYMBOLS - 2, len(word))
        sizes = np.zeros(SYMBOLS, np.int64)
        sizes[:own] = count[:own]
        sizes[SYMBOLS - 2], sizes[SYMBOLS - 1] = ends, total - int(count[:own].sum())
        # symbols by falling count, so that a class holds words of like frequency
        rank = np.empty(SYMBOLS, np.int64)
        order = np.argsort(-sizes, kind="stable")
        rank[order] = np.arange(SYMBOLS)
        self.sizes, self.end, self.other = sizes[order], int(rank[SYMBOLS - 2]), int(rank[SYMBOLS - 1])
        by = np.argsort(word)
        self.word, self.count = word[by], count[by]
        self.symbol = np.full(len(word), self.other, np.int32)
        self.symbol[:own] = rank[:own]
        self.symbol = self.symbol[by]
        self.ends, self.own, self.own_count = ends, own, int(count[:own].sum())

    def look(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place among the common ones and whether it is there."""
        if not len(self.word):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.searchsorted(self.word, word)
        at[at == len(self.word)] = 0
        return at, self.word[at] == word

    def tokens(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols with an end after each text, each text's first, and for words: place and whether common."""
        unique, inverse = np.unique(word, return_inverse=True)
        at, known = self.look(unique)
        symbol = np.where(known, self.symbol[at] if len(self.word) else self.other, self.other)
        at, known = at[inverse], known[inverse]
        n = len(first) - 1
        out = np.full(len(word) + n, self.end, np.int64)
        out[np.arange(len(word)) + B.row_of(first)] = symbol[inverse]
        return out, first + np.arange(n + 1), at, known


def _train(vocabulary, model, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, reader, memory, seen = vocabulary.value, None, {}, 0
        reader = gru.Reader(gru.unpacked(model.value, SYMBOLS, WIDTH), v.end)
        for b in B.slices(batches, most=_SLICE):
            tokens, first, _, _ = v.tokens(*_words(b.column("text")))
            reader.train(tokens, first, rate, memory)
            seen += len(tokens)
        if seen:
            reader.finish(rate, memory)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([gru.packed(reader.model)], pa.binary())], names=["task", "weight", "model"])

    return run


def _mean(key: tuple, table: pa.Table) -> pa.Table:
    weight = table.column("weight").to_numpy()
    total = None
    for w, m in zip(weight, table.column("model")):
        part = np.frombuffer(m.as_buffer(), np.float32).astype(np.float64) * w
        total = part if total is None else total + part
    return pa.table({"weight": [float(weight.sum())], "model": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})


def _score(vocabulary, model):
    names = ["message_id", "text_hash", "n_tokens", "known", "common_log", "other_log", "n_other", "model_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        reader = gru.Reader(gru.unpacked(model.value, SYMBOLS, WIDTH), v.end)
        log = np.log10(v.count + 1.0)
        end_log = np.log10(v.ends + 1.0)
        for b in B.slices(batches, most=_SLICE):
            word, words_first = _words(b.column("text"))
            tokens, first, at, known = v.tokens(word, words_first)
            each = np.where(known, log[at], 0.0) if len(log) else np.zeros(len(word))
            place = np.arange(len(word)) + B.row_of(words_first)
            other = tokens[place] == v.other
            logp = reader.score(tokens, first) / np.log(10)
            columns = [np.diff(first), B.sums(known, words_first).astype(np.int64) + (v.ends > 0), B.sums(each, words_first) + end_log,
                       B.sums(each * other, words_first), B.sums(other, words_first).astype(np.int64), B.sums(logp, first)]
            yield pa.RecordBatch.from_arrays([b.column("message_id"), b.column("text_hash"), *map(pa.array, columns)], names=names)

    return run


def _rest(vocabulary):
    """Words that are not common, by text: most texts' few, and never a frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in B.slices(batches, most=_SLICE):
            word, first = _words(b.column("text"))
            _, known = v.look(word)
            k = np.flatnonzero(~known)
            row = B.row_of(first)[k]
            yield pa.RecordBatch.from_arrays([b.column("message_id").take(pa.array(row)), b.column("text_hash").take(pa.array(row)), pa.array(word[k])], names=["message_id", "text_hash", "word"])

    return run


def score_messages(messages: DataFrame, training: Column, message_id: str = "message_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """Log-likelihood of every whole text under two models learnt from the messages where ``training`` holds.

    Tokens are words that end at ASCII white space, with A-Z in lower case, and
    one end per text (a null or empty text has only that). Returns per message
    ``message_id, n_tokens, n_known`` (tokens met in training), ``train_tokens,
    base_score, score``, both scores in log10:

    * ``base_score`` adds ``log10((c + 1) / (N + V + 1))`` over the tokens: c is
      the token's count, N that of all, V that of distinct ones in training.
    * ``score`` is a gated recurrent model over the ``SYMBOLS - 2`` most
      frequent words, the end and one symbol for all other words, which then
      share that symbol's probability by their counts. Its output is a class
      and a word within the class; its state runs through the whole text.

    Words are counted over all training texts. Each task trains on its own
    texts, once and on every window of each, by back-propagation truncated to
    windows, a step per some 384 tokens or more at a falling rate; a task's weights are
    the mean over its steps, and those of all tasks are averaged, by their
    tokens and in two steps.
    Counts of the ``COMMON`` most frequent words are broadcast, a fixed bound;
    those of the other words, none of them frequent, are joined. A repeated row
    is repeated; without training rows only the ends of texts cost nothing.
    """
    spark = messages.sparkSession
    m = messages.select(messages[message_id].alias("message_id"), F.coalesce(messages[text], F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    m = m.withColumn("text_hash", F.xxhash64("text"))
    kind = m.schema["message_id"].dataType.simpleString()
    learnt = m.where("training")
    counts = written(learnt.select("text").mapInArrow(_counted, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learnt.count()
    common = most_frequent(counts, "c", COMMON).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words = _Vocabulary(common["word"].to_numpy(np.int64), common["c"].to_numpy(np.int64), ends, int(total))
    vocabulary = spark.sparkContext.broadcast(words)
    model = gru.packed(gru.start(words.sizes, WIDTH))
    now = spark.sparkContext.broadcast(model)
    parts = learnt.select("text").mapInArrow(_train(vocabulary, now, rate), "task bigint, weight double, model binary")
    parts = written(parts, "weights")
    n = parts.count()
    group = F.pmod("task", F.lit(max(1, int(np.sqrt(n))))).alias("group")
    means = parts.select(group, "weight", "model").groupBy("group").applyInArrow(_mean, "weight double, model binary").collect()
    if means:
        weight = sum(r["weight"] for r in means)
        model = (sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * r["weight"] for r in means) / weight).astype(np.float32).tobytes()
    final = spark.sparkContext.broadcast(model)
    scored = m.select("message_id", "text", "text_hash").mapInArrow(
        _score(vocabulary, final), f"message_id {kind}, text_hash bigint, n_tokens bigint, known bigint, common_log double, other_log double, n_other bigint, model_log double")
    scored = written(scored, "scores")
    rest = m.select("message_id", "text", "text_hash").mapInArrow(_rest(vocabulary), f"message_id {kind}, text_hash bigint, word bigint")
    if distinct > len(common):
        rest = rest.join(counts, "word")
        rest = rest.groupBy("message_id", "text_hash").agg(F.sum(F.log10(F.col("c") + 1)).alias("log"), F.count(F.lit(1)).alias("n"))
        copies = scored.groupBy("message_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
        same = lambda x, y: x["message_id"].eqNullSafe(y["message_id"]) & (x["text_hash"] == y["text_hash"])
        rest = rest.join(copies, same(rest, copies)).select(rest["message_id"].alias("_m"), rest["text_hash"].alias("_h"), (F.col("log") / F.col("copies")).alias("rest_log"), (F.col("n") / F.col("copies")).cast("bigint").alias("rest_known"))
        scored = scored.join(rest, scored["message_id"].eqNullSafe(rest["_m"]) & (scored["text_hash"] == rest["_h"]), "left")
    else:
        scored = scored.withColumns({"rest_log": F.lit(0.0), "rest_known": F.lit(0).cast("bigint")})
    tokens, types = int(total) + ends, distinct + (ends > 0)
    others, other_types = int(total) - words.own_count, distinct - words.own
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return scored.select(
        F.col("message_id").alias(message_id), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("common_log") + rest_log - F.col("n_tokens") * float(np.log10(tokens + types + 1))).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + rest_log - F.col("n_other") * float(np.log10(others + other_types + 1))).alias("score"))
