"""Toxicity of messages by bags of subwords."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visiontables.llm import textbytes as B
from visiontables.llm.samples import labelled_sample
from visiontables.llm.tables import narrow

SAMPLE = 6_144
BUCKET_BITS = 17
WIDTH = 16
GRAMS = (3, 4, 5)
LEAST_STEPS = 1_200


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each text's first word, the distinct word each word is, and these in lower case."""
    buf, bounds = B.flat(column)
    start, end, first = B.words(buf, bounds, B.ALNUM)
    _, at, which = np.unique(B.word_hashes(buf, start, end), return_index=True, return_inverse=True)
    size = end[at] - start[at]
    # the distinct words, each followed by a blank
    place = B.ragged(start[at], size + 1)
    last = np.cumsum(size + 1) - 1
    text = buf[np.minimum(place, max(0, len(buf) - 1))].copy()
    text[last] = 32
    return first, which, text.tobytes().decode("utf-8", "replace").lower().split(" ")[:-1]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words, ends marked by blanks, and the word itself: each word's first, and buckets."""
    if not words:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = code == 32
    size = np.diff(np.flatnonzero(blank)) - 1
    edge = np.concatenate([[0], np.cumsum(size + 1)])  # the blank before each word
    word_of = np.repeat(np.arange(len(words)), size + 1)
    owner, bucket = [], []
    inner = np.concatenate([[0], np.cumsum(blank)])
    for n in GRAMS:
        if len(code) < n:
            continue
        at = np.arange(len(code) - n + 1)
        ok = at[inner[at + n - 1] - inner[at + 1] == 0]  # blanks at the ends only
        h = np.zeros(len(ok), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[ok + j]
        owner.append(word_of[ok])
        bucket.append(B.mix(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS))
    start = edge[:-1] + 1
    step = B.powers(int(size.max()) if len(size) else 1)
    flat = B.ragged(start, size)
    value = code[flat] * step[B.ragged(np.zeros(len(size), np.int64), size)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    to = np.cumsum(size)
    owner.append(np.arange(len(words)))
    bucket.append(B.mix(total[to] - total[to - size]) >> np.uint64(64 - BUCKET_BITS))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(len(words) + 1)), bucket[order]


@dataclass
class ToxicityModel:
    """What each subword adds to the toxic class's logit: its embedding times the softmax weights."""

    bias: float
    subword: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        first, which, words = distinct_words(column)
        edge, bucket = subwords(words)
        word = B.sums(self.subword[bucket], edge) / np.maximum(1, np.diff(edge))
        mean = B.sums(word[which], first) / np.maximum(1, np.diff(first))
        return 1 / (1 + np.exp(-(mean + self.bias)))


def bags(column: pa.Array, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's first subword, the subwords' buckets, and their shares of the text's mean."""
    size, gram, part = [], [], []
    for at in range(0, len(column), rows):
        first, which, words = distinct_words(column.slice(at, rows))
        edge, bucket = subwords(words)
        n, per = np.diff(first), np.diff(edge)
        doc, times = np.unique(B.row_of(first) * max(1, len(words)) + which, return_counts=True)
        doc, word = doc // max(1, len(words)), doc % max(1, len(words))
        key = (np.repeat(doc, per[word]) << BUCKET_BITS) | bucket[B.ragged(edge[:-1][word], per[word])]
        share = np.repeat(times / np.maximum(1, n)[doc] / np.maximum(1, per[word]), per[word])
        key, slot = np.unique(key, return_inverse=True)
        size.append(np.bincount(key >> BUCKET_BITS, minlength=len(n)))
        gram.append((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
        part.append(np.bincount(slot, share, minlength=len(key)).astype(np.float32))
    return np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(gram), np.concatenate(part)


def fit(sample: pd.DataFrame, rounds: int = 8, batch: int = 32, rate: float = 0.4, seed: int = 5) -> ToxicityModel:
    """Train embeddings and softmax together by AdaGrad; without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    if sample.empty:
        return ToxicityModel(0.0, np.zeros(1 << BUCKET_BITS))
    y = sample["label"].to_numpy(np.int64)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight, bias = rng.normal(0, 0.3, (WIDTH, 2)), np.array([np.log(1 - p), np.log(p)])
    first, gram, part = bags(pa.array(sample["text"], pa.string()))
    g_table, g_weight, g_bias = np.full(table.shape, 1e-4, np.float32), np.full(weight.shape, 1e-4), np.full(2, 1e-2)
    for _ in range(max(rounds, min(100, -(-LEAST_STEPS * batch // len(y))))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            n = np.diff(first)[rows]
            k = B.ragged(first[:-1][rows], n)
            g, share, owner = gram[k], part[k], np.repeat(np.arange(len(rows)), n)
            some = np.flatnonzero(n)
            hidden = np.zeros((len(rows), WIDTH))
            if len(some):
                hidden[some] = np.add.reduceat(table[g] * share[:, None], (np.cumsum(n) - n)[some], axis=0)
            z = hidden @ weight + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            err = z / z.sum(axis=1, keepdims=True)
            err[np.arange(len(rows)), y[rows]] -= 1
            d_weight, d_bias, d_hidden = hidden.T @ err, err.sum(axis=0), err @ weight.T
            if len(g):
                order_g = np.argsort(g)
                head = np.flatnonzero(np.diff(g[order_g], prepend=-1))
                used = g[order_g][head]
                step = d_hidden.astype(np.float32)[owner[order_g]] * share[order_g][:, None]
                d_table = np.add.reduceat(step, head, axis=0)
                g_table[used] += d_table**2
                table[used] -= rate * d_table / np.sqrt(g_table[used])
            g_weight += d_weight**2
            weight -= rate * d_weight / np.sqrt(g_weight)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    return ToxicityModel(float(bias[1] - bias[0]), table @ (weight[:, 1] - weight[:, 0]))


def fit_toxicity(messages: DataFrame, labels: DataFrame, sample: int = SAMPLE, message_id: str = "message_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Fit a softmax over mean subword embeddings to labelled messages.

    A word is the mean of the vectors of its character n-grams and of itself, a
    message the mean of its words; misspelt words share most n-grams with those
    seen. Vectors and softmax are trained together on at most ``sample`` rows
    of ``labels (message_id, toxic 0/1)``, whose whole texts come to the driver.
    """
    return fit(labelled_sample(messages, labels, sample, message_id, text, toxic))


def score_toxicity(messages: DataFrame, model: ToxicityModel, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """``message_id`` and ``score`` (0 to 1, higher for toxic) of every whole text.

    One row per input row, without a shuffle; a null or wordless text has the
    score of no evidence. Other columns are ignored.
    """
    m = narrow(messages, _id=message_id, _text=text)
    kind = m.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(model.scores(b.column("_text")))], names=["_id", "score"])

    out = m.mapInArrow(run, T.StructType([T.StructField("_id", kind), T.StructField("score", T.DoubleType())]))
    return out.withColumnRenamed("_id", message_id)
