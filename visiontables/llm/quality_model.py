"""Quality of messages by a factorisation machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm import textbytes as B
from visiontables.llm.samples import labelled_sample
from visiontables.llm.tables import narrow

SAMPLE = 8_192
WORD_BITS = 16
RANK = 8
LEAST_STEPS = 700
_BINS = 16
_STATS = 14


@dataclass
class QualityModel:
    """Weights of the features, one by one (``linear``) and by pairs (``factors``)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    metadata: tuple[str, ...] = ()

    def logits(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of each row; all pairs at once, by half the square of sums less the sum of squares."""
        v = self.factors[feature] * value[:, None]
        pairs = 0.5 * (B.sums(v, first) ** 2 - B.sums(v * v, first)).sum(axis=1)
        return self.bias + B.sums(self.linear[feature] * value, first) + pairs


def n_features(metadata: int) -> int:
    return (1 << WORD_BITS) + (_STATS + metadata) * _BINS


def features(column: pa.Array, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text: where its own begin, their numbers and their values.

    Hashed words carry the root of their share of the text, so that they have
    length 1 together. Each statistic of the text's structure, and each
    metadata column, is one of 16 grades.
    """
    buf, bounds = B.flat(column)
    rows = len(bounds) - 1
    start, end, first = B.words(buf, bounds, B.SPACED)
    row = B.row_of(first)
    h = B.word_hashes(buf, start, end) >> np.uint64(64 - WORD_BITS)
    key, n = np.unique((row.astype(np.int64) << WORD_BITS) | h.astype(np.int64), return_counts=True)
    word_row, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    words = np.maximum(1, np.diff(first))
    share = n / words[word_row]

    def count(flag: np.ndarray) -> np.ndarray:
        return B.sums(flag, bounds)

    size = np.maximum(1, np.diff(bounds))
    upper = (buf >= 65) & (buf <= 90)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    digit = (buf >= 48) & (buf <= 57)
    space = ~B.SPACED[buf]
    mark = ~(letter | digit | space)
    repeat = np.zeros(len(start), bool)
    if len(start) > 1:
        repeat[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    top = np.zeros(rows)
    np.maximum.at(top, word_row, share)
    distinct = np.bincount(word_row, minlength=rows)
    line_start, line_end, line_first = B.words(buf, bounds, np.arange(256) != 10)
    line = B.word_hashes(buf, line_start, line_end)
    lines = np.maximum(1, np.diff(line_first))
    line_row = B.row_of(line_first)
    same_lines = np.bincount(np.unique(np.stack([line_row.astype(np.uint64), line]), axis=1)[0].astype(np.int64), minlength=rows) if len(line) else np.zeros(rows)
    marks_like = np.zeros(rows)
    if len(start):
        last = mark[end - 1]
        marks_like = B.sums(last, first) / words
    ratios = [count(upper) / size, count(digit) / size, count(mark) / size, count(space) / size, count(buf >= 128) / size,
              distinct / words, top, B.sums(repeat, first) / words, 1 - same_lines / lines, marks_like, count((buf == 33) | (buf == 42) | (buf == 35) | (buf == 124)) / size]
    sizes = [np.diff(bounds), np.diff(first), np.diff(bounds) / words]
    grades = [np.minimum(_BINS - 1, np.floor(_BINS * np.sqrt(np.clip(r, 0, 1)))) for r in ratios]
    grades += [np.minimum(_BINS - 1, np.floor(np.log2(1 + s))) for s in sizes]
    grades += [np.minimum(_BINS - 1, np.floor(np.log2(1 + np.maximum(0, np.nan_to_num(m, nan=0.0, posinf=0, neginf=0))))) for m in metadata]
    fixed = np.stack([(1 << WORD_BITS) + k * _BINS + g.astype(np.int64) for k, g in enumerate(grades)], axis=1)
    per = np.bincount(word_row, minlength=rows) + fixed.shape[1]
    edge = np.concatenate([[0], np.cumsum(per)])
    feature, value = np.empty(edge[-1], np.int64), np.empty(edge[-1], np.float32)
    place = np.arange(len(word)) + (word_row * fixed.shape[1])
    feature[place], value[place] = word, np.sqrt(share)
    tail = (edge[1:] - fixed.shape[1])[:, None] + np.arange(fixed.shape[1])
    feature[tail], value[tail] = fixed, 1 / np.sqrt(fixed.shape[1])
    return edge, feature, value


def fit(sample: pd.DataFrame, metadata: tuple[str, ...], rounds: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 7) -> QualityModel:
    """Logistic loss by AdaGrad over columns ``text, label`` and ``metadata``; without rows every score is 0.5."""
    n = n_features(len(metadata))
    rng = np.random.default_rng(seed)
    model = QualityModel(0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32), metadata)
    if sample.empty:
        model.factors[:] = 0
        return model
    y = sample["label"].to_numpy(np.float64)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(p / (1 - p)))
    parts = []
    for at in range(0, len(y), 256):
        some = sample.iloc[at : at + 256]
        edge, f, x = features(pa.array(some["text"], pa.string()), [some[m].to_numpy(np.float64, na_value=np.nan) for m in metadata])
        parts.append((np.diff(edge), f.astype(np.int32), x))
    size, feature, value = (np.concatenate(p) for p in zip(*parts))
    first = np.concatenate([[0], np.cumsum(size)])
    g_linear, g_factors, g_bias = np.full(n, 1e-2), np.full((n, RANK), 1e-2), 1e-2
    for _ in range(max(rounds, min(100, -(-LEAST_STEPS * batch // len(y))))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            size = np.diff(first)[rows]
            k = B.ragged(first[:-1][rows], size)
            f, x = feature[k], value[k].astype(np.float64)
            edge = np.concatenate([[0], np.cumsum(size)])
            row = B.row_of(edge)
            v = model.factors[f] * x[:, None]
            total = B.sums(v, edge)
            z = model.bias + B.sums(model.linear[f] * x, edge) + 0.5 * (total**2 - B.sums(v * v, edge)).sum(axis=1)
            err = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
            each = err[row] * x
            used, slot = np.unique(f, return_inverse=True)
            d_linear = np.bincount(slot, each) + 1e-6 * model.linear[used]
            d_pairs = each[:, None] * (total[row] - v)
            d_factors = np.stack([np.bincount(slot, d_pairs[:, j]) for j in range(RANK)], axis=1) + 1e-6 * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += err.sum() ** 2
            model.linear[used] -= 4 * rate * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
            model.bias -= rate * err.sum() / np.sqrt(g_bias)
    return model


def fit_quality(messages: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), sample: int = SAMPLE, message_id: str = "message_id", text: str = "text", quality: str = "quality") -> QualityModel:
    """Fit a factorisation machine to labelled messages.

    Features are hashed words, statistics of the text's structure (shares of
    capitals, digits, marks, repeated words and lines, lengths) and the numeric
    ``metadata`` columns. It learns from ``labels (message_id, quality 0/1)``
    on at most ``sample`` rows of whole texts, which come to the driver.
    """
    extra = {m: F.col(m).cast("double") for m in metadata}
    return fit(labelled_sample(messages, labels, sample, message_id, text, quality, extra), metadata)


def _scores(model: QualityModel, b: pa.RecordBatch, text: str) -> np.ndarray:
    meta = [b.column(m).to_numpy(zero_copy_only=False).astype(np.float64) for m in model.metadata]
    return 1 / (1 + np.exp(-model.logits(*features(b.column(text), meta))))


def score_quality(messages: DataFrame, model: QualityModel, message_id: str = "message_id", text: str = "text") -> DataFrame:
    """``message_id`` and ``score`` (0 to 1, higher for better quality) of every whole text.

    One row per input row, without a shuffle. A null text is empty and has a
    score too, as has a null metadata value (taken as 0). Other columns are
    ignored.
    """
    m = narrow(messages, _id=message_id, _text=text, **{c: c for c in model.metadata})
    kind = m.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(_scores(model, b, "_text"))], names=["_id", "score"])

    out = m.mapInArrow(B.tidy(run), T.StructType([T.StructField("_id", kind), T.StructField("score", T.DoubleType())]))
    return out.withColumnRenamed("_id", message_id)


def keep_quality(messages: DataFrame, model: QualityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``messages`` that score ``least`` or more, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, text, 1 << 20):
            yield b.filter(pa.array(_scores(model, b, text) >= least))

    return messages.mapInArrow(B.tidy(run), messages.schema)
