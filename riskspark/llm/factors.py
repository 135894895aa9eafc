"""Text quality by a factorisation machine.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

Features are hashed words (their share of the text), statistics of its structure and its
metadata that follow from the text (length, lines), each as one of a few bins. Every pair of
features interacts through factors of low rank; by the sum-of-squares identity above a score
takes time linear in the features. Trained in numpy on a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, byte_texts, fold_of, hash_sample, labelled, word_hashes

#: Hash buckets of words, bins of each statistic, rank of the factors.
BUCKETS, BINS, RANK = 1 << 13, 12, 8
#: Bound of the sample that is fitted on.
SAMPLE = 6_000
EPOCHS, BATCH, RATE, SHRINK, SEED = 12, 256, 0.02, 1e-5, 5

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"()-"])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]"])
STATISTICS = 12


def _bin(share: float) -> int:
    """Bins of a share: none, then doubling from 1/1024, up to all."""
    return 0 if share <= 0 else int(np.clip(BINS - 1 + np.floor(np.log2(min(share, 1.0))), 1, BINS - 1))


def _size_bin(n: float) -> int:
    return int(min(BINS - 1, np.log2(n + 1) * BINS / 18))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value): words with their share, then a bin of each statistic with value 1."""
    words, times = np.unique(word_hashes(text, BUCKETS), return_counts=True)
    share = times / max(1, times.sum())
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    tokens = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size, visible = max(1, len(text)), max(1, int(count[~_SPACE].sum()))
    bins = [
        _bin(count[_UPPER].sum() / visible),
        _bin(count[_DIGIT].sum() / visible),
        _bin(count[_STOP].sum() / visible),
        _bin(count[_SYMBOL].sum() / visible),
        _bin(count[33] / visible),
        _bin(count[128:].sum() / size),
        _bin(1 - len(set(tokens)) / max(1, len(tokens))),
        _bin(1 - len(set(lines)) / max(1, len(lines))),
        _bin(float((share**2).sum())),
        _size_bin(len(text)),
        _size_bin(len(lines)),
        min(BINS - 1, int(visible / max(1, len(tokens)))),
    ]
    at = BUCKETS + np.arange(STATISTICS) * BINS + np.array(bins)
    # shares are small; this scale puts a text's words on a par with one statistic
    return np.r_[words, at], np.r_[share * 8, np.ones(STATISTICS)]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, feature: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts given one after the other, and their sums of factors."""
        terms = self.factors[feature] * value[:, None]
        sums = np.add.reduceat(terms, starts, axis=0)
        squares = np.add.reduceat((terms**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[feature] * value, starts) + ((sums**2).sum(axis=1) - squares) / 2, sums

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            out[i] = self.raw(*features(text), np.zeros(1, np.int64))[0][0]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by Adam over shuffled batches; deterministic."""
    rng = np.random.default_rng(SEED)
    n = BUCKETS + STATISTICS * BINS
    parts = [np.zeros(1), np.zeros(n), rng.normal(0, 0.05, (n, RANK))]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            feature, value = (np.concatenate([rows[i][x] for i in own]) for x in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in own])
            machine = Machine(float(parts[0][0]), parts[1], parts[2])
            raw, sums = machine.raw(feature, value, np.r_[0, np.cumsum(sizes)[:-1]])
            wrong = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[own]) / len(own)
            each = np.repeat(wrong, sizes) * value
            slope_v = np.zeros_like(parts[2])
            np.add.at(slope_v, feature, each[:, None] * (np.repeat(sums, sizes, axis=0) - parts[2][feature] * value[:, None]))
            slopes = [np.array([wrong.sum()]), np.bincount(feature, each, n) + SHRINK * parts[1], slope_v + SHRINK * parts[2]]
            step += 1
            for p, m, s, g in zip(parts, means, squares, slopes, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g**2 - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(parts[0][0]), parts[1], parts[2])


def _sampled(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in byte_texts(batch.column("text"))]
            lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], names=["label", "feature", "value"])

    return texts.select("label", "text").mapInArrow(run, "label int, feature array<int>, value array<float>")


def fit(docs: DataFrame, labels: DataFrame, keep: Keep, id_col: str, text: str, label: str, folds: int, held_out: int) -> Machine | None:
    """A machine learnt from the labels outside the held-out fold; None without any."""
    known = hash_sample(labelled(docs, labels, label, id_col, folds, held_out), id_col, SAMPLE).withColumn("label", F.col("label").cast("int"))
    known = keep(known, "labelled")
    texts = docs.select(id_col, F.col(text).cast("string").alias("text")).join(known, id_col)
    rows = keep(_sampled(texts), "sample").orderBy(F.xxhash64("feature", "value", "label")).limit(SAMPLE).collect()
    if not rows:
        return None
    return train([(np.array(r.feature), np.array(r.value)) for r in rows], np.array([r.label for r in rows], np.float64))


def quality(docs: DataFrame, labels: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Null texts count as empty, and empty ones score by their statistics. Null ids are in no
    fold and are never learnt from. Labels given twice count as 1 if one of them is. Without
    labels every score is 0.5. An empty table gives an empty result; extra columns are ignored
    and nothing but the text enters a score.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    model = own.sparkSession.sparkContext.broadcast(fit(docs, labels, keep, id_col, text, label, folds, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            scores = model.value.scores(texts) if model.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    scored = own.mapInArrow(run, own.drop("text").withColumn("score", F.lit(0.0)).schema)
    held = F.coalesce(fold_of("id", folds) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
