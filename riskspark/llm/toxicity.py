"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; all other documents are unlabelled, toxic ones among
them. With the share of positives (class prior) the risk of a classifier is estimated from both:

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

Without the maximum the second part could become negative by overfitting; where it does, a step
climbs it back. The classifier is linear in the presence of hashed words and is trained in numpy
on samples of bounded size; which words are used is counted over the samples in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, byte_texts, fold_of, hash_sample, labelled, word_hashes

#: Hash buckets of words, words used, and the least number of positives that hold one.
BUCKETS, FEATURES, MIN_POSITIVES = 1 << 18, 1024, 3
#: Standard errors by which a word must be more frequent among positives to be used.
MIN_SPREAD = 4.0
#: Bounds of the samples that are fitted on: positive and unlabelled documents.
POSITIVES, UNLABELLED = 3_000, 9_000
#: Largest class prior, so that the unlabelled side keeps at least half of the risk.
MAX_PRIOR = 0.5
STEPS, RATE, SHRINK = 400, 0.1, 1e-4


@dataclass
class Model:
    #: Position of each bucket's word among the weights, -1 if unused.
    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            used = self.slot[word_hashes(text, BUCKETS)]
            out[i] += self.weights[np.unique(used[used >= 0])].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def nonnegative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the estimate, by Adam over the whole samples."""
    at = np.zeros(positive.shape[1] + 1)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, STEPS + 1):
        p, u = positive @ at[:-1] + at[-1], unlabelled @ at[:-1] + at[-1]
        rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        to_one, p_zero, u_zero = -sigmoid(-p) / len(p), sigmoid(p) / len(p), sigmoid(u) / len(u)
        if rest >= 0:
            gp, gu = prior * (to_one - p_zero), u_zero
        else:
            gp, gu = prior * p_zero, -u_zero
        slope = np.r_[positive.T @ gp + unlabelled.T @ gu + SHRINK * at[:-1], gp.sum() + gu.sum()]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:-1], float(at[-1])


def _features(texts: DataFrame) -> DataFrame:
    """(positive, words) of (id, positive, text), one row per id and side.

    Of several texts under one id the one with the smallest hash counts, so an id with any
    share of the rows is one document of the sample.
    """
    hashed = texts.select("id", "positive", F.xxhash64("text").alias("pick"), "text")
    shape = hashed.drop("text").withColumn("words", F.lit(None).cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(word_hashes(t, BUCKETS)) for t in byte_texts(batch.column("text"))]
            kept = [batch.column(c) for c in ("id", "positive", "pick")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], names=["id", "positive", "pick", "words"])

    one = hashed.mapInArrow(run, shape).groupBy("id", "positive").agg(F.min(F.struct("pick", "words")).alias("first"))
    return one.select("positive", "first.words")


def fit(docs: DataFrame, labels: DataFrame, keep: Keep, id_col: str, text: str, label: str, folds: int, held_out: int) -> Model | None:
    """A model learnt from the labels outside the held-out fold; None without positives.

    The class prior is the share of positives among the labelled documents, taken for a
    random sample of all, and is at most ``MAX_PRIOR``. Labels that name little but positives
    overstate it: scores then come out too high, though toxic texts still score highest.
    """
    known = keep(labelled(docs, labels, label, id_col, folds, held_out), "labelled")
    total, toxic = known.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    if not toxic:
        return None
    prior = min(toxic / total, MAX_PRIOR)
    positives = hash_sample(known.where("label = 1").select(id_col), id_col, POSITIVES).withColumn("positive", F.lit(True))
    others = hash_sample(docs.select(id_col).distinct(), id_col, UNLABELLED).withColumn("positive", F.lit(False))
    asked = keep(positives.unionByName(others), "asked")
    texts = docs.select(id_col, F.col(text).cast("string").alias("text")).join(asked, id_col)
    sample = keep(_features(texts.select(F.col(id_col).alias("id"), "positive", "text")), "sample")
    counts = sample.groupBy("positive").count().collect()
    n = {r.positive: r["count"] for r in counts}
    if not n.get(True) or not n.get(False):
        return None
    in_positive, in_other = (F.count_if(F.col("positive") == x) for x in (True, False))
    word = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(in_positive.alias("p"), in_other.alias("u"))
    p, u = F.col("p") / n[True], F.col("u") / n[False]
    spread = F.sqrt((p + u) / 2 * (1 - (p + u) / 2) * (1 / n[True] + 1 / n[False])) + 1e-9
    chosen = word.where(F.col("p") >= min(MIN_POSITIVES, n[True])).where((p - u) / spread >= MIN_SPREAD).orderBy(((p - u) / spread).desc(), "word").limit(FEATURES)
    words = np.array([r.word for r in chosen.select("word").collect()], np.int64)
    slot = np.full(BUCKETS, -1, np.int64)
    slot[words] = np.arange(len(words))
    # at most FEATURES numbers of POSITIVES + UNLABELLED documents reach the driver
    used = sample.select("positive", F.array_intersect("words", F.array(*map(F.lit, words.tolist())).cast("array<bigint>")).alias("w"))
    matrix = {True: np.zeros((n[True], len(words)), np.float32), False: np.zeros((n[False], len(words)), np.float32)}
    at = {True: 0, False: 0}
    for row in used.toLocalIterator():
        matrix[row.positive][at[row.positive], slot[row.w]] = 1
        at[row.positive] += 1
    return Model(slot, *nonnegative_pu(matrix[True], matrix[False], prior))


def toxicity(docs: DataFrame, labels: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts score like a text without any of the words. Null ids are in no fold
    and are never learnt from. Labels given twice count as 1 if one of them is. Without
    confirmed positives every score is 0. An empty table gives an empty result; extra columns
    are ignored and nothing but the text enters a score.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    model = own.sparkSession.sparkContext.broadcast(fit(docs, labels, keep, id_col, text, label, folds, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            scores = model.value.scores(texts) if model.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    scored = own.mapInArrow(run, own.drop("text").withColumn("score", F.lit(0.0)).schema)
    held = F.coalesce(fold_of("id", folds) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
