"""Blocks of an index and their search.

A block holds some hundred to a thousand documents: its terms in order, for each its postings (document,
weight) and its largest weight. Documents with the same heaviest term stand together, so that
most blocks cannot reach a query's best results and are passed over by their largest weights.

A task keeps the k best documents of every query so far. It takes its blocks one after the other:
queries whose bound (sum of weight times largest weight) is below their k-th score skip the block; the
others add up their postings. Only k rows for each query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

#: Documents and postings of a block; a document with more postings is a block of its own.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 1 << 18
#: Cells and postings under way at a time.
CELLS = 1_000_000
#: Scores are ordered to this many decimals, so ties do not depend on summation order.
ORDER_DECIMALS = 9
_MARGIN = 1e-8


def block_schema(key: DataType) -> StructType:
    """(ids, terms, starts, docs, weights, tops): the postings of ``terms[i]`` stand from ``starts[i]``
    to ``starts[i + 1]``; ``docs`` are places among ``ids``."""
    kinds = {"ids": key, "terms": LongType(), "starts": IntegerType(), "docs": IntegerType(), "weights": DoubleType(), "tops": DoubleType()}
    return StructType([StructField(name, ArrayType(kind)) for name, kind in kinds.items()])


def packed(
    ids: pa.Array, first: np.ndarray, sizes: np.ndarray, turn: pa.Array, terms: np.ndarray, weights: np.ndarray, schema: pa.Schema, docs: int, postings: int
) -> pa.Table:
    """Blocks of documents in the order of ``turn``, with ``docs`` and ``postings`` at most; those of a document stand from ``first`` on."""
    place = turn.to_numpy()
    cuts, size = [0], 0
    for i, n in enumerate(sizes[place].tolist()):
        if i > cuts[-1] and (i - cuts[-1] >= docs or size + n > postings):
            cuts.append(i)
            size = 0
        size += n
    batches = []
    for lo, hi in zip(cuts, [*cuts[1:], len(place)], strict=True):
        if hi == lo:
            continue
        own = place[lo:hi]
        posting = stretches(first[own], sizes[own])
        order = np.argsort(terms[posting], kind="stable")  # documents of a term stay in order
        doc = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[own])[order]
        posting = posting[order]
        term, weight = terms[posting], weights[posting]
        new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        columns = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.take(turn.slice(lo, hi - lo)))]
        for values in (term[new], np.r_[new, len(term)].astype(np.int32), doc, weight, np.maximum.reduceat(weight, new)):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)))
        batches.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return pa.Table.from_batches(batches, schema)


@dataclass
class Asked:
    """Queries of one pass: numbers, and their terms and weights one after the other."""

    number: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    #: Distinct terms, and of each entry its place among them.
    terms: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Asked:
        flat = np.concatenate([np.zeros(0, np.int64), *(np.array(r.terms, np.int64) for r in rows)])
        terms, place = np.unique(flat, return_inverse=True)
        weight = np.concatenate([np.zeros(0), *(np.array(r.weights, np.float64) for r in rows)])
        return cls(np.array([r.number for r in rows], np.int64), np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows]), weight, terms, place)


class Best:
    """The k best of each query so far: scores (negative where there are fewer) and keys of documents."""

    def __init__(self, n: int, k: int, kind: np.dtype) -> None:
        self.score, self.doc = np.full((n, k), -1.0), np.zeros((n, k), kind)

    @property
    def least(self) -> np.ndarray:
        """What a document must reach; negative while there are fewer than k."""
        return self.score[:, -1]

    def add(self, number: np.ndarray, row: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Documents of the queries ``number``; ``row`` is a place among them."""
        k = self.score.shape[1]
        row = np.r_[np.repeat(np.arange(len(number)), k), row]
        score, doc = np.r_[self.score[number].ravel(), score], np.r_[self.doc[number].ravel(), doc]
        order = np.lexsort((doc, -score, row))
        row, score, doc = row[order], score[order], doc[order]
        first = np.searchsorted(row, np.arange(len(number)))
        some = np.arange(len(row)) - first[row] < k
        if doc.dtype != self.doc.dtype:  # longer strings than before
            self.doc = self.doc.astype(doc.dtype)
        self.score[number], self.doc[number] = score[some].reshape(-1, k), doc[some].reshape(-1, k)


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i].. of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def scan(block: dict[str, np.ndarray], asked: Asked, best: Best) -> None:
    """Adds a block's documents to the best of the queries that they can still change."""
    n, terms = len(block["ids"]), block["terms"]
    if not len(terms):
        return
    at = np.searchsorted(terms, asked.terms)
    there = terms[np.minimum(at, len(terms) - 1)] == asked.terms
    some = np.flatnonzero(there[asked.place])
    query, weight, term = asked.query[some], asked.weight[some], at[asked.place[some]]
    bound = np.bincount(query, weight * block["tops"][term], len(best.score))
    alive = (bound > 0) & (bound >= best.least - _MARGIN)
    some = np.flatnonzero(alive[query])
    query, weight, term = query[some], weight[some], term[some]
    if not len(query):
        return
    sizes = block["starts"][term + 1].astype(np.int64) - block["starts"][term]
    # whole queries, as many as fit into the cells and postings at a time
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    cost = np.cumsum(n + np.add.reduceat(sizes, first))
    turns = np.r_[first[np.flatnonzero(np.r_[True, np.diff(cost // CELLS) > 0])], len(query)]
    for lo, hi in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
        number, local = np.unique(query[lo:hi], return_inverse=True)
        posting = stretches(block["starts"][term[lo:hi]].astype(np.int64), sizes[lo:hi])
        cell = np.repeat(local * n, sizes[lo:hi]) + block["docs"][posting]
        scores = np.bincount(cell, np.repeat(weight[lo:hi], sizes[lo:hi]) * block["weights"][posting], len(number) * n).reshape(len(number), n)
        good = scores > np.maximum(best.least[number] - _MARGIN, 0)[:, None]
        k = best.score.shape[1]
        many = np.flatnonzero(good.sum(axis=1) > k)
        if len(many):
            kth = np.partition(scores[many], n - k, axis=1)[:, n - k]
            good[many] &= scores[many] >= (kth - _MARGIN)[:, None]
        row, doc = np.nonzero(good)
        score = np.round(scores[row, doc], ORDER_DECIMALS)
        some = score > 0
        if some.any():
            touched, row = np.unique(row[some], return_inverse=True)
            best.add(number[touched], row, score[some], block["ids"][doc[some]])


def _ids(column: pa.Array) -> np.ndarray:
    """Document keys as an array that sorts as Spark sorts them."""
    return np.array(column.to_pylist()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def best_of_pass(index: DataFrame, queries: list, k: int) -> DataFrame:
    """(number, text_id, similarity): the best ``k`` of each of some queries in each task's blocks.

    ``queries`` (number, terms, weights) are bounded by the caller; every task gets them.
    """
    sent = index.sparkSession.sparkContext.broadcast(Asked.of(queries))
    out = index.select(F.lit(0).cast("bigint").alias("number"), F.get("ids", F.lit(0)).alias("text_id"), F.lit(0.0).alias("similarity")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = sent.value, None
        for batch in batches:
            key = batch.column("ids").type.value_type
            for i in range(batch.num_rows):  # one block after the other, so a task may read any number of them
                block = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("terms", "starts", "docs", "weights", "tops")}
                block["ids"] = _ids(batch.column("ids")[i].values)
                best = best or Best(len(asked.number), k, block["ids"].dtype)
                scan(block, asked, best)
        if best is None:
            return
        query, place = np.nonzero(best.score > 0)
        for i in range(0, len(query), 65_536):
            at = query[i : i + 65_536], place[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(asked.number[at[0]]), pa.array(best.doc[at].tolist(), key), pa.array(best.score[at])], names=["number", "text_id", "similarity"])

    return index.mapInArrow(run, out)
