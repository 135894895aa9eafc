"""Occurrences of the n-grams of a corpus, and the documents that hold each.

Texts are counted in slices where they lie: n-grams become pairs of numbers, so that none is built more than once a slice.
A slice sends each of its n-grams once, in lists by bucket, and a bucket of bounded size adds them up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import ngrams, tokens

#: Words of a slice, at most (a longer text is a slice of its own), and bytes of texts for which there is a bucket more.
SLICE_WORDS, BUCKET_BYTES = 1 << 22, 4_000_000

_LISTS = "bucket int, ngram array<string>, occurrences array<bigint>, documents array<bigint>"
_COUNTS = "ngram string, occurrences bigint, documents bigint"


def _counted(key: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and in how many known documents; documents stand in order."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new)
    holds = (new | np.r_[True, doc[1:] != doc[:-1]]) & known[doc]
    return key[first], np.diff(np.r_[first, len(key)]), np.add.reduceat(holds.astype(np.int64), first)


def _by_bucket(bucket: np.ndarray, ngram: pa.Array, counts: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.r_[first, len(order)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, a) for a in (ngram.take(pa.array(order)), *(pa.array(c[order]) for c in counts))]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], names=["bucket", "ngram", "occurrences", "documents"])


def _of_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of (known, t), each row a document of its own; ``known`` says whether it counts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, known = batch.column("t"), batch.column("known").to_numpy(zero_copy_only=False)
            ends = words.offsets.to_numpy().astype(np.int64)
            lo = 0
            while lo < len(words):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_WORDS, side="right")) - 1)
                coded = words.values.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode()
                word, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                mark = np.array([zlib.crc32(w.encode()) for w in word.to_pylist()], np.int64)
                if len(code):
                    at, *counts = _counted(code, doc, known)
                    yield _by_bucket(mark[at] % buckets, word.take(pa.array(at)), counts)
                near = doc[1:] == doc[:-1]
                if near.any():
                    pair, *counts = _counted((code[:-1] * len(word) + code[1:])[near], doc[1:][near], known)
                    a, b = pair // len(word), pair % len(word)
                    joined = pc.binary_join_element_wise(word.take(pa.array(a)), word.take(pa.array(b)), " ")
                    yield _by_bucket((mark[a] * 31 + mark[b]) % buckets, joined, counts)
                lo = hi

    def total(table: pa.Table) -> pa.Table:
        names = ["ngram", "occurrences", "documents"]
        flat = [pa.chunked_array([c.flatten() for c in table.column(n).chunks], table.schema.field(n).type.value_type) for n in names]
        sums = pa.table(flat, names).group_by("ngram", use_threads=False).aggregate([(n, "sum") for n in names[1:]])
        return pa.table([sums.column(n) for n in ("ngram", "occurrences_sum", "documents_sum")], names)

    return rows.mapInArrow(run, _LISTS).groupBy("bucket").applyInArrow(total, _COUNTS)


def ngram_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(ngram, occurrences, documents): ``documents`` counts distinct keys, an empty one not.

    Rows with a key of their own are counted in slices. Others, where there are any, meet by n-gram and key.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    repeated = rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").select("doc")
    some = not repeated.isEmpty()
    buckets = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    once = rows.join(repeated, "doc", "left_anti") if some else rows
    counts = _of_rows(once.selectExpr("doc IS NOT NULL AS known", f"{tokens('text')} AS t"), buckets)
    if not some:
        return counts
    met = rows.join(repeated, "doc", "left_semi").selectExpr("doc", f"explode({ngrams('text')}) AS ngram").groupBy("ngram", "doc").agg(F.count(F.lit(1)).alias("occurrences"))
    every = counts.unionByName(met.selectExpr("ngram", "occurrences", "1L AS documents"))
    return every.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
