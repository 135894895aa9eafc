"""Shared pieces of the corpus operators.

Every operator takes any DataFrame with the columns it names and ignores others. Null texts
count as empty. Rows with equal ids are separate rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import keeper

#: Fixed value: what separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows in one Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 512

Keep = Callable[[DataFrame, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeping(spark: SparkSession, name: str) -> Keep:
    """``keep(df, step)`` writes a step to the shared folder and reads it back."""
    small_batches(spark)
    return keeper(spark, name)


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most ``BATCH_ROWS`` texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Numbers that a table may hold to be sent to every task instead of shuffling texts to it.
SENT_NUMBERS = 2_000_000


def sent_if_small(small: DataFrame, numbers: Column) -> DataFrame:
    """``small`` with a broadcast hint if its rows' ``numbers`` add up to the bound at most."""
    total = small.agg(F.sum(numbers)).first()[0] or 0
    return F.broadcast(small) if total <= SENT_NUMBERS else small


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by ``keys``, several small ones at a time.

    The caller bounds the rows of a group; at most one group and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(changed)
        if held and any(batch.column(k)[0] != held[-1].column(k)[-1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame, keep: Keep, name: str) -> DataFrame:
    """(node, root) of every linked node: the smallest node that its links reach.

    ``links`` holds pairs (a, b) of longs in any order, repeats allowed. Large-star and
    small-star rounds, each written to the shared folder; only a count and a checksum per
    round reach the driver. The joins are plain equality joins, so a node with very many
    links is split by adaptive execution.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    edges, before, round_ = keep(edges, f"{name}-0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before, round_ = tuple(now), round_ + 1
        both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = keep(small.select(F.col("e.u").alias("hi"), F.col("e.m").alias("lo")).where("hi > lo").distinct(), f"{name}-{round_}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; one empty string if it has none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), rf"[{SPACE}]+")


def count_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(words_of(text))).cast("bigint")


_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+")


def word_hashes(text: bytes, buckets: int) -> np.ndarray:
    """crc32 of every run of letters, A-Z lower-cased, modulo ``buckets``."""
    words = _WORDS.findall(text.lower())
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, folds: int, held_out: int) -> DataFrame:
    """Distinct (id, label) of the labelled rows that may be learnt from."""
    known = labels.where((fold_of(id_col, folds) != held_out) & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    return known.join(docs.select(id_col).distinct(), id_col, "left_semi")


def hash_sample(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` first of ``ids`` in a hashed order: a sample of bounded size."""
    return ids.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col).limit(rows)
