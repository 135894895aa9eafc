"""SimHash near-duplicates through Golay-code keys.

A fingerprint has 64 bits; two link at 4 or fewer differing bits. Its bits are cut into three
segments A, B, C (22, 21, 21 bits), each padded with zeros to a word of the binary Golay code
(23, 12, 7). Every 23-bit word lies within 3 bits of exactly one codeword; the codewords within
4 bits number 1 (if that one is at most 2 bits away) or 6. Two words that differ in at most
2 bits have a codeword within 4 bits of both, as the word halfway between them lies within
3 bits of one. So "codewords within 4" (G: 5.3 keys on average) always share a key up to
2 errors, and "the segment itself" (E: one key) without errors.

Pigeonhole over the errors (a, b, c) of the segments, a + b + c <= 4:

* a segment without errors: of the other two one has at most 2, so some E x G key is shared
  (6 patterns, 32 keys);
* else all have errors and two of them exactly one, so each of those two has a half without
  error: G of one segment x a half of either other (3 x 4 patterns, 64 keys).

About 96 keys of 33 bits per *distinct* fingerprint, so random meetings stay rare up to very
many documents. Every meeting is verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, by_group, byte_texts, components, runs

#: Generator of the binary Golay code (23, 12, 7) and its lengths.
GENERATOR = 0b110001110101
LENGTH, CHECKS, REACH = 23, 11, 4
#: Bits that may differ, and the segments as (first bit, bits).
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared in one task; more are dealt out in pairs of blocks.
BLOCK = 65_536
#: Bits of the sieve through which the keys of more than two fingerprints are found again.
SIEVE_BITS = 1 << 26
#: Cells of a comparison at a time.
CELLS = 4_000_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, A-Z lower-cased; a shorter text is one run."""
    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without words."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16_384):
        part = hashes[i : i + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` without ``text`` and with ``fp``, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    out = docs.drop(text).withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in byte_texts(batch.column(text))), np.uint64, batch.num_rows)
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    return docs.mapInArrow(run, out)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << (bit - CHECKS), left)
    return left


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 or less that have it, -1 as filler.

    Those of weight 4 only where the lightest has weight 3: elsewhere no codeword is that near.
    """
    one = _syndromes(1 << np.arange(LENGTH))
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]

    def add(first: int, error: int, syndrome: int, weight: int) -> None:
        found[syndrome].append(error)
        if weight < REACH:
            for bit in range(first, LENGTH):
                add(bit + 1, error | 1 << bit, syndrome ^ int(one[bit]), weight + 1)

    add(0, 0, 0, 0)
    table = np.full((1 << CHECKS, max(map(len, found))), -1, np.int64)
    for syndrome, errors in enumerate(found):
        table[syndrome, : len(errors)] = errors
    return table


_PATTERNS: list[np.ndarray] = []


def nearby_codewords(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each segment; -1 as filler."""
    if not _PATTERNS:
        _PATTERNS.append(_patterns())
    errors = _PATTERNS[0][_syndromes(segments)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> CHECKS)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fps``) of every key of every fingerprint; the pattern is in the top bits."""
    bits = fps.view(np.uint64)
    segments = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [nearby_codewords(s) for s in segments]
    keys, rows, pattern = [], [], 0

    def emit(index: np.ndarray, rest: np.ndarray) -> None:
        """``rest``: up to 43 bits beside the 12 of the codeword's index."""
        nonlocal pattern
        at = np.nonzero(index >= 0)
        keys.append(np.int64(pattern) << 56 | rest[at[0]] << 12 | index[at])
        rows.append(at[0])
        pattern += 1

    for x in range(3):
        for y in range(3):
            if x != y:
                emit(near[y], segments[x])
    for x in range(3):
        y, z = (s for s in range(3) if s != x)
        for low_y in (True, False):
            for low_z in (True, False):
                half_y = segments[y] & 0x3FF if low_y else segments[y] >> 10
                half_z = segments[z] & 0x3FF if low_z else segments[z] >> 10
                emit(near[x], half_y << 12 | half_z)
    return np.concatenate(keys), np.concatenate(rows)


def _cell(key: Column) -> Column:
    """A key's cell of the sieve, as :func:`_cells` has it."""
    folded = key.bitwiseXOR(F.shiftrightunsigned(key, 26)).bitwiseXOR(F.shiftrightunsigned(key, 47))
    return folded.bitwiseAND(F.lit(SIEVE_BITS - 1))


def _cells(keys: np.ndarray) -> np.ndarray:
    unsigned = keys.view(np.uint64)
    return (unsigned ^ unsigned >> np.uint64(26) ^ unsigned >> np.uint64(47)) & np.uint64(SIEVE_BITS - 1)


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the cell of each of ``keys`` is set.

    It only spares the shuffle of rows whose key isn't asked for; others may pass as well.
    """
    cell = _cell(F.col("key"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[[w.word for w in words]] = [w.bits for w in words]
    return out.view(np.uint64)


def _keys(fps: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(key, fp) of every key, or of those that pass the sieve ``asked``."""
    sieve = None if asked is None else fps.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                keys, rows = keys_of(values[i : i + 4096])
                if sieve is not None:
                    cells = _cells(keys)
                    passed = np.flatnonzero(sieve.value[cells >> np.uint64(6)] >> (cells & np.uint64(63)) & np.uint64(1))
                    keys, rows = keys[passed], rows[passed]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[i : i + 4096][rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= MAX_BITS


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join exactly what all links among ``fps`` (distinct) join: a spanning forest.

    Breadth first: those reached are compared only with those not reached yet, so a crowd
    around one fingerprint costs about one comparison each.
    """
    out: list[tuple[int, int]] = []
    left = np.sort(fps)
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            step = max(1, CELLS // len(left))
            part, frontier = frontier[:step], frontier[step:]
            reached = _near(part, left).any(axis=0)
            if reached.any():
                out.extend((int(root), int(x)) for x in left[reached])
                frontier = np.concatenate([frontier, left[reached]])
                left = left[~reached]
    return out


def _forests(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["key", "i", "j"]):
            key = np.stack([group.column(c).to_numpy() for c in ("key", "i", "j")])
            fps = group.column("fp").to_numpy()
            changed = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
            starts, lengths = runs(np.cumsum(changed))
            links = {x for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for x in forest(fps[s : s + n])}
            pairs = np.array(sorted(links), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, keep: Keep) -> DataFrame:
    """(a, b): links between distinct fingerprints that reach whatever all links reach.

    A key with two fingerprints is their pair. One with more goes to one task up to ``BLOCK``
    fingerprints, beyond that in pairs of blocks, so no pair is left out and no task grows.
    """
    shared = _keys(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    shared = keep(shared, "shared-keys")
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    crowds = shared.where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = _keys(fps, _sieve(crowds)).join(crowds, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return pairs.union(_forests(rows)).distinct()


def groups(fingerprinted: DataFrame, keep: Keep, rank: str) -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest ``rank`` that its links reach.

    ``rank`` is a column or struct of ``fingerprinted``; nulls rank last.
    """
    fps = keep(fingerprinted.groupBy("fp").agg(F.min(rank).alias("first")), "fingerprints")
    roots = components(links(fps, keep), keep, "roots")
    member = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = keep(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    return member.join(least, "root").select("fp", F.col("least").alias("first"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    Null and empty texts and those without a word have fingerprint zero and link like any
    other. Rows with equal ids are separate rows; a null id is never a component's id unless
    all its rows have none. An empty table gives an empty result. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    rows = keep(with_fingerprints(own, "text", words), "documents")
    first = groups(rows, keep, "id")
    return rows.join(first, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))
