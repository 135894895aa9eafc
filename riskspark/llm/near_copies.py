"""SimHash near-duplicates by similarity: Golay keys from the fingerprint's margins.

:mod:`simhash` links fingerprints of 64 bits at 4 bits, as its query's contract fixes it. Two texts
with a shingle similarity of 0.8 differ in about 15% of the bits of any SimHash, so for a stated
similarity the fingerprint must be longer and must be decoded more softly. Here it has nine
segments of 23 bits, and of each bit the margin is kept: by how much the shingles that set it
outweigh those that don't, as one signed byte.

A segment is decoded to the nearby codewords of the binary Golay code (23, 12, 7): those six whose
bits agree best with the margins, so bits that hang in the balance count little. Pigeonhole over
the segments' errors: four tables hold three segments each, and copies need a common
codeword in all three segments of only one. Of a table's 216 triples of codewords the 32 that agree best
are its keys, 36 bits each, so unlike texts seldom meet, up to very many documents.

Classes (texts with equal fingerprints) that share a key are verified by their margins: as each
margin is a sum of independent signs over the distinct shingles, the cosine of two margin vectors estimates
the shingles in common, with the known numbers of shingles their Jaccard similarity, with a standard
error of 0.024 at 0.8. Pairs link from 0.76 on, so that one with 0.8 seldom fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import simhash as S
from riskspark.llm.common import Keep, by_group, byte_texts, components, runs, sent_if_small

WORDS = 5
#: Least estimated similarity of a link: 0.8 less what the estimate may be off.
LEAST = 0.76
SEGMENTS, TABLES = 9, ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6))
#: Codewords of a segment and keys of a table.
NEARBY, KEYS = 6, 32
MARGINS = SEGMENTS * S.LENGTH
#: A margin's byte for one standard deviation.
UNIT = 24.0
#: Odd numbers that give further bits of a shingle's hash.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Classes of one key that one task compares; more are dealt out in pairs of blocks.
BLOCK = 32_768
CELLS = 4_000_000


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX[salt])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1 - salt % 2])
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, A-Z lower-cased; a shorter text is one run."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(each) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(each))):
        out = (out + each[k : k + n]) * np.uint64(MIX[0])
    return np.unique(_mixed(out, 0))


def margins(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint's margins, as signed bytes."""
    total = np.zeros(-(-MARGINS // 64) * 64, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i : i + 255 * 64]
        bits = np.stack([_mixed(part + np.uint64(k), k % 4) for k in range(len(total) // 64)], axis=1).astype("<u8").view(np.uint8)
        bits = np.unpackbits(bits, axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    margin = (2 * total - len(hashes))[:MARGINS].astype(np.float64)
    norm = np.sqrt((margin**2).mean())
    return np.clip(np.rint(margin * (UNIT / norm)), -127, 127).astype(np.int8) if norm else np.zeros(MARGINS, np.int8)


def fingerprinted(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (row, id, text) with ``size`` (distinct shingles) and ``margins`` for the text."""
    out = rows.select("row", "id", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("margins")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t, words) for t in byte_texts(batch.column("text"))]
            found = [margins(h).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(list(map(len, hashes)), pa.int64()), pa.array(found, pa.binary())], names=["row", "id", "size", "margins"])

    return rows.mapInArrow(run, out)


_CODEWORDS: list[np.ndarray] = []


def codewords() -> np.ndarray:
    """Bits of all codewords as 1 and -1, one a row."""
    if not _CODEWORDS:
        index = np.arange(1 << (S.LENGTH - S.CHECKS)) << S.CHECKS
        bits = (index | S._syndromes(index))[:, None] >> np.arange(S.LENGTH) & 1
        _CODEWORDS.append((bits * 2 - 1).astype(np.float32))
    return _CODEWORDS[0]


def keys_of(vectors: np.ndarray) -> np.ndarray:
    """(vectors x keys): the keys of some margin vectors."""
    near, fit = [], []
    for s in range(SEGMENTS):
        score = vectors[:, s * S.LENGTH : (s + 1) * S.LENGTH].astype(np.float32) @ codewords().T
        index = np.argpartition(score, -NEARBY, axis=1)[:, -NEARBY:].astype(np.int64)
        near.append(index)
        fit.append(np.take_along_axis(score, index, 1))
    out = []
    for t, (a, b, c) in enumerate(TABLES):
        total = (fit[a][:, :, None, None] + fit[b][:, None, :, None] + fit[c][:, None, None, :]).reshape(len(vectors), -1)
        key = (near[a][:, :, None, None] << 24 | near[b][:, None, :, None] << 12 | near[c][:, None, None, :]).reshape(len(vectors), -1)
        best = np.argpartition(total, -KEYS, axis=1)[:, -KEYS:]
        out.append(t << 36 | np.take_along_axis(key, best, 1))
    return np.concatenate(out, axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, MARGINS)


def _keyed(classes: DataFrame) -> DataFrame:
    """Classes with their keys; one without shingles has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(_vectors(batch.column("margins")))
                lists = [k if n else [] for k, n in zip(keys, batch.column("size").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return classes.mapInArrow(run, classes.withColumn("keys", F.array().cast("array<bigint>")).schema)


def alike(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """(left x right): whether the estimated similarity is enough."""
    unit = [x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9) for x in (left.astype(np.float32), right.astype(np.float32))]
    a, b = left_size[:, None].astype(np.float32), right_size[None, :].astype(np.float32)
    common = np.minimum(unit[0] @ unit[1].T * np.sqrt(a * b), np.minimum(a, b))
    return common >= LEAST * (a + b - common)


def forest(ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links that join exactly what all links among some classes join.

    Breadth first: those reached are compared only with those not reached yet.
    """
    out: list[tuple[int, int]] = []
    left = np.argsort(ids)
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            step = max(1, CELLS // len(left))
            part, frontier = frontier[:step], frontier[step:]
            reached = alike(vectors[part], sizes[part], vectors[left], sizes[left]).any(axis=0)
            if reached.any():
                out.extend((int(ids[root]), int(x)) for x in ids[left[reached]])
                frontier = np.concatenate([frontier, left[reached]])
                left = left[~reached]
    return out


def _pairs(links: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(sorted(links), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _forests(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["key", "i", "j"]):
            key = np.stack([group.column(c).to_numpy() for c in ("key", "i", "j")])
            ids, sizes, vectors = group.column("class").to_numpy(), group.column("size").to_numpy(), _vectors(group.column("margins"))
            starts, lengths = runs(np.cumsum(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            yield _pairs({x for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for x in forest(ids[s : s + n], vectors[s : s + n], sizes[s : s + n])})

    return rows.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            if batch.num_rows:
                left, right = _vectors(batch.column("a_margins")), _vectors(batch.column("b_margins"))
                sizes = [batch.column(c).to_numpy() for c in ("a_size", "b_size")]
                good = [alike(left[i : i + 1], sizes[0][i : i + 1], right[i : i + 1], sizes[1][i : i + 1])[0, 0] for i in range(batch.num_rows)]
                ids = [batch.column(c).to_numpy() for c in "ab"]
                found = set(zip(ids[0][good].tolist(), ids[1][good].tolist(), strict=True))
            yield _pairs(found)

    return pairs.mapInArrow(run, "a bigint, b bigint")


def links(keyed: DataFrame, keep: Keep) -> DataFrame:
    """(a, b): verified links between classes (class, size, margins, keys) that reach what all reach.

    A key with two classes is a pair, verified once however many keys it shares. Keys with more
    go to one task each, in pairs of blocks if they are large; of keys with the same classes one does.
    """
    shared = keyed.select("class", F.explode("keys").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")
    )
    shared = keep(shared.where("n > 1"), "shared-keys")
    pairs = shared.where("n = 2").select("a", "b").distinct()
    for side in "ab":
        known = keyed.select(F.col("class").alias(side), F.col("size").alias(f"{side}_size"), F.col("margins").alias(f"{side}_margins"))
        pairs = pairs.join(known, side)
    crowds = shared.where("n > 2").groupBy("n", "a", "b", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    crowds = keep(crowds, "crowds")
    sieve = keyed.sparkSession.sparkContext.broadcast(S._sieve(crowds))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            row = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            key = keys.flatten().to_numpy(zero_copy_only=False)
            cells = S._cells(key)
            some = np.flatnonzero(sieve.value[cells >> np.uint64(6)] >> (cells & np.uint64(63)) & np.uint64(1))
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), *(batch.column(c).take(pa.array(row[part])) for c in ("class", "size", "margins"))], names=["key", "class", "size", "margins"])

    rows = keyed.select("class", "size", "margins", "keys").mapInArrow(asked, "key bigint, class bigint, size bigint, margins binary")
    rows = rows.join(crowds, "key").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "size", "margins")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class")
    return _verified(pairs).union(_forests(rows)).distinct()


def first_of_each(rows: DataFrame, keep: Keep) -> DataFrame:
    """(row, first): for each of ``rows`` (row, id, size, margins) the row of its group's smallest id.

    Null ids stand last, equal ones by row.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = rows.groupBy("size", "margins").agg(F.min(rank).alias("first")).withColumn("class", F.col("first.row"))
    keyed = keep(_keyed(classes), "keyed")
    roots = components(links(keyed, keep), keep, "roots")
    member = keyed.join(roots, keyed["class"] == roots["node"], "left").select("class", "first", "size", "margins", F.coalesce("root", "class").alias("root"))
    member = keep(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    known = member.join(least, "root").select("size", "margins", F.col("least.row").alias("first"))
    return rows.select("row", "size", "margins").join(known, ["size", "margins"]).select("row", "first")


def one_of_each(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, then the first written.

    Null and empty texts and those without a word are copies of each other and of nothing else.
    Repeated rows and rows of equal ids are rows of their own, of which one of a group stays. An
    empty table gives an empty result. All columns stay as they are, whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    whole = keep(packed.select("row", "doc"), "whole")
    own = whole.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text}`").cast("string").alias("text"))
    rows = keep(fingerprinted(own, words), "documents")
    # rows that go are fewer than those that stay, so that texts may stay in place
    gone = sent_if_small(keep(first_of_each(rows, keep).where("row != first").select("row"), "gone"), F.lit(1))
    return whole.join(gone, "row", "left_anti").select("doc.*")
