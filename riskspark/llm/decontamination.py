"""Benchmark decontamination by Wu-Manber multi-pattern search.

A benchmark item's windows are its runs of ten consecutive words (all its words if it has
fewer). Documents and windows are brought to one form, words between single blanks, so that a
window occurs as words exactly where its bytes ` w1 .. wk ` occur.

Windows are searched together. Of each, the last ``m`` bytes count first (``m``: the shortest
window's length). A block shift table tells for every block of up to eight bytes how far the
search may move on until a window could end: blocks that stand in no window move it by ``m``
less a block. Where the shift is zero, the hash of a longer suffix selects the bucket of windows
that may end there, and direct comparison of whole windows confirms them. A text is
searched by many cursors at once, each over a segment of end positions, in numpy.

Windows of very different lengths would shorten each other's shifts, so they are searched by
class of length. Windows are a query set against all documents: they are dealt by hash into
parts of bounded size, each sent to every task for a pass of its own; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, byte_texts

#: Words of a window.
WORDS = 10
#: Bytes of windows (with 64 for each as overhead) that one pass sends to every task, on average.
PART_BYTES = 32_000_000
#: Least lengths of the classes of windows, in bytes.
CLASSES = (3, 16, 32)
#: Fixed value: bytes that separate words; letters, digits and all beyond ASCII make them.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
FORM = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b < 91 else b for b in range(256))
#: End positions that one cursor covers, bytes of text searched at a time, entries of a shift table by its windows.
SEGMENT, STEP, SPREAD = 2048, 4_000_000, 8
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longest shift.
FARTHEST = 1024
#: Blank room before a text, so that blocks and suffixes can be read at any end position.
ROOM = 16


def words_in(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.translate(FORM).split()


def windows_of(items: DataFrame, id_col: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(item, gram) of every window of every item, as often as it occurs there."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), byte_texts(batch.column("text")), strict=True):
                parts = words_in(raw)
                for first in range(0, max(1, len(parts) - words + 1) if parts else 0, 1024):
                    starts = range(first, min(first + 1024, max(1, len(parts) - words + 1)))
                    grams = [b" " + b" ".join(parts[i : i + words]) + b" " for i in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(grams), pa.string()), pa.array(grams, pa.binary())], names=["item", "gram"])

    return own.mapInArrow(run, "item string, gram binary")


@dataclass
class Patterns:
    """Windows of one class of length with their shift table and suffix buckets."""

    grams: list[bytes]
    #: Places of the windows in the part.
    place: np.ndarray
    shortest: int
    block: int
    shift: np.ndarray
    drop: np.uint64
    #: Lengths and first eight bytes (zero if there are fewer) of the windows.
    size: np.ndarray
    head: np.ndarray
    #: Suffix hashes in order, and the windows in that order.
    suffixes: np.ndarray
    order: np.ndarray

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * ODD) >> self.drop).astype(np.int64)


def _loaded(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each of the places ``at`` as a number; ``words`` are the aligned ones."""
    i, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    low = words[i] >> bits
    return low | (words[i + 1] << (np.uint64(63) - bits)) << np.uint64(1)


def _suffix(words: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Hash of the last ``length`` bytes (16 at most) up to the places ``end``."""
    near = _loaded(words, end - 7)
    if length < 8:
        return (near >> np.uint64(64 - 8 * length)) * ODD
    far = _loaded(words, end - 15) >> np.uint64(64 - 8 * (length - 8)) if length > 8 else np.zeros(len(end), np.uint64)
    near = near * ODD
    return (near ^ (near >> np.uint64(29)) ^ far) * ODD


def _padded(raw: bytes) -> np.ndarray:
    """Bytes after ``ROOM`` line ends, as aligned numbers with one to spare."""
    return np.frombuffer(b"\n" * ROOM + raw + b"\n" * (16 - len(raw) % 8), "<u8")


def prepared(grams: list[bytes], place: np.ndarray) -> Patterns:
    """Shift table and buckets of windows."""
    shortest = min(map(len, grams))
    block, reach = min(8, shortest), min(16, shortest)
    size = np.array(list(map(len, grams)), np.int64)
    head = np.array([int.from_bytes(g[:8], "little") if len(g) >= 8 else 0 for g in grams], np.uint64)
    words = _padded(b"".join(g[-shortest:] for g in grams))
    ends = ROOM + np.arange(1, len(grams) + 1, dtype=np.int64) * shortest - 1
    farthest = min(shortest - block + 1, FARTHEST)
    bits = min(22, max(10, (len(grams) * farthest * SPREAD).bit_length()))
    none = np.zeros(0, np.int64)
    out = Patterns(grams, place, shortest, block, np.full(1 << bits, farthest, np.uint16), np.uint64(64 - bits), size, head, none.astype(np.uint64), none)
    for back in range(farthest - 1, -1, -1):  # the least shift of a block is written last
        out.shift[out.slot(_loaded(words, ends - back - 7) >> np.uint64(64 - 8 * block))] = back
    hashes = _suffix(words, ends, reach)
    out.order = np.argsort(hashes, kind="stable")
    out.suffixes = hashes[out.order]
    return out


def _candidates(p: Patterns, words: np.ndarray, size: int) -> np.ndarray:
    """End positions at which the shift is zero."""
    found = []
    at = np.arange(ROOM + p.shortest - 1, ROOM + size, SEGMENT, dtype=np.int64)
    end = np.minimum(at + SEGMENT, ROOM + size)
    while len(at):
        shift = p.shift[p.slot(_loaded(words, at - 7) >> np.uint64(64 - 8 * p.block))].astype(np.int64)
        zero = shift == 0
        if zero.any():
            found.append(at[zero])
        at = at + np.maximum(shift, 1)
        within = at < end
        if not within.all():
            at, end = at[within], end[within]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(p: Patterns, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(end position, window) of every occurrence in ``raw``."""
    words = _padded(raw)
    ends = _candidates(p, words, len(raw))
    if not len(ends):
        return ends, ends
    hashes = _suffix(words, ends, min(16, p.shortest))
    lo, hi = np.searchsorted(p.suffixes, hashes, "left"), np.searchsorted(p.suffixes, hashes, "right")
    some = hi > lo
    ends, lo, hi = ends[some], lo[some], hi[some]
    out_end, out_gram = [], []
    for i in range(0, len(ends), 65_536):
        n = (hi - lo)[i : i + 65_536]
        which = np.repeat(np.arange(len(n)), n)
        gram = p.order[np.repeat(lo[i : i + 65_536] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        end = ends[i : i + 65_536][which]
        start = end + 1 - p.size[gram]
        alike = start >= ROOM
        alike[alike] = (p.head[gram[alike]] == 0) | (_loaded(words, start[alike]) == p.head[gram[alike]])
        for s, e, g in zip((start[alike] - ROOM).tolist(), (end[alike] - ROOM).tolist(), gram[alike].tolist(), strict=True):
            if raw.startswith(p.grams[g], s):
                out_end.append(e)
                out_gram.append(g)
    return np.array(out_end, np.int64), np.array(out_gram, np.int64)


class Part:
    """The windows of one pass."""

    def __init__(self, rows: list) -> None:
        self.items = [[x for x in r["items"] if x is not None] for r in rows]
        grams = [bytes(r["gram"]) for r in rows]
        lengths = np.array(list(map(len, grams)), np.int64)
        of = np.searchsorted(CLASSES, lengths, "right")
        self.patterns = [prepared([grams[i] for i in some], some) for c in range(1, len(CLASSES) + 1) if len(some := np.flatnonzero(of == c))]

    def found(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        """(first words, ends, items) of the stretches of words that occurrences cover, per text."""
        joined = [b" " + b" ".join(t) + b" " for t in texts]
        raw = b"\n".join(joined)
        last = np.cumsum(np.array([len(j) + 1 for j in joined], np.int64)) - 1
        ends, grams, sizes = [], [], []
        for p in self.patterns:
            e, g = occurrences(p, raw)
            ends.append(e)
            grams.append(p.place[g])
            sizes.append(np.array([len(p.grams[i]) for i in g.tolist()], np.int64))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), []) for _ in texts]
        if not any(map(len, ends)):
            return out
        end, gram, size = (np.concatenate(x) for x in (ends, grams, sizes))
        blank = np.cumsum(np.frombuffer(raw, np.uint8) == 32)
        row = np.searchsorted(last, end)
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(texts) + 1))
        for i in np.unique(row).tolist():
            some = order[bounds[i] : bounds[i + 1]]
            before = blank[last[i - 1]] if i else 0
            # the k-th blank of a text stands before its word k, counted from 1
            first, stop = blank[end[some] - size[some] + 1] - before - 1, blank[end[some]] - before - 1
            first, stop = _apart(first, stop)
            out[i] = first, stop, sorted({x for g in np.unique(gram[some]).tolist() for x in self.items[g]})
        return out


FOUND = {"n_words": "bigint", "first": "array<bigint>", "stop": "array<bigint>", "items": "array<string>"}


def hits(rows: DataFrame, part: list) -> DataFrame:
    """``rows`` (row, id, text) with their words, the stretches that windows cover and their items for the text."""
    sent = rows.sparkSession.sparkContext.broadcast(part)
    ready: list[Part] = []

    def result(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = ready[0].found(texts)
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
        n_words, items = pa.array(list(map(len, texts)), pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), n_words, *lists, items], names=["row", "id", *FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(Part(sent.value))
        for batch in batches:
            texts, size, first = [], 0, 0
            for i, raw in enumerate(byte_texts(batch.column("text"))):
                texts.append(words_in(raw))
                size += len(raw)
                if size > STEP or i == batch.num_rows - 1:
                    yield result(batch.slice(first, i + 1 - first), texts)
                    texts, size, first = [], 0, i + 1

    return rows.mapInArrow(run, rows.select("row", "id", *[F.lit(None).cast(kind).alias(name) for name, kind in FOUND.items()]).schema)


def _apart(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that don't meet, with the words of those given."""
    if not len(first):
        return first, stop
    at = np.lexsort((stop, first))
    first, stop = first[at], np.maximum.accumulate(stop[at])
    cut = np.flatnonzero(np.r_[True, first[1:] > stop[:-1]])
    return first[cut], stop[np.r_[cut[1:] - 1, len(stop) - 1]]


def _merged(passes: list[DataFrame]) -> DataFrame:
    """Stretches and items of several passes as one; only rows that a pass hits are sent."""
    none = F.array().cast("array<bigint>")
    hit = [p.where(F.size("first") > 0).select("row", "first", "stop", "items") for p in passes]
    every = hit[0]
    for more in hit[1:]:
        every = every.unionByName(more)
    whole = every.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("first", "stop", "items")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_apart(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(batch.column("first").to_pylist(), batch.column("stop").to_pylist(), strict=True)]
            lists = [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *lists, pa.array([sorted(set(x)) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))], names=["row", "first", "stop", "items"])

    joined = passes[0].select("row", "id", "n_words").join(whole.mapInArrow(run, whole.schema), "row", "left")
    return joined.select("row", "id", "n_words", *[F.coalesce(c, none.cast(FOUND[c])).alias(c) for c in ("first", "stop", "items")])


def contaminated(docs: DataFrame, items: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, hit_first, hit_stop, items) of every row of ``docs``.

    ``hit_first`` and ``hit_stop`` are the stretches of words that lie in an occurrence of a
    window (from 0, end exclusive, in order, apart); ``items`` the distinct ids, as strings in code
    point order, of the items with such windows. Null texts have no words, on either side.
    Items without words have no windows; an item with a null id covers words but isn't listed.
    Equal rows stay separate, items of equal id count once. Without items nothing is hit; an
    empty table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    grams = keep(windows_of(items, item_col, item_text, words).distinct(), "windows")
    total = grams.agg(F.sum(F.length("gram") + F.coalesce(F.length("item"), F.lit(0)) + 64)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    dealt = grams.withColumn("part", F.pmod(F.xxhash64("gram", "item"), F.lit(parts)))
    found = []
    for i in range(parts):
        # a part's windows, bounded, which every task gets for its pass
        part = dealt.where(F.col("part") == i).groupBy("gram").agg(F.collect_list("item").alias("items")).collect()
        found.append(hits(rows, part) if parts == 1 else keep(hits(rows, part), f"pass-{i}"))
    whole = found[0] if parts == 1 else _merged(found)
    return whole.select(F.col("id").alias(id_col), "n_words", F.col("first").alias("hit_first"), F.col("stop").alias("hit_stop"), "items")
