"""Line dedup by a deletion-neighbourhood join: within one edit, the earliest line stays.

Two lines are alike if at most one character is inserted, deleted or replaced. Deleting each
character in turn gives a line's neighbourhood; as hashed keys,

* equal (variant, position) of two lines of equal length: one character replaced;
* a variant equal to a whole line: one character inserted.

A key's lines differ only in one character, so their number is bounded by the alphabet, and the
earliest of them is found by one window without making pairs. All lines of a neighbourhood that
are not the earliest are verified by edit distance before they go.

Only lines that can have a neighbour emit variants. Two lines within one edit share the first
or the second half (of the shorter one), so a first join on (length, half) finds them, and tells
in which half and at what lengths the edit can lie; no other variants are needed.

A line goes if an equal one or one within the bound stands earlier: by document id, then by
row, then by line. Whole lines and whole texts are hashed, in numpy over a batch at a time with
two polynomial hashes modulo 2^64 over mixed code points, from which all variants of a line
follow by one multiplication each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, byte_texts, sent_if_small

#: Odd bases of the two hashes and the constants that mix code points.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Code points hashed at a time; a longer line is a step of its own.
STEP = 1_000_000

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        known = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, inverse))
        _POWERS[base] = known
    return known


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[salt])
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX[1 - salt])
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of one array of code points, counted from its own start."""

    def __init__(self, codes: np.ndarray, salt: int) -> None:
        self.power, self.inverse = _powers(BASES[salt], len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes, salt) * self.power[: len(codes)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def without(self, start: int, end: int, at: np.ndarray) -> np.ndarray:
        """Of start..end without the character at each of ``at``."""
        return (self.total[at] - self.total[start]) * self.inverse[start] + (self.total[end] - self.total[at + 1]) * self.inverse[start + 1]


def keyed(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of several numbers."""
    out = np.array([0x165667B19E3779F9], np.uint64)
    for p in parts:
        out = (out ^ np.atleast_1d(p).astype(np.uint64)) * np.uint64(BASES[0])
        out = out ^ (out >> np.uint64(31))
    return out


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _line_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of the lines that hold a word."""
    cuts = np.flatnonzero(codes == 10)
    starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(codes)]
    words = np.r_[0, np.cumsum((codes != 32) & ((codes < 9) | (codes > 13)))]
    number = np.flatnonzero(words[ends] > words[starts])
    return number, starts[number], ends[number]


def halves(hashes: Hashes, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Keys of both halves for the own length as the shorter one, and for one less.

    A pair whose shorter line has n characters shares the first n // 2 or the last n - n // 2.
    """
    out = []
    for n in (lengths, np.maximum(lengths - 1, 0)):
        first = n // 2
        out.append(keyed(n, 1, hashes.of(starts, starts + first)))
        out.append(keyed(n, 2, hashes.of(starts + lengths - (n - first), starts + lengths)))
    return out


#: Columns of the lines: place, length, two hashes of the whole, keys of the halves.
LINES = "row bigint, line bigint, len bigint, x bigint, y bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint"


def steps(rows: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, row, number, start, end) of the lines of some texts at a time."""
    held: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if held and (i == len(texts) or size + len(texts[i]) > STEP):
            codes = [_codes(texts[k]) for k in held]
            lines = np.array([1 + np.count_nonzero(c == 10) for c in codes])
            joined = np.concatenate([x for c in codes for x in (c, np.array([10], np.uint32))][:-1])
            number, start, end = _line_bounds(joined)
            first = np.r_[0, np.cumsum(lines)]
            text = np.searchsorted(first, number, "right") - 1
            yield joined, np.array([rows[k] for k in held], np.int64)[text], number - first[text], start, end
            held, size = [], 0
        if i < len(texts):
            held.append(i)
            size += len(texts[i])


def _batch(ids: pa.Array, columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    signed = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, signed)], names=["id", *(f.split()[0] for f in schema.split(", "))])


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line with a word of ``docs`` (row, id, text): place, length, identity, keys of halves."""
    schema = docs.select("id").schema
    for field in LINES.split(", "):
        schema = schema.add(field.split()[0], "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for codes, place, number, start, end in steps(list(range(len(rows))), byte_texts(batch.column("text"))):
                if len(number):
                    a, b = (Hashes(codes, s) for s in (0, 1))
                    row = np.array(rows, np.int64)[place]
                    yield _batch(batch.column("id").take(pa.array(place)), [row, number, end - start, a.of(start, end), b.of(start, end), *halves(a, start, end - start)], LINES)

    return docs.select("row", "id", "text").mapInArrow(run, schema)


#: Columns of the keys: ``whole`` marks the line itself among variants of longer ones.
VARIANTS = "key bigint, whole boolean, x bigint, y bigint"


def variants_of(docs: DataFrame) -> DataFrame:
    """Hashed keys of the neighbourhoods of some lines.

    ``docs`` (row, text, wanted): ``wanted`` lists (line, half, equal, longer): the half that the
    line may differ in, whether to look for one replaced and for one inserted character.
    """

    def of_line(h: Hashes, start: int, end: int, half: int, equal: bool, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        n = end - start
        # the halves of the shorter line, so with one character more at the middle
        at = np.arange(start, min(end, start + n // 2 + 1)) if half == 1 else np.arange(max(start, start + n // 2 - 1), end)
        variant = h.without(start, end, at)
        replaced = keyed(n, at - start, variant) if equal else np.zeros(0, np.uint64)
        inserted = keyed(n - 1, np.uint64(0xFFFFFFFF), np.r_[variant]) if longer else np.zeros(0, np.uint64)
        own = keyed(np.array([n]), np.uint64(0xFFFFFFFF), h.of(np.array([start]), np.array([end]))) if longer else np.zeros(0, np.uint64)
        return np.concatenate([replaced, np.unique(inserted), own]), np.r_[np.zeros(len(replaced) + len(np.unique(inserted)), bool), np.ones(len(own), bool)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, text in zip(batch.column("wanted").to_pylist(), byte_texts(batch.column("text")), strict=True):
                codes = _codes(text)
                cuts = np.flatnonzero(codes == 10)
                starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(codes)]
                for w in wanted:
                    s, e = int(starts[w["line"]]), int(ends[w["line"]])
                    line = codes[s:e]
                    a, b = (Hashes(line, k) for k in (0, 1))
                    key, whole = of_line(a, 0, e - s, w["half"], w["equal"], w["longer"])
                    x, y = (h.of(np.array([0]), np.array([e - s]))[0] for h in (a, b))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole), pa.array(np.full(len(key), x).view(np.int64)), pa.array(np.full(len(key), y).view(np.int64))], names=[f.split()[0] for f in VARIANTS.split(", ")])

    return docs.select("row", "text", "wanted").mapInArrow(run, VARIANTS)


def neighbours(docs: DataFrame, distinct: DataFrame, keep: Keep) -> DataFrame:
    """(x, y) of the distinct lines with a verified neighbour that stands earlier."""
    each = distinct.select("x", "y", "len", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key"))
    shared = each.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("len").alias("short"), F.max("len").alias("long")).where("lo != hi")
    shared = shared.select("key", (F.col("short") != F.col("long")).alias("mixed"), (F.col("short") == F.col("long")).alias("even"))
    shared = sent_if_small(keep(shared, "shared-halves"), F.lit(3))
    half = (F.col("which") % 2).alias("shared_half")
    met = each.join(shared, "key").groupBy("x", "y", half).agg(F.bool_or("mixed").alias("longer"))
    # what shares the first half (0) differs in the second (2), and the other way about
    asked = met.select("x", "y", F.when(F.col("shared_half") == 0, 2).otherwise(1).alias("half"), F.lit(True).alias("equal"), "longer")
    asked = keep(asked.join(distinct.select("x", "y", "first"), ["x", "y"]), "asked")
    wanted = asked.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "half", "equal", "longer")).alias("wanted"))
    wanted = sent_if_small(keep(wanted, "wanted"), 4 * F.size("wanted"))
    rows = variants_of(docs.select("row", "text").join(wanted, "row")).distinct().join(asked.select("x", "y", "first").distinct(), ["x", "y"])
    same = Window.partitionBy("key")
    # replaced characters: all of a key are alike; inserted: each with the whole line of that key
    own = F.max("whole").over(same)
    least = F.when(~own, F.min("first").over(same)).when(F.col("whole"), F.min(F.when(~F.col("whole"), F.col("first"))).over(same)).otherwise(F.min(F.when(F.col("whole"), F.col("first"))).over(same))
    found = rows.withColumn("earlier", least).where("earlier < first").select("x", "y", "first", "earlier").distinct()
    found = keep(found, "found")
    places = found.select(F.explode(F.array("first", "earlier")).alias("p")).distinct().groupBy("p.row").agg(F.collect_list("p.line").alias("ask"))
    places = sent_if_small(keep(places, "places"), 1 + F.size("ask"))
    texts = docs.select("row", "text").join(places, "row").select("row", F.explode(F.arrays_zip("ask", F.transform("ask", lambda n: F.get(F.split("text", "\n"), n.cast("int"))))).alias("l")).select("row", F.col("l.ask").alias("line"), F.col("l.1").alias("text"))
    texts = keep(texts, "texts")
    left, right = (texts.select(F.col("row").alias(f"{s}_row"), F.col("line").alias(f"{s}_line"), F.col("text").alias(f"{s}_text")) for s in "ab")
    both = found.join(left, (F.col("first.row") == F.col("a_row")) & (F.col("first.line") == F.col("a_line"))).join(right, (F.col("earlier.row") == F.col("b_row")) & (F.col("earlier.line") == F.col("b_line")))
    return both.where(F.levenshtein("a_text", "b_text", 1) >= 0).select("x", "y").distinct()


def deduplicated(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lines taken out of their texts, and ``n_lines`` and ``n_dropped`` (lines with a word).

    Null texts stay null and empty ones empty; lines without a word stay where they are. Rows
    with equal ids stand in the order in which they are read; a null id stands last. An empty
    table gives an empty result. Other columns are carried along; those added replace columns
    of the same name.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols if c != text]).alias("doc"), F.col(text).cast("string").alias("text"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    whole = keep(whole, "whole")
    lines = keep(lines_of(whole), "lines")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row", "line")
    distinct = lines.withColumn("first", first).groupBy("x", "y").agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("len", "k0", "k1", "k2", "k3")])
    distinct = keep(distinct, "distinct")
    late = neighbours(whole, distinct, keep).withColumn("late", F.lit(True))
    winners = distinct.join(late, ["x", "y"], "left").where("late is null").select(F.col("first.row").alias("row"), F.col("first.line").alias("line"), F.lit(True).alias("stays"))
    gone = lines.select("row", "line").join(winners, ["row", "line"], "left").where("stays is null")
    drops = sent_if_small(keep(gone.groupBy("row").agg(F.collect_list("line").alias("drop")), "drops"), 1 + F.size("drop"))
    changed = whole.join(drops, "row", "left").select("doc", "text", "drop")
    counts = [F.lit(0).cast("bigint").alias(c) for c in ("n_lines", "n_dropped")]
    out = changed.mapInArrow(_without_lines, changed.select("doc", "text", *counts).schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in cols], "n_lines", "n_dropped")


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, drops = batch.column("text").to_pylist(), batch.column("drop").to_pylist()
        n_lines = [sum(not x.isspace() and x != b"" for x in t.split(b"\n")) for t in byte_texts(batch.column("text"))]
        for i, drop in enumerate(drops):
            if drop:
                gone = set(drop)
                texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in gone)
        counts = [pa.array(n_lines, pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string()), *counts], names=["doc", "text", "n_lines", "n_dropped"])


def remaining(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines; documents that had lines and lost all of them go.

    All columns but the text stay as they are, whatever their names.
    """
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")
    out = deduplicated(docs.select(others, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), keep, "id", "text")
    stays = out.where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return stays.select(*[F.col("text").alias(c) if c == text else F.col(f"_doc.`{c}`") for c in docs.columns])
