"""Spelling variants by a trie of letter counts.

A word's letters fall into groups; its vector counts the letters of each group. One edit changes
the vector little: an insertion adds one letter to a group (a surplus), a deletion takes one (a
deficit), a replacement does both or, within a group, neither. Words are arranged in a
trie by successive counts, and a search for a word's neighbours goes down depth first with a
budget of one surplus and one deficit. Words in the leaves that it reaches are verified.

The trie's top levels, the length and the first counts, are a key by which words are dealt to
tasks: a word is stored under its own key and asks under each key that the budget reaches,
with what is left of it. Of two words of equal length the one with its surplus in the earlier
group asks, of two of different length the shorter one; so pairs are found once. The
words under a key that is large are dealt out in blocks, each with a trie of its own that
all who ask under the key go down, so that nothing is left out and no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, by_group, let, runs, text_of

#: Letters, least length and occurrences of a word, and the rule of the simulated slips.
LETTER = "A-Za-z\\u00C0-\\u00FF"
LENGTH, OCCURRENCES, SLIP = 7, 2, 31
#: How many times more frequent a form is than its variants.
TIMES = 10
#: Letter groups (by code point), and those among them that stand in the key.
GROUPS, TOP = 12, 5
#: Letters of the words under a key that one task arranges in a trie, and of those that it searches for.
STORED_LETTERS, ASKING_LETTERS = 1 << 20, 1 << 23
#: Rows of several keys that are arranged in one trie.
TOGETHER = 1 << 16
#: Searches under way, and letters compared, at a time.
UNDER_WAY, CELLS = 1 << 18, 4_000_000
#: Numbers of steps that follow forms, each twice as far: more than a chain of tenfold counts can have.
DOUBLINGS = 5


def occurring(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of all texts, with a letter lost where the rule says so.

    Counted in each task before anything is sent. Runs that cannot give a long enough word are
    not even extracted.
    """
    found = F.regexp_extract_all(text_of(text), F.lit(f"[{LETTER}]{{{LENGTH},}}"), F.lit(0))
    runs_ = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs_ = runs_.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")))
    runs_ = runs_.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs_.select(F.when(F.col("h") % SLIP == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of some words in a row, and the words' lengths."""
    joined = "".join(column.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x groups) counts, and the lengths."""
    codes, lengths = _code_points(column)
    word = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(word * GROUPS + codes % GROUPS, minlength=len(lengths) * GROUPS).reshape(-1, GROUPS), lengths


def _keys(lengths: np.ndarray, top: np.ndarray) -> np.ndarray:
    key = lengths.astype(np.uint64)
    for g in range(TOP):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ top[:, g].astype(np.uint64)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


#: Key and length of the words asked for, what is left of the budget below the key, whether the word that asks is shorter.
ROWS = "key bigint, size bigint, surplus int, deficit int, longer boolean, word string, n bigint"
#: Stands in ``surplus`` of a stored word.
STORED = -1


def dealt(words: DataFrame) -> DataFrame:
    """Each word (word, n) under its own key, and under all keys that its budget reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vector, lengths = counts(batch.column("word"))
            top = vector[:, :TOP]

            def rows(some: np.ndarray, change: dict[int, int], surplus: int, deficit: int, longer: bool) -> pa.RecordBatch:
                moved = top[some].copy()
                for g, by in change.items():
                    moved[:, g] += by
                n = len(some)
                at = pa.array(some)
                return pa.RecordBatch.from_arrays(
                    [pa.array(_keys(lengths[some] + longer, moved)), pa.array(lengths[some] + longer), pa.array(np.full(n, surplus, np.int32)), pa.array(np.full(n, deficit, np.int32)), pa.array(np.full(n, longer)), batch.column("word").take(at), batch.column("n").take(at)],
                    names=[c.split()[0] for c in ROWS.split(", ")],
                )

            every = np.arange(len(lengths))
            yield rows(every, {}, STORED, 0, False)
            yield rows(every, {}, 1, 1, False)
            yield rows(every, {}, 1, 0, True)
            for g in range(TOP):
                yield rows(every, {g: 1}, 0, 0, True)
                yield rows(every, {g: 1}, 0, 1, False)
                for later in range(g + 1, TOP):
                    some = np.flatnonzero(top[:, later] > 0)
                    yield rows(some, {g: 1, later: -1}, 0, 0, False)

    return words.select("word", "n").mapInArrow(run, ROWS)


class Trie:
    """Vectors (words x levels) arranged by successive counts. The first level is the key's number."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.lexsort(vectors.T[::-1])
        ordered = vectors[self.order]
        #: Of each level its nodes, as the node above with the count.
        self.levels: list[np.ndarray] = []
        above = np.zeros(len(ordered), np.int64)
        for g in range(ordered.shape[1]):
            packed = above << 32 | ordered[:, g]
            starts, sizes = runs(packed)
            self.levels.append(packed[starts])
            above = np.repeat(np.arange(len(starts)), sizes)
        self.first, self.size = runs(above)

    def leaves(self, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(search, leaf, whether nothing was spent of a whole budget) of all leaves that the searches reach.

        Depth first, searches at the same level together; too many at a time are divided. The deficit comes after the surplus.
        """
        n = len(vectors)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), surplus.astype(np.int8), deficit.astype(np.int8))]
        while stack:
            level, who, node, more, less = stack.pop()
            if len(who) > UNDER_WAY:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, more, less))) for part in (slice(half), slice(half, None))]
            elif level == len(self.levels):
                even = more == less  # else a letter is missing
                yield who[even], node[even], more[even] == 1
            elif len(who):
                nodes, asked = self.levels[level], node << 32 | vectors[who, level]
                ways = []
                for by in (0, 1, -1) if level else (0,):
                    can = np.ones(len(who), bool) if by == 0 else more > 0 if by == 1 else (more == 0) & (less > 0) & (vectors[who, level] > 0)
                    some = np.flatnonzero(can)
                    at = np.searchsorted(nodes, asked[some] + by)
                    there = nodes[np.minimum(at, len(nodes) - 1)] == asked[some] + by
                    some, at = some[there], at[there]
                    ways.append((who[some], at, more[some] - (by == 1), less[some] - (by == -1)))
                stack.append((level + 1, *(np.concatenate([w[k] for w in ways]) for k in range(4))))


def _matrix(words: pa.Array) -> np.ndarray:
    """Letters of words of equal length, one word a row."""
    return _code_points(words)[0].reshape(len(words), -1)


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replacement, or the right by one insertion if it is longer."""
    n = left.shape[1]
    if right.shape[1] == n:
        return (left != right).sum(axis=1) == 1
    same = lambda equal: np.where(equal.all(axis=1), n, np.argmin(equal, axis=1))
    return same(left == right[:, :n]) + same((left == right[:, 1:])[:, ::-1]) >= n


def _before(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of letters stand before others of the same length, in code point order."""
    row, at = np.arange(len(left)), np.argmax(left != right, axis=1)
    return left[row, at] < right[row, at]


def found(stored: pa.Table, asking: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place among ``asking``, place among ``stored``) of the verified pairs under equal keys (``group``)."""
    if not len(stored) or not len(asking):
        return
    words = [t.column("word").combine_chunks() for t in (asking, stored)]
    vectors = [np.c_[t.column("group").to_numpy(), counts(w)[0][:, TOP:]].astype(np.int64) for t, w in zip((asking, stored), words, strict=True)]
    trie = Trie(vectors[1])
    left, right = map(_matrix, words)
    step = max(1, CELLS // right.shape[1])
    for who, leaf, unspent in trie.leaves(vectors[0], asking.column("surplus").to_numpy(), asking.column("deficit").to_numpy()):
        ends = np.cumsum(trie.size[leaf])
        for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
            i = np.arange(lo, min(lo + step, int(ends[-1])))
            k = np.searchsorted(ends, i, "right")
            a, b = who[k], trie.order[trie.first[leaf[k]] + i - (ends[k] - trie.size[leaf[k]])]
            good = one_edit(left[a], right[b])
            # words with equal counts both ask
            both = np.flatnonzero(good & unspent[k])
            if len(both):
                good[both] = _before(left[a[both]], right[b[both]])
            yield a[good], b[good]


NEAR = "word string, near string, near_n bigint"


def _searched(rows: DataFrame) -> DataFrame:
    """Both directions of every pair of near words, of rows that arrive sorted by key, length and blocks."""
    keys = ["key", "size", "i", "j"]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for table in by_group(batches, keys):
            if held and sum(map(len, held)) + len(table) > TOGETHER:
                yield pa.concat_tables(held)
                held = []
            held.append(table)
        if held:
            yield pa.concat_tables(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches):
            of = np.stack([table.column(c).to_numpy() for c in keys])
            group = np.cumsum(np.r_[False, (of[:, 1:] != of[:, :-1]).any(axis=0)])
            table = table.append_column("group", pa.array(group))
            size, surplus, longer = (table.column(c).to_numpy() for c in ("size", "surplus", "longer"))
            for length in np.unique(size).tolist():
                stored = table.take(np.flatnonzero((size == length) & (surplus == STORED)))
                for kind in (False, True):
                    asking = table.take(np.flatnonzero((size == length) & (surplus != STORED) & (longer == kind)))
                    for a, b in found(stored, asking):
                        one, other = asking.take(a), stored.take(b)
                        for x, y in ((one, other), (other, one)):
                            yield from pa.table([x.column("word"), y.column("word"), y.column("n")], names=["word", "near", "near_n"]).combine_chunks().to_batches(65_536)

    return rows.mapInArrow(run, NEAR)


def near_words(words: DataFrame, keep: Keep) -> DataFrame:
    """(word, near, near_n): every word beside each near one, of distinct words (word, n)."""
    rows = dealt(words)
    stored = F.col("surplus") == STORED
    letters = F.length("word").cast("bigint")
    sums = rows.groupBy("key", "size").agg(F.sum(F.when(stored, letters).otherwise(0)).alias("s"), F.sum(F.when(~stored, letters).otherwise(0)).alias("a"))
    large = sums.where((F.col("s") > STORED_LETTERS) | (F.col("a") > ASKING_LETTERS))
    # at most one row for a million letters of the rows
    large = keep(large.select("key", "size", F.ceil(F.greatest(F.col("s") / STORED_LETTERS, F.lit(1.0))).alias("parts"), F.ceil(F.greatest(F.col("a") / ASKING_LETTERS, F.lit(1.0))).alias("turns")), "large-keys")
    block = lambda n: F.pmod(F.xxhash64("word"), n).cast("bigint")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    blocks = rows.join(F.broadcast(large), ["key", "size"], "left").withColumns({c: F.coalesce(c, F.lit(1)).cast("bigint") for c in ("parts", "turns")})
    own, other = F.when(stored, block(F.col("parts"))).otherwise(block(F.col("turns"))), F.explode(F.when(stored, every(F.col("turns"))).otherwise(every(F.col("parts"))))
    blocks = blocks.withColumn("own", own).withColumn("other", other)
    i, j = F.when(stored, F.col("own")).otherwise(F.col("other")), F.when(stored, F.col("other")).otherwise(F.col("own"))
    blocks = blocks.select("key", "size", i.alias("i"), j.alias("j"), "surplus", "deficit", "longer", "word", "n")
    return _searched(blocks.repartition("key", "size", "i", "j").sortWithinPartitions("key", "size", "i", "j"))


def variants(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough.

    A word's near ones differ by exactly one inserted, deleted or replaced code point. Its form is
    the near word of largest n (in ties the first in code point order) if that is at least ten
    times its own, else null; its root the last word that forms lead to. Null texts have no words;
    a null id counts as empty text in the rule of slips. Equal rows count each. An empty table
    gives an empty result; extra columns are ignored.
    """
    words = keep(occurring(docs, id_col, text), "words")
    near = near_words(words, keep).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    enough = -F.col("best.m") >= TIMES * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    out = keep(out, "forms")
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for i in range(DOUBLINGS):
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = keep(roots.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{i}")
        if not roots.where("moved").limit(1).count():
            break
    return out.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
