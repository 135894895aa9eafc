"""Byte-level BPE encoding and decoding.

A text is cut into words by a pattern. A word starts as its bytes, and the adjacent pair of the
lowest rank (the leftmost of equals) is merged until no pair has a rank. Only *distinct* words
are folded: a task numbers the words it meets, folds all new ones of a batch together in numpy,
one merge in every word per round, and puts the documents' ids together by their words' numbers.
No text leaves its row, so there is no shuffle at all.

:func:`fold_words` is the same fold as Spark higher-order functions, for tables of distinct
words. Encoding whole corpora through it needs the words' ids joined back to every occurrence;
README.md has the figures why :func:`encode` doesn't.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import let

#: Distinct words a task remembers before it starts anew (a cache; results don't depend on it).
REMEMBER = 400_000
#: Longer words are merged one at a time through a heap.
LONG_WORD = 256
#: More than any token id, and the rank of a pair that doesn't merge.
SHIFT, NEVER = 20, 1 << 40


class Ranks:
    """A rank file: one token (base64) and its rank per line. The files hold some 50,000 lines."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ids.values()) + 1)
        for piece, rank in self.ids.items():
            self.pieces[rank] = piece
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for piece, rank in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is the merged token's id; ``NEVER`` if they don't merge."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each has."""
        known = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        parts = [(np.flatnonzero(known >= 0), known[known >= 0])]
        rest = np.flatnonzero(known < 0).tolist()
        short = [i for i in rest if 0 < len(words[i]) <= LONG_WORD]
        for i in (i for i in rest if len(words[i]) > LONG_WORD):
            ids = self._fold_long(words[i])
            parts.append((np.full(len(ids), i), ids))
        if short:
            word, ids = self._fold_all([words[i] for i in short])
            parts.append((np.array(short)[word], ids))
        word, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _fold_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of all tokens, those of a word in order."""
        lengths = np.array([len(w) for w in words])
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(ids), NEVER, np.int64)  # of a token and the next one
        rank[:-1] = np.where(word[:-1] == word[1:], self.merged(ids[:-1], ids[1:]), NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank, starts)
            live = best < NEVER
            if not live.all():
                over = np.repeat(~live, sizes)
                done.append((word[over], ids[over]))
                ids, word, rank, starts, sizes, best = ids[~over], word[~over], rank[~over], None, sizes[live], best[live]
                if not len(ids):
                    break
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]  # the leftmost of each word
            ids[at] = best
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one token went before each later one
            ids, word, rank = ids[stay], word[stay], rank[stay]
            for changed in (at, at[at > 0] - 1):
                follow = np.minimum(changed + 1, len(ids) - 1)
                same = (follow > changed) & (word[follow] == word[changed])
                rank[changed] = np.where(same, self.merged(ids[changed], ids[follow]), NEVER)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return word, ids

    def _fold_long(self, word: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive = [True] * len(ids)
        pair = lambda i: self.pairs.get(ids[i] << SHIFT | ids[after[i]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids) - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], alive[gone], after[i] = rank, False, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int64)


class _Numbers(dict):
    """Numbers words as they come; new ones are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Token ids of many texts, folding each distinct word once."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBER:
            self._forget()
        number = self.numbers.__getitem__
        words = [np.fromiter(map(number, found), np.int64, len(found)) for found in map(self.split, texts)]
        new, self.numbers.new = self.numbers.new, []
        if new:
            ids, sizes = self.ranks.fold([w.encode("utf-8", "surrogatepass") for w in new])
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        return [self._gather(w) for w in words]

    def _gather(self, words: np.ndarray) -> np.ndarray:
        start, sizes = self.starts[words], self.starts[words + 1] - self.starts[words]
        shift = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text``, in place of it.

    Null and empty texts have no ids. Special tokens are ordinary text. Every row is encoded
    for itself, so repeated rows and ids need no rule; an empty table gives an empty result.
    A column ``ids`` of ``docs`` is replaced. The rank file is of fixed size and is sent along.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(path))
    rest = [c for c in docs.columns if c not in (text, "ids")]
    whole = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = whole.drop("_text").withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            ids = encoder.encode(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], _lists(ids, pa.int32())], names=[*rest, "ids"])

    return whole.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the bytes of ``ids``: the tokens' pieces one after the other.

    Null ids count as none and give no bytes. An id outside the rank file is an error.
    """
    ranks = rows.sparkSession.sparkContext.broadcast(Ranks(path).pieces)
    rest = [c for c in rows.columns if c != out]
    schema = rows.select(*rest).withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = ranks.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(piece, x or ())) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.binary())], names=[*rest, out])

    return rows.select(*rest).mapInArrow(run, schema)


def fold_words(words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """``words`` with ``ids``: the fold as higher-order functions over a literal rank map.

    Pieces are hex strings, and ranks lie in a literal array of small maps by hash, as looking
    up a map's key takes time in proportion to its size.
    """
    buckets = 8192
    filled: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in Ranks(path).ids.items():
        filled[zlib.crc32(piece.hex().encode()) % buckets][piece.hex()] = rank
    # one literal, which the optimiser reads once
    table = F.from_json(F.lit(json.dumps(filled)), "array<map<string,int>>")

    def rank_of(piece: Column) -> Column:
        return F.try_element_at(F.get(table, (F.crc32(piece.cast("binary")) % buckets).cast("int")), piece)

    def merge(pieces: Column) -> Column:
        ranked = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.struct(rank_of(F.concat(F.get(pieces, i), p)).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull()))
        joined = lambda b: F.concat(F.slice(pieces, F.lit(1), b["i"]), F.array(F.concat(F.get(pieces, b["i"]), F.get(pieces, b["i"] + 1))), F.slice(pieces, b["i"] + 3, F.size(pieces)))
        return let(best, lambda b: F.when(b["i"].isNull(), pieces).otherwise(joined(b)))

    hexed = F.regexp_extract_all(F.lower(F.hex(F.col(word).cast("binary"))), F.lit(".."), F.lit(0))
    pieces = let(hexed, lambda h: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1))), h, lambda a, _: merge(a)))
    return words.withColumn("ids", F.transform(pieces, rank_of))
