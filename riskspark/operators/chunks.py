"""Terms of a corpus counted and weighted in chunks of texts.

A chunk holds some hundred thousand postings, so that a Python worker needs little memory. What leaves it is its distinct terms, in stretches of the range of
hashes (buckets); a bucket adds up the chunks' counts and sends each chunk the totals of the terms that it
asked for, in the same order, so without the terms. Postings themselves are never shuffled: the texts are
smaller and are cut again where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.operators import blocks

_FREQUENCY = "chunk int, bucket int, h array<bigint>, total array<bigint>, df array<bigint>, n_postings array<bigint>, first array<boolean>, shared array<boolean>"
_TERMS = "term string, h bigint, df bigint, n_postings bigint, max_weight double"


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column one after the other, and the lengths of the lists."""
    lists = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in lists)])
    return pa.chunked_array([c.flatten() for c in lists], column.type.value_type).combine_chunks(), sizes


class _Postings:
    """Postings of a chunk in the order of terms: ``terms[i]`` has ``doc`` and ``tf`` from ``starts[i]`` on."""

    def __init__(self, texts: pa.Table) -> None:
        flat, sizes = _flat(texts.column("t"))
        flat = flat.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # stable, and documents arrive in order
        order = np.argsort(flat, kind="stable")
        term, doc = flat[order], doc[order]
        new_term = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        new = np.flatnonzero(new_term | np.r_[True, doc[1:] != doc[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.at = order[np.flatnonzero(new_term)]  # a place of each term among all
        del order, flat
        self.doc, self.tf = doc[new], np.diff(np.r_[new, len(term)])
        self.starts = np.flatnonzero(new_term[new])
        self.terms = term[new][self.starts]
        self.sizes = np.diff(np.r_[self.starts, len(new)])
        self.n_docs = len(sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else values

    def weights(self, df: np.ndarray, total: int) -> np.ndarray:
        """Of each posting, of vectors of length one."""
        idf = np.log((1 + total) / (1 + df)) + 1
        raw = (1 + np.log(self.tf)) * np.repeat(idf, self.sizes)
        return raw / np.sqrt(np.bincount(self.doc, raw * raw, self.n_docs))[self.doc]


def _bucket(terms: np.ndarray, bits: int) -> np.ndarray:
    return (terms >> (64 - bits)) + (1 << (bits - 1)) if bits else np.zeros(len(terms), np.int64)


def _stretches(terms: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of terms in order."""
    ends = np.searchsorted(_bucket(terms, bits), np.arange(1 << bits), side="right").tolist()
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if hi > lo]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *values]), kind))


def frequency(texts: DataFrame, bits: int) -> DataFrame:
    """Rows by chunk and bucket: totals of the chunk's terms, in order, whether it is the first chunk that has one, and
    whether others have it; rows of chunk -1 hold a bucket's terms as ``h`` and their totals as ``total``, columns of their own, so
    that they are read without the others. ``texts`` is (chunk, text_id, copies, t)."""

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        p = _Postings(table)
        n = p.sums(table.column("copies").to_numpy()[p.doc])
        found = _stretches(p.terms, bits)
        of = lambda a: _lists([a[lo:hi] for _, lo, hi in found], pa.int64())
        chunk = pa.array([key[0].as_py()] * len(found), pa.int32())
        return pa.table([chunk, pa.array([b for b, _, _ in found], pa.int32()), of(p.terms), of(n), of(p.sizes)], ["chunk", "bucket", "h", "n", "p"])

    def totals(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        flat, sizes = _flat(table.column("h"))
        terms, first, inverse, times = np.unique(flat.to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        add = lambda c: np.bincount(inverse, _flat(table.column(c))[0].to_numpy(), len(terms)).astype(np.int64)
        df, postings = add("n"), add("p")
        is_first = np.zeros(len(inverse), bool)
        is_first[first] = True
        cuts = np.cumsum(sizes)[:-1]
        # the terms stand in the first row, answers in the others
        own = lambda a: _lists([a, *[a[:0]] * len(sizes)], pa.int64())
        each = lambda a, kind: _lists([a[:0], *np.split(a, cuts)], kind)
        chunk = pa.array([-1, *table.column("chunk").to_pylist()], pa.int32())
        bucket = pa.array([key[0].as_py()] * len(chunk), pa.int32())
        columns = [chunk, bucket, own(terms), own(df), each(df[inverse], pa.int64()), each(postings[inverse], pa.int64())]
        columns += [each(is_first, pa.bool_()), each(times[inverse] > 1, pa.bool_())]
        return pa.table(columns, ["chunk", "bucket", "h", "total", "df", "n_postings", "first", "shared"])

    parts = texts.select("chunk", "text_id", "copies", "t").groupBy("chunk").applyInArrow(asked, "chunk int, bucket int, h array<bigint>, n array<bigint>, p array<bigint>")
    return parts.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(totals, _FREQUENCY)


def _answers(table: pa.Table, column: str) -> np.ndarray:
    return _flat(table.column(column))[0].to_numpy(zero_copy_only=False)


def packed(texts: DataFrame, answers: DataFrame, total: int, docs: int, postings: int) -> DataFrame:
    """Blocks (see :mod:`blocks`) of the texts that have a term, in each chunk in the order of their heaviest term."""
    schema = blocks.block_schema(texts.schema["text_id"].dataType)
    kind = to_arrow_schema(schema)

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Postings(left)
        weight = p.weights(_answers(right.sort_by("bucket"), "df"), total)
        by_doc = np.argsort(p.doc, kind="stable")
        doc, term, weight = p.doc[by_doc], np.repeat(p.terms, p.sizes)[by_doc], weight[by_doc]
        del p, by_doc
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(doc)])
        top = np.maximum.reduceat(weight, first) if len(doc) else weight
        places = np.flatnonzero(weight == np.repeat(top, sizes))
        lead = term[places[np.unique(doc[places], return_index=True)[1]]]
        ids = left.column("text_id").take(pa.array(doc[first])).combine_chunks()
        # documents with the same heaviest term stand together
        turn = pc.sort_indices(pa.table([pa.array(lead), ids], ["lead", "id"]), [("lead", "ascending"), ("id", "ascending")], null_placement="at_start")
        return blocks.packed(ids, first, sizes, turn, term, weight, kind, docs, postings)

    both = texts.select("chunk", "text_id", "t").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "df").groupBy("chunk"))
    return both.applyInArrow(weigh, schema)


def terms(texts: DataFrame, answers: DataFrame, total: int, bits: int) -> DataFrame:
    """(term, h, df, n_postings, max_weight). ``texts`` has the terms as ``g`` beside their hashes ``t``.

    A term of one chunk is done there; of the others each chunk sends the largest weight, the first one also the term.
    Both halves read one shuffle of the texts.
    """

    def of_chunk(left: pa.Table, right: pa.Table) -> tuple:
        right = right.sort_by("bucket")
        p, text = _Postings(left), _flat(left.column("g"))[0]
        first, shared, df, n = (_answers(right, c) for c in ("first", "shared", "df", "n_postings"))
        weight = p.weights(df, total)
        top = np.maximum.reduceat(weight, p.starts) if len(p.starts) else weight
        return p, text, first, shared, df, n, top

    def alone(left: pa.Table, right: pa.Table) -> pa.Table:
        p, text, _, shared, df, n, top = of_chunk(left, right)
        at = np.flatnonzero(~shared)
        return pa.table([text.take(pa.array(p.at[at])), *(pa.array(a[at]) for a in (p.terms, df, n, top))], list(names))

    def tops(left: pa.Table, right: pa.Table) -> pa.Table:
        p, text, first, shared, df, n, top = of_chunk(left, right)
        found = [(b, lo + np.flatnonzero(shared[lo:hi])) for b, lo, hi in _stretches(p.terms, bits)]
        own = [at[first[at]] for _, at in found]
        ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
        term = pa.ListArray.from_arrays(ends, text.take(pa.array(p.at[np.concatenate([np.zeros(0, np.int64), *own])])))
        lists = [_lists([a[at] for _, at in found], k) for a, k in ((p.terms, pa.int64()), (top, pa.float64()))]
        owned = [_lists([a[at] for at in own], pa.int64()) for a in (p.terms, df, n)]
        return pa.table([pa.array([b for b, _ in found], pa.int32()), *lists, term, *owned], ["bucket", "h", "top", "term", "own", "df", "n_postings"])

    def most(table: pa.Table) -> pa.Table:
        h, top, term, own, df, n = (_flat(table.column(c))[0] for c in ("h", "top", "term", "own", "df", "n_postings"))
        order = np.argsort(own.to_numpy())
        every, at = own.to_numpy()[order], pa.array(order)
        best = np.zeros(len(every))
        np.maximum.at(best, np.searchsorted(every, h.to_numpy()), top.to_numpy())
        return pa.table([term.take(at), pa.array(every), df.take(at), n.take(at), pa.array(best)], list(names))

    names = ("term", "h", "df", "n_postings", "max_weight")
    both = texts.select("chunk", "text_id", "t", "g").groupBy("chunk").cogroup(answers.drop("h", "total").groupBy("chunk"))
    sent = both.applyInArrow(tops, "bucket int, h array<bigint>, top array<double>, term array<string>, own array<bigint>, df array<bigint>, n_postings array<bigint>")
    shared = sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(most, _TERMS)
    return both.applyInArrow(alone, _TERMS).unionByName(shared)
