"""N-gram counts against counting by hand: slices, buckets, copies, keys that repeat or miss."""

import random
import re
from collections import Counter

import pytest

from riskspark.operators import occurrences as O

WORDS = ["alpha", "beta", "Gamma", "é1", "ß_", "中文", "a", "the", "the", "the", "x.y", "don't", ""]


def by_hand(rows):
    times, held = Counter(), {}
    for doc, text in rows:
        t = re.findall(r"\w\w+", (text or "").lower())
        for g in t + [f"{a} {b}" for a, b in zip(t, t[1:])]:
            times[g] += 1
            held.setdefault(g, set()).update([] if doc is None else [doc])
    return sorted((g, n, len(held[g])) for g, n in times.items())


@pytest.mark.parametrize("keys", ["own", "repeated", "missing"])
@pytest.mark.parametrize("words", [1, 40, 1 << 22])
def test_counts_equal_those_by_hand(spark, monkeypatch, words, keys):
    monkeypatch.setattr(O, "SLICE_WORDS", words)
    monkeypatch.setattr(O, "BUCKET_BYTES", 500)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(150)] + [None, "", "word", "the the the the"] + ["copy of one text"] * 30
    doc = {"own": lambda i: i, "repeated": lambda i: i // 3 if i < 90 else i, "missing": lambda i: None if i % 4 == 0 else i // 2}[keys]
    rows = [(doc(i), text) for i, text in enumerate(texts)]
    found = O.ngram_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    assert found.columns == ["ngram", "occurrences", "documents"]
    assert sorted(map(tuple, found.collect())) == by_hand(rows)


def test_no_rows(spark):
    assert O.ngram_counts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_an_ngram_leaves_its_slice_once(spark):
    """Lists of distinct n-grams are shuffled by bucket, no row per occurrence or per document."""
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat('one two three ', 50) AS text").repartition(2)
    found = O.ngram_counts(docs, "doc_id", "text")
    assert sorted(map(tuple, found.collect())) == sorted(
        [(w, 100_000, 2_000) for w in ("one", "two", "three")] + [("one two", 100_000, 2_000), ("two three", 100_000, 2_000), ("three one", 98_000, 2_000)]
    )
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.split("\n") if " Exchange " in line and "REPARTITION" not in line]
    assert moved and all("bucket" in line for line in moved) and "Generate" not in plan
