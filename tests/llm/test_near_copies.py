import random

import numpy as np
import pytest

from riskspark.llm import near_copies as N

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("r", "st", "n", "lm")]


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def copy_at(rng, text, least, most):
    """A copy with single words replaced, of a similarity between the two."""
    while True:
        parts, last = text.split(), text
        while (j := jaccard(text, last)) > most:
            parts[rng.randrange(len(parts))] = rng.choice(WORDS) + "x"
            last = " ".join(parts)
        if j >= least:
            return last


@pytest.mark.parametrize("least,recall", [(0.80, 0.88), (0.85, 0.94), (0.90, 0.98), (0.95, 1.0)])
def test_recall_of_planted_copies(docs, keep, least, recall):
    rng = random.Random(int(least * 100))
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(80, 400))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, copy_at(rng, t, least, least + 0.03)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in N.one_of_each(docs(rows), keep).collect()}
    assert got >= set(range(150)), "clean texts stay"
    assert 1 - len(got - set(range(150))) / 150 >= recall


def test_texts_of_less_similarity_stay(docs, keep):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(80, 400))) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, copy_at(rng, t, 0.55, 0.62)) for i, t in enumerate(texts)]
    assert len(N.one_of_each(docs(rows), keep).collect()) == 200


def test_a_crowd_is_one_group_and_stages_keep_columns(docs, keep):
    """Very many near copies of one text, copies of others, odd texts and clashing columns."""
    rng = random.Random(1)
    text = " ".join(rng.choices(WORDS, k=300))
    rows = [(100 + i, copy_at(rng, text, 0.9, 0.97)) for i in range(120)] + [(7, text), (8, text.upper()), (8, text.upper())]
    odd = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (5, "A  b c\nd e"), (9, None), (8, ""), (1, "short"), (2, "w " * 60_000), (4, "w " * 50_000)]
    got = N.one_of_each(docs([*rows, *odd], row=1, size=2, keys=3, margins=4, first=5, doc=6), keep).collect()
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in got) == sorted([(7, text[:9]), (3, "a b c d e"), (8, ""), (1, "short"), (2, "w w w w w")])
    assert all((r.row, r.size, r.keys, r.margins, r.first, r.doc) == (1, 2, 3, 4, 5, 6) for r in got)


def test_blocks_of_a_crowd_lose_no_link(spark, docs, keep, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=200)) for _ in range(3)]
    rows = [(i, copy_at(rng, texts[i % 3], 0.85, 0.95)) for i in range(60)]
    monkeypatch.setattr(N, "BLOCK", 5)
    assert len(N.one_of_each(docs(rows), keep).collect()) == 3


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.normal(0, N.UNIT, (8, N.MARGINS))
    vectors = np.clip(base[rng.integers(0, 8, 90)] + rng.normal(0, rng.uniform(2, 14, (90, 1)), (90, N.MARGINS)), -127, 127).astype(np.int8)
    sizes, ids = rng.integers(90, 110, 90), rng.permutation(90) * 10
    near = N.alike(vectors, sizes, vectors, sizes)
    group = np.arange(90)
    for _ in range(90):
        group = np.array([group[near[i]].min() for i in range(90)])
    want = {frozenset(ids[group == g].tolist()) for g in set(group.tolist())}
    of = {int(i): int(i) for i in ids}
    for a, b in N.forest(ids, vectors, sizes):
        of = {k: of[a] if v == of[b] else v for k, v in of.items()}
    assert {frozenset(k for k, v in of.items() if v == g) for g in set(of.values())} == want


def test_empty_table(docs, keep):
    assert N.one_of_each(docs([]), keep).collect() == []
