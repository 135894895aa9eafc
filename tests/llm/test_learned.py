import zlib

import numpy as np
import pytest

from riskspark.llm import factors, toxicity


def held(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvxyz'[i // 100]}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        bad, junk = i % 8 == 0, i % 5 == 0
        text = list(rng.choice(words, rng.integers(30, 120))) + ["vile", "nasty"] * bad
        rng.shuffle(text)
        text = " ".join(text)
        rows.append((i, text.upper() + "!! ##" if junk else text))
        if i % 2 == 0 or bad:
            labels.append((i, int(not junk), int(bad)))
    return rows, labels


ODD = [(9000, None), (9001, ""), (9002, "vile " * 60_000), (9003, "\n \t"), (None, "no id"), (3, "twice"), (3, "twice")]


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def accuracy(got, labels, column, folds, fold):
    known = {r[0]: r[column] for r in labels}
    rows = [(r.predicted, known[r.doc_id]) for r in got if r.doc_id in known and r.held_out]
    assert len(rows) > 20
    return np.mean([a == b for a, b in rows])


def check(got, rows, folds, fold):
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id, folds, fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_toxicity_held_out(docs, labels_of, keep):
    rows, labels = corpus()
    rows += ODD
    got = toxicity.toxicity(docs(rows, label="x", score=1, words="y"), labels_of([*labels, labels[0], (77777, 1, 1), (None, 1, 1), (5, None, None)]), keep).collect()
    check(got, rows, 5, 0)
    assert accuracy(got, labels, 2, 5, 0) > 0.97
    assert {r.doc_id: r.predicted for r in got}[9002] == 1


def test_toxicity_with_one_id_as_a_third_of_the_rows(docs, labels_of, keep):
    """The id counts as one document of the sample, whatever its share and its texts."""
    rows, labels = corpus()
    hot = next(d for d, _, bad in labels if bad and not held(d, 5, 0))
    crowd = [(hot, f"vile clean{i % 7}") for i in range(300)]
    got = toxicity.toxicity(docs(rows + crowd), labels_of(labels), keep).collect()
    check(got, rows + crowd, 5, 0)
    assert accuracy(got, labels, 2, 5, 0) > 0.97
    sample = toxicity._features(docs(rows + crowd).selectExpr("doc_id AS id", "true AS positive", "text"))
    assert sample.count() == len(rows)


def test_toxicity_from_positives_only(docs, labels_of, keep):
    """The prior is overstated and scores are too high, but the order holds."""
    rows, labels = corpus()
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs(rows), labels_of([x for x in labels if x[2]]), keep).collect()}
    toxic = {d for d, _, bad in labels if bad}
    assert min(got[d] for d in toxic) > max(s for d, s in got.items() if d not in toxic)


def test_quality_held_out(docs, labels_of, keep):
    rows, labels = corpus()
    rows += ODD
    got = factors.quality(docs(rows, label="x", score=1), labels_of([*labels, labels[0], (77777, 1, 1), (None, 1, 1), (5, None, None)]), keep).collect()
    check(got, rows, 3, 1)
    assert accuracy(got, labels, 1, 3, 1) > 0.97


def test_quality_with_one_id_as_a_third_of_the_rows(docs, labels_of, keep):
    rows, labels = corpus()
    hot = next(d for d, good, _ in labels if good and not held(d, 3, 1))
    crowd = [(hot, dict(rows)[hot] + f" w{i % 7}") for i in range(300)]
    got = factors.quality(docs(rows + crowd), labels_of(labels), keep).collect()
    check(got, rows + crowd, 3, 1)
    assert accuracy(got, labels, 1, 3, 1) > 0.95


def test_scores_do_not_depend_on_partitions(docs, labels_of, keep):
    rows, labels = corpus(300)
    for f in (toxicity.toxicity, factors.quality):
        one, other = (
            sorted((r.doc_id, round(r.score, 9)) for r in f(docs(rows[::step]).repartition(n), labels_of(labels[::step]).repartition(n), keep).collect())
            for n, step in ((1, 1), (7, -1))
        )
        assert one == other


def test_nothing_to_learn_from(docs, labels_of, keep):
    assert [r.score for r in toxicity.toxicity(docs([(1, "a"), (2, "b")]), labels_of([]), keep).collect()] == [0.0, 0.0]
    assert [r.score for r in factors.quality(docs([(1, "a"), (2, "b")]), labels_of([]), keep).collect()] == [0.5, 0.5]
    for f in (toxicity.toxicity, factors.quality):
        assert f(docs([]), labels_of([(1, 1, 1)]), keep).collect() == []


def test_held_out_labels_change_nothing(docs, labels_of, keep):
    rows, labels = corpus(200)
    flipped = [(d, 1 - q if held(d, 3, 1) else q, 1 - t if held(d, 5, 0) else t) for d, q, t in labels]
    for f in (toxicity.toxicity, factors.quality):
        a, b = (sorted(map(tuple, f(docs(rows), labels_of(x), keep).select("doc_id", "score").collect())) for x in (labels, flipped))
        assert a == b


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(2)
    machine = factors.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    feature, value = np.array([3, 7, 20, 41]), np.array([0.5, 1.0, 2.0, 0.1])
    pairs = sum(value[i] * value[j] * machine.factors[feature[i]] @ machine.factors[feature[j]] for i in range(4) for j in range(i))
    got = machine.raw(feature, value, np.zeros(1, np.int64))[0][0]
    assert got == pytest.approx(0.3 + machine.linear[feature] @ value + pairs)


def test_risk_never_goes_below_zero_for_long():
    rng = np.random.default_rng(1)
    positive = rng.integers(0, 2, (40, 30)).astype(np.float32)
    unlabelled = rng.integers(0, 2, (60, 30)).astype(np.float32)
    weights, bias = toxicity.nonnegative_pu(positive, unlabelled, 0.4)
    p, u = positive @ weights + bias, unlabelled @ weights + bias
    assert np.logaddexp(0, u).mean() - 0.4 * np.logaddexp(0, p).mean() > -0.1
