import numpy as np
import pytest

from riskspark.llm import forest as R


def plain(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links = {i: [j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in good}
    root = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [(rows[i][0], len(links.get(i, [])), root[i], rows[i][0] == root[i]) for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def crowd(n, dim=16, seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    points = [c + rng.normal(size=dim) * spread for c in centres for _ in range(6)]
    return [(i, p.tolist()) for i, p in enumerate(points)]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_odd_vectors(spark, keep):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    rows += [(None, [0.0, 1.0]), (11, [1e-200, 1e-201]), (12, [1e200, 0.0]), (None, [0.0, 1.0])]
    from pyspark.sql import functions as F

    got = R.near_vectors(frame(spark, rows).withColumn("row", F.lit(1)).withColumn("h", F.lit("x")), keep).collect()
    want = [(d, n, r, k) for d, n, r, k in plain(rows)]
    assert order(got) == order(want)


def test_no_vectors(spark, keep):
    assert R.near_vectors(frame(spark, []), keep).collect() == []
    assert R.near_vectors(frame(spark, [(1, None)]), keep).collect() == [(1, 0, 1, True)]


def test_crowds_equal_all_pairs_when_near(spark, keep):
    rows = crowd(240, spread=0.03)
    assert order(R.near_vectors(frame(spark, rows), keep).collect()) == order(plain(rows))


@pytest.mark.parametrize("rows", [2048, 300])
def test_recall_at_the_threshold(spark, keep, monkeypatch, rows):
    """Pairs between 0.9 and 0.95, with the forest fitted on all and on a small part."""
    monkeypatch.setattr(R, "SAMPLE_ROWS", rows)
    monkeypatch.setattr(R, "LEAF", 32)
    data = crowd(1800, dim=32, seed=3, spread=0.27)
    points = np.array([v for _, v in data])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    cosine = points @ points.T
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.9), strict=True) if i < j}
    assert len(want) > 300 and np.mean([cosine[i, j] < 0.95 for i, j in want]) > 0.7
    found = R.links(frame(spark, data).selectExpr("vec_id AS class", "embedding AS v", "1L AS n"), keep).groupBy("class").sum("others").collect()
    per = {i: sum(i in p for p in want) for i, _ in data}
    assert all(r[1] <= per[r[0]] for r in found) and sum(r[1] for r in found) >= 0.9 * 2 * len(want)


def test_blocks_of_a_large_leaf(spark, keep, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 20)
    monkeypatch.setattr(R, "LEAF", 1000)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for i in range(130)] + [(500, (-np.ones(8)).tolist())]
    got = R.near_vectors(frame(spark, rows), keep).collect()
    assert {r.n_links for r in got if r.vec_id < 200} == {129} and {r.component_id for r in got} == {0, 500}


@pytest.mark.parametrize("rows", [16_384, 500])
def test_links_of_unequal_near_vectors_in_groups_of_any_size(spark, keep, monkeypatch, rows):
    """Groups from 10 to a third of all rows, mean cosine 0.93, with n up to 12 times the sample."""
    monkeypatch.setattr(R, "SAMPLE_ROWS", rows)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    sizes = [2000, 600, 150, 40, *[10] * 20]
    noise = lambda n: unit(rng.normal(size=(n, 64))) * (1 / 0.93 - 1) ** 0.5
    parts = [unit(unit(rng.normal(size=64)) + noise(n)) for n in sizes] + [unit(rng.normal(size=(6000 - sum(sizes), 64)))]
    points = np.concatenate(parts)
    linked = points @ points.T >= 0.9
    want = linked.sum(axis=1) - 1
    data = frame(spark, [(i, p.tolist()) for i, p in enumerate(points)]).selectExpr("vec_id AS class", "embedding AS v", "1L AS n")
    got = np.zeros(len(points), int)
    for r in R.links(data, keep).groupBy("class").sum("others").collect():
        got[r[0]] = r[1]
    assert (got <= want).all()
    bounds = np.cumsum([0, *sizes])
    for s, e in [*zip(bounds[:4], bounds[1:5], strict=True), (bounds[4], bounds[-1])]:
        assert got[s:e].sum() >= 0.99 * want[s:e].sum() > 0
