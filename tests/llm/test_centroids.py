import hashlib
import math

import numpy as np

from riskspark.llm import centroids as C


def plain(rows, k=16, rounds=3, dim=64, scale=64, seed=1):
    """(id, cluster, distance, cluster inertia, inertia, centroid) by comparing with every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(float(np.float32(x)) * scale) for x in v]
            if max(map(abs, w), default=0) < (1 << 30) // dim:
                kept.append((i, w))
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    model = [v for _, v in sorted(kept, key=rank)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(model))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(model)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                model[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(len(model))]
    return sorted(((i, j, d, inertia[j], sum(inertia), tuple(model[j])) for i, d, j in found), key=repr)


def test_clusters_equal_plain_ones(spark, keep):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 64))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(0, 0.5, 64))]) for i in range(150)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (None, None), (500, None), (501, [0.5] * 63), (502, [0.5] * 63 + [None]), (503, [0.5] * 63 + [math.inf]), (504, [math.nan] * 64)]
    rows += [(505, [0.0] * 64), (506, [1e30] * 64), (507, [-1000.25] * 64), (508, [])] + [(600 + i, [0.25] * 64) for i in range(70)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int")
    got = C.clustered(table, keep).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr) == plain(rows)


def test_search_is_exact_in_ties_and_far_away():
    rng = np.random.default_rng(0)
    for _ in range(30):
        dim, k = int(rng.integers(1, 20)), int(rng.integers(1, 40))
        scale = int(rng.choice([2, 50, (1 << 30) // dim - 1]))
        centroids, rows = (rng.integers(-scale, scale, (n, dim)) for n in (k, 200))
        if scale == 2:
            centroids[k // 2 :] = centroids[: k - k // 2]
        number, distance = C.Search(centroids).nearest(rows)
        every = ((rows[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_fewer_vectors_than_centroids_and_none(spark, keep):
    schema = "vec_id long, embedding array<float>"
    assert C.clustered(spark.createDataFrame([], schema), keep).collect() == []
    rows = [(1, [0.1] * 64), (2, [0.9] * 64)]
    got = C.clustered(spark.createDataFrame(rows, schema), keep).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr) == plain(rows)
    assert C.clustered(spark.createDataFrame([(1, None)], schema), keep).collect() == []
