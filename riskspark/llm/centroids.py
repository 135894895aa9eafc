"""Centroid clustering of integer vectors with the equal-average equal-variance search.

Components are scaled and floored to integers. A vector's nearest centroid is found among the
centroids sorted by the sum of their components: a scan goes outward from the vector's own sum
and stops on a side where the sums alone put all further centroids beyond the nearest so far;
single centroids are passed over where sum and deviation together do. With S the sum and V the
length of what is left without the mean, and d components,

    d * distance >= (S(x) - S(c))^2  and  d * distance >= (S(x) - S(c))^2 + d * (V(x) - V(c))^2,

so neither bound ever passes over a centroid that is as near, and what is left is measured in
integers: ties and distances are exact. All vectors of a batch scan in step, in numpy.

A round is one pass over the vectors; tasks send sums of their vectors by cluster, and as many
numbers as the centroids hold reach the driver. Centroids are a model: their number and length are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: By the number of components, integers below this keep every sum of squares within 64 bits.
LARGEST = 1 << 30
#: Share by which the deviation bound is lowered against rounding.
MARGIN = 1e-9
#: Numbers of a batch of vectors held at a time.
VALUES = 1 << 20


class Search:
    """Nearest of some centroids (k rows of integers)."""

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.centroids, self.sums = centroids[self.order], sums[self.order]
        self.dim = centroids.shape[1]
        self.deviation = self._deviation(self.centroids, self.sums)

    def _deviation(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Square root of d times the squares about the mean; only the root is rounded."""
        return np.sqrt(((rows**2).sum(axis=1) * self.dim - sums**2).astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, the smaller number in ties."""
        n, k = len(rows), len(self.sums)
        sums = rows.sum(axis=1)
        deviation = self._deviation(rows, sums)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        active = np.arange(n)
        while len(active):
            lo, hi = left[active], right[active]
            far = np.iinfo(np.int64).max
            gap_lo = np.where(lo >= 0, sums[active] - self.sums[np.maximum(lo, 0)], far)
            gap_hi = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[active], far)
            down = gap_lo <= gap_hi
            gap, at = np.where(down, gap_lo, gap_hi), np.where(down, lo, hi)
            # in doubles, lowered: large sums may not be squared in 64 bits
            bound = gap.astype(np.float64) ** 2 * (1 - MARGIN)
            reach = best[active].astype(np.float64) * self.dim
            within = (gap < far) & (bound <= reach)
            active, down, gap, at, bound, reach = (x[within] for x in (active, down, gap, at, bound, reach))
            left[active[down]] -= 1
            right[active[~down]] += 1
            spread = np.abs(deviation[active] - self.deviation[at])
            slack = MARGIN * (deviation[active] + self.deviation[at])
            measured = bound + np.maximum(spread - slack, 0) ** 2 * (1 - MARGIN) <= reach
            some, at = active[measured], at[measured]
            distance = ((rows[some] - self.centroids[at]) ** 2).sum(axis=1)
            nearer = (distance < best[some]) | (distance == best[some]) & (self.order[at] < number[some])
            best[some[nearer]], number[some[nearer]] = distance[nearer], self.order[at[nearer]]
        return number, best


def integers(vector: Column, scale: int, dim: int) -> Column:
    """The vector's integers; null if it is none of ``dim`` finite numbers, or too large."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    good = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST // dim))
    return F.when(F.coalesce(good, F.lit(False)), whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _stretches(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, VALUES // dim)
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part, _matrix(part.column("v"), dim)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; one without vectors stays."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, part in _stretches(batch, dim):
                number, _ = search.nearest(part)
                for c in np.unique(number).tolist():
                    total[c] += part[number == c].sum(axis=0)
                count += np.bincount(number, minlength=len(count))
        some = np.flatnonzero(count)
        at = np.repeat(some, dim), np.tile(np.arange(dim), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at]), pa.array(count[at[0]])], names=["cluster", "place", "total", "count"])

    sums = rows.select("v").mapInArrow(run, "cluster bigint, place bigint, total bigint, count bigint")
    sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"))
    out = centroids.copy()
    for r in sums.collect():  # as many rows as the centroids hold numbers
        out[r.cluster, r.place] = int(r.total) // r["count"]
    return out


def clustered(table: DataFrame, keep: Keep, id_col: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept.

    Kept are vectors of ``dim`` components, none null or non-finite; those with an integer of
    2^30 / ``dim`` or more are left out as well, as their distances could exceed 64 bits. The first centroids are the
    kept vectors with the smallest SHA-256 of ``seed:id`` (lowercase hex); rows of equal id stand by
    their integers, null ids last. With fewer vectors there are fewer centroids. Equal rows are
    separate and fall into the same cluster. An empty table gives an empty result; extra columns are ignored.
    """
    rows = table.select(F.col(id_col).alias("id"), integers(F.col(vector), scale, dim).alias("v")).where("v is not null")
    rows = keep(rows, "integers")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(rank.asc_nulls_last(), "v").limit(centroids).select("v").collect()
    model = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(model) else 0):
        model = _moved(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(model)
        for batch in batches:
            for part, v in _stretches(batch, dim):
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, search.nearest(v))], names=["id", "cluster", "distance"])

    schema = rows.select("id", F.lit(0).cast("bigint").alias("cluster"), F.lit(0).cast("bigint").alias("distance")).schema
    near = keep(rows.mapInArrow(run, schema), "assigned")
    spark = table.sparkSession
    known = spark.createDataFrame([(i, c) for i, c in enumerate(model.tolist())], "cluster bigint, centroid array<bigint>")
    inertia = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = keep(known.join(inertia, "cluster", "left"), "centroids")
    every = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # one row per centroid, and one in all
    return near.join(F.broadcast(each), "cluster").join(F.broadcast(every)).select(F.col("id").alias(id_col), F.col("cluster").cast("int"), "distance", "cluster_inertia", "inertia", "centroid")

