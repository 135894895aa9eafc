"""Embedding near-duplicates by balls around crowds and a forest of random-projection trees.

Crowds come first, as any split through one parts its pairs: where a sampled vector has several
links in the sample, a ball is laid around it. What lies within ``INNER`` of a ball's centre is
compared with all that lies within reach of a link from there, so every link of such a vector is
found (triangle inequality of angles), and it needs no tree. The others go through the forest.

Each tree splits at the median along random directions; what lies near a split goes to both
sides (spill, never less than a share of a link's length), so a near pair is seldom parted, and
hardly ever in all trees. A node not much wider than a link isn't split. Trees are fitted
on a bounded sample; below their leaves further random splits around the leaf's centre follow,
one for each doubling of the vectors beyond the sample, so leaves stay alike in size at every
number of vectors, and trees are added for them. Pairs are compared within leaves, in
double precision. A pair that shares several leaves counts in the first of them only, which the
leaves that each vector carries along tell, so a leaf gives each of its vectors' number of links
and one link to the smallest vector that it reaches there, never the pairs. A leaf or ball that is
large is compared in pairs of blocks by several tasks, whole.

Equal vectors are one class from the start, so a vector that a third of all rows hold is
compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, by_group, components, runs

#: Least cosine of a link.
MIN_COSINE = 0.9
#: Trees, share of a node that goes to both sides beyond the median on either side, leaf size.
TREES, SPILL, LEAF = 10, 0.04, 96
#: More trees for each further split below the leaves.
MORE_TREES = 1.15
#: Squared length of the longest link, and the share of its length that is the least spill on either side.
LINK, LINK_SPILL = 2 - 2 * MIN_COSINE, 0.22
#: A node isn't split if its vectors' mean squared distance is within so many times that of a link.
NARROW = 2
#: Links within the sample that make a crowd; cosine to a ball's centre within which no link is
#: lost, and the one that such a vector's links have at least (less a margin for rounding).
CROWD, INNER = 8, 0.8
OUTER = INNER * MIN_COSINE - ((1 - INNER**2) * (1 - MIN_COSINE**2)) ** 0.5 - 1e-9
#: Stands for no ball.
NOWHERE = 1 << 62
#: The sample a forest is fitted on: numbers in all, so it is 64 MB at any dimension.
SAMPLE_VALUES = 8_000_000
SAMPLE_ROWS = 16_384
#: Vectors that go through the trees at a time.
GATHER = 8192
#: Vectors of a leaf that one task compares with as many others.
BLOCK = 2048
#: Leaves over a block that are sent to every task; with more they are joined by shuffle.
BROADCAST_LEAVES = 50_000
SEED = 11


class Tree:
    """One tree: inner nodes (column of ``directions``, low, high, left, right) and leaves
    (centre, directions of further splits, their margins)."""

    def __init__(self, sample: np.ndarray, seed: int, extra: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.extra = extra
        columns: list[np.ndarray] = []
        self.root = self._grow(sample, columns)
        self.directions = np.stack(columns, axis=1) if columns else np.zeros((sample.shape[1], 0))

    def _grow(self, points: np.ndarray, columns: list[np.ndarray]) -> tuple:
        centre = points.mean(axis=0)
        narrow = 2 * ((points - centre) ** 2).sum(axis=1).mean() <= NARROW * LINK
        least = LINK_SPILL * LINK**0.5
        if len(points) > LEAF and not narrow:
            direction = self.rng.standard_normal(points.shape[1])
            at = points @ direction
            low, middle, high = np.quantile(at, (0.5 - SPILL, 0.5, 0.5 + SPILL))
            low, high = min(low, middle - least), max(high, middle + least)
            left, right = points[at <= high], points[at >= low]
            if max(len(left), len(right)) < len(points):
                columns.append(direction)
                return len(columns) - 1, low, high, self._grow(left, columns), self._grow(right, columns)
        directions = self.rng.standard_normal((points.shape[1], 0 if narrow and len(points) > 1 else self.extra))
        return centre, directions, np.maximum(((points - centre) @ directions).std(axis=0) * SPILL * 2.5, least)

    def leaves(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions) for all points; a point may come in several leaves."""
        projected = points @ self.directions
        stack = [(self.root, np.arange(len(points)), 1)]
        while stack:
            node, rows, path = stack.pop()
            if not len(rows):
                continue
            if len(node) == 5:
                column, low, high, left, right = node
                at = projected[rows, column]
                stack.append((left, rows[at <= high], path * 2))
                stack.append((right, rows[at >= low], path * 2 + 1))
                continue
            centre, directions, margins = node
            parts = [(path, rows)]
            for k in range(directions.shape[1]):
                split = []
                for code, some in parts:
                    at = (points[some] - centre) @ directions[:, k]
                    split += [(code * 2, some[at <= margins[k]]), (code * 2 + 1, some[at >= -margins[k]])]
                parts = [x for x in split if len(x[1])]
            yield from parts


class Balls:
    """Balls around the crowds of a sample, numbered from ``first``."""

    def __init__(self, sample: np.ndarray, first: int) -> None:
        self.first = first
        free = np.ones(len(sample), bool)
        single = sample.astype(np.float32)
        parts = [(single[i : i + 1024] @ single.T >= MIN_COSINE).sum(axis=1) for i in range(0, len(single), 1024)]
        degree = np.concatenate([np.zeros(0, np.int64), *parts]) - 1
        centres = []
        for seed in np.argsort(-degree, kind="stable"):
            if degree[seed] < CROWD:
                break
            if not free[seed]:
                continue
            at = sample @ sample[seed]
            if (free & (at >= MIN_COSINE)).sum() <= CROWD:
                continue
            centre = sample[free & (at >= INNER)].mean(axis=0)
            centres.append(centre / np.linalg.norm(centre))
            free &= sample @ centres[-1] < INNER
        self.centres = np.array(centres).reshape(-1, sample.shape[1])
        self.free = sample[free]

    def meet(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all points the first ball that they are inside of; (position, ball) of all within reach."""
        home, rows, balls = np.full(len(points), NOWHERE), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(points), 1024):
            at = points[i : i + 1024] @ self.centres.T
            if at.shape[1]:
                inside = at >= INNER
                home[i : i + 1024] = np.where(inside.any(axis=1), inside.argmax(axis=1) + self.first, NOWHERE)
            row, ball = np.nonzero(at >= OUTER)
            rows.append(row + i)
            balls.append(ball + self.first)
        return home, np.concatenate(rows), np.concatenate(balls)


def fit(sample: list[list[float]], n: int) -> dict[int, tuple[Balls, list[Tree]]]:
    """Balls and trees by dimension; ``n`` is the number of vectors that they are for."""
    by_dim: dict[int, list[list[float]]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out: dict[int, tuple[Balls, list[Tree]]] = {}
    extra = max(0, int(np.ceil(np.log2(max(1, n / len(sample)))))) if sample else 0
    for dim, rows in by_dim.items():
        balls = Balls(_unit(np.array(rows, np.float64)), sum(len(b.centres) for b, _ in out.values()))
        trees = int(np.ceil(TREES * MORE_TREES**extra)) if len(balls.free) else 0
        out[dim] = balls, [Tree(balls.free, SEED + 1000 * dim + t, extra) for t in range(trees)]
        del balls.free
    return out


def _vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, bounds of each vector)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy())].astype(np.int64)


def _unit(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.float64)
    points /= np.abs(points).max(axis=1, keepdims=True)  # so that no square is lost or overflows
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) for each length of vectors."""
    flat, at = _vectors(column)
    lengths = np.diff(at)
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        yield own, _unit(flat[at[own][:, None] + np.arange(dim)])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` rows its values, sorted."""
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[np.lexsort((values, rows))]))


def _assigned(classes: DataFrame, forest: dict[int, tuple[Balls, list[Tree]]]) -> DataFrame:
    """``classes`` with ``home`` (the ball that a vector is inside of), ``balls`` within reach and
    ``leaves`` of those without a home, both sorted; leaves have negative names.

    A length of vectors that the sample lacks is one leaf.
    """
    shared = classes.sparkSession.sparkContext.broadcast(forest)
    names = classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, GATHER):
            rows, leaf, met, ball = ([np.zeros(0, np.int64)] for _ in range(4))
            homes = np.full(batch.num_rows, NOWHERE)
            for own, points in _by_length(batch.column("v")):
                dim = points.shape[1]
                balls, trees = shared.value.get(dim, (None, []))
                if balls is not None:
                    homes[own], at, names_ = balls.meet(points)
                    met.append(own[at])
                    ball.append(names_)
                away = np.flatnonzero(homes[own] == NOWHERE)
                points, own = points[away], own[away]
                found = [(_name(dim, t, name), own[at]) for t, tree in enumerate(trees) for name, at in tree.leaves(points)] or [(_name(dim, -1, 0), own)]
                rows += [r for _, r in found]
                leaf += [np.full(len(r), name, np.int64) for name, r in found]
            lists = [_lists(np.concatenate(r), np.concatenate(x), batch.num_rows) for r, x in ((met, ball), (rows, leaf))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(homes), *lists], names=[*names, "home", "balls", "leaves"])

    none = F.array().cast("array<bigint>")
    return classes.mapInArrow(run, classes.withColumns({"home": F.lit(0).cast("bigint"), "balls": none, "leaves": none}).schema)


def _name(dim: int, tree: int, leaf: int) -> int:
    return hash((dim, tree, leaf)) | -(1 << 63)


def _ball_links(points: np.ndarray, ids: np.ndarray, blocks: np.ndarray, across: bool, ball: int, homes: np.ndarray) -> np.ndarray:
    """As :func:`_first_links`, in a ball: a pair is that of the first ball which is home to either."""
    linked = np.zeros((len(points), len(points)), bool)
    inside, others = np.flatnonzero(homes == ball), np.flatnonzero(homes >= ball)
    for i in range(0, len(inside), 1024):
        part = inside[i : i + 1024]
        near = (points[part] @ points[others].T >= MIN_COSINE) & (ids[part, None] != ids[None, others])
        if across:
            near &= blocks[part, None] != blocks[None, others]
        linked[np.ix_(part, others)] = near
        linked[np.ix_(others, part)] |= near.T
    return linked


def _first_links(points: np.ndarray, ids: np.ndarray, blocks: np.ndarray, across: bool, leaf: int, leaves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs link, aren't counted in another leaf, and are this task's."""
    n = len(points)
    linked = np.zeros((n, n), bool)
    flat, at = leaves
    owner = np.repeat(np.arange(n), np.diff(at))
    earlier = flat < leaf
    names, place, times = np.unique(flat[earlier], return_inverse=True, return_counts=True)
    common = times[place] > 1
    member = np.zeros((n, len(names)), np.float32)
    member[owner[earlier][common], place[common]] = 1
    member = member[:, times > 1]
    for i in range(0, n, 1024):
        part = slice(i, i + 1024)
        near = (points[part] @ points.T >= MIN_COSINE) & (ids[part, None] != ids[None, :])
        if across:
            near &= blocks[part, None] != blocks[None, :]
        if near.any() and member.shape[1]:
            some = np.flatnonzero(near.any(axis=0))
            near[:, some] &= member[part] @ member[some].T == 0
        linked[part] = near
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each position the first one of those that its links reach."""
    root = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if root[seed] < 0:
            frontier = np.array([seed])
            root[seed] = seed
            while len(frontier):
                frontier = np.flatnonzero(linked[frontier].any(axis=0) & (root < 0))
                root[frontier] = seed
    return root


def _counted(rows: DataFrame) -> DataFrame:
    """(class, root, others): in one task of one leaf, the rows linked to a class and a link of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["leaf", "i", "j"]):
            group = group.combine_chunks()
            leaf, first, second, block, ids, n, homes = (group.column(c).to_numpy() for c in ("leaf", "i", "j", "block", "class", "n", "home"))
            starts, lengths = runs(np.cumsum(np.r_[True, (leaf[1:] != leaf[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
            out = [np.zeros((3, 0), np.int64)]
            for s, size in zip(starts.tolist(), lengths.tolist(), strict=True):
                own = group.slice(s, size)
                for at, points in _by_length(own.column("v")) if size > 1 else ():
                    flat, bounds = _vectors(own.column("leaves").take(pa.array(at)))
                    name = ids[s + at]
                    across = bool(first[s] != second[s])
                    if leaf[s] >= 0:
                        linked = _ball_links(points, name, block[s + at], across, int(leaf[s]), homes[s + at])
                    else:
                        linked = _first_links(points, name, block[s + at], across, int(leaf[s]), (flat, bounds))
                    hit = np.flatnonzero(linked.any(axis=1))
                    if len(hit):
                        others = linked[hit].astype(np.float64) @ n[s + at]
                        out.append(np.stack([name[hit], name[_roots(linked)[hit]], others.astype(np.int64)]))
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["class", "root", "others"])

    return rows.mapInArrow(run, "class bigint, root bigint, others bigint")


def links(classes: DataFrame, keep: Keep) -> DataFrame:
    """(class, root, others) of ``classes`` (class, v, n): summed over rows, ``others`` is the
    number of vectors linked to a class; (class, root) join what all found links join."""
    count = classes.count()
    dim = max(1, (classes.agg(F.max(F.size("v"))).first()[0] or 1))
    rows = min(SAMPLE_ROWS, max(LEAF, SAMPLE_VALUES // dim))
    sample = [r.v for r in classes.orderBy(F.xxhash64("class")).limit(rows).select("v").collect()]
    placed = keep(_assigned(classes, fit(sample, count)), "placed")
    places = F.explode(F.concat("balls", "leaves"))
    large = placed.select(places.alias("leaf")).groupBy("leaf").count().where(F.col("count") > BLOCK)
    large = keep(large.select("leaf", F.ceil(F.col("count") / BLOCK).alias("blocks")), "large-leaves")
    few = large.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    dealt = placed.withColumn("leaf", places).join(F.broadcast(large) if few else large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("bigint"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "n", "home", "v", "leaves")
    return _counted(dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "class"))


def near_vectors(table: DataFrame, keep: Keep, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``table``.

    Null and zero vectors and those with null or non-finite parts link with nothing: no links,
    their own component. Rows with equal vectors are linked like any other; rows with equal
    ids are separate rows, all kept if the id is their component's. A null id is a component's
    only if no row of it has one, and is then kept. Vectors of other lengths never link. An
    empty table gives an empty result; extra columns are ignored.
    """
    single = dict(table.dtypes)[vector] == "array<float>"  # every float is a double
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    rows = keep(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(SEED), "v").alias("y")))), "rows")
    own = rows.where("v is not null")
    classes = keep(own.groupBy("h").agg(F.min("row").alias("class"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    found = links(classes.select("class", "v", "n"), keep).groupBy("class", "root").agg(F.sum("others").alias("others"))
    found = keep(found, "links")
    both = found.groupBy(F.col("class").alias("a")).agg(F.sum("others").alias("others"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), keep, "roots")
    member = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    member = keep(member.select("h", "class", "n", "root", "least"), "members")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = member.join(first, "root").join(both, F.col("class") == F.col("a"), "left").select("h", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("v").join(known, "h", "left").withColumn("component_id", F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
