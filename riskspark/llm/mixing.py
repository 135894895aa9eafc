"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight; none is repeated more than ``max_epochs`` times.
What a clamped source cannot use is shared again by weight among the others until none is
above its cap: the level L with sum(min(L * weight, cap)) = budget. A source's target is met
by whole repetitions of all its documents, and one more of the first documents in a seeded
order until the target is reached; only the document at which it is reached is taken in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, count_words, sent_if_small, text_of

#: Fixed values of the mix: weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = 7
#: Hex digits of the seeded order by which a source is cut into buckets (16 to that power).
BUCKET_DIGITS = 4


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of (source, size) rows.

    Sources stand in code point order, null last. The windows run over one row per source.
    """
    if percent > 100 * max_epochs:
        raise ValueError("the budget is above what all sources may give")
    total = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int")).cast("bigint")
    ranked = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    # Sources clamp in the order of cap / weight. If all up to one are clamped, the level is
    # what is left of the budget by the weight that is left; the largest that fits is the level.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(percent / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    filled = ranked.withColumn("level", level).withColumn("final", F.max(fits).over(whole))
    # without a level every cap is met exactly
    target = F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, without: tuple[str, ...] = (), **shares: object) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``whole`` and ``part``.

    ``whole`` is the number of whole repetitions, ``part`` the words of one more. Null and
    empty texts have size 0 and take nothing. A null source is a source, the last. Equal rows
    are separate; those with equal ids stand by size in the seeded order, and rows equal in
    both share one rank in turn. An empty table gives an empty result. No column of ``docs``
    but those named is read; those added replace columns of the same name. Columns named in
    ``without`` (the text, where only counts are wanted) are left out of the result.
    """
    added = ("size", "source_size", "target", "whole", "part")
    sized = docs.drop(*added).withColumn("size", count_words(text_of(text)))
    sized = sized.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    sized = keep(sized.drop(*without), "sized")
    shared = targets(sized, source, **shares)
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    buckets = sized.groupBy(F.col(source).alias("_source"), bucket.alias("_bucket")).agg(F.sum("size").alias("_n"))
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    shared = shared.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    shared = shared.withColumn("_rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    shared = keep(shared.select(F.col("source").alias("_of"), "source_size", "target", "whole", "_rest"), "shares")
    # The bucket in which a source's target is reached: those before it take all, those after
    # it nothing, and only it needs an order inside. Without one all take all.
    reached = buckets.join(shared, F.col("_source").eqNullSafe(F.col("_of"))).where(F.col("_start") + F.col("_n") > F.col("_rest"))
    reached = reached.groupBy("_source").agg(F.min(F.struct("_bucket", "_start")).alias("_cut"))
    plan = shared.join(reached, F.col("_of").eqNullSafe(F.col("_source")), "left").drop("_source")
    plan = sent_if_small(keep(plan, "plan"), F.lit(1))
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col("_of")))
    inside = F.coalesce(bucket == F.col("_cut._bucket"), F.lit(False))
    plain = joined.where(~inside).withColumn("part", F.when(F.col("_cut").isNull() | (bucket < F.col("_cut._bucket")), F.col("size")).otherwise(0))
    order = Window.partitionBy("_of").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_cut._start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = joined.where(inside).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - at)))
    rows = plain.unionByName(cut).drop("_of", "_cut", "_rest", "_order")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("whole", "part", "size", "source_size")})


def repeated(docs: DataFrame, keep: Keep, id_col: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The rows of the mix: each of ``docs`` as often as it is taken, in whole texts and with its own columns.

    The one document of a source that is taken in part counts as whole from half its words on.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text, "text"), (source, "source"))])
    mixed = mix(packed, keep, "id", "text", "source", without=("text",), **options)
    extra = ((F.col("size") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("bigint")
    times = F.array_repeat(F.lit(0), (F.col("whole") + extra).cast("int"))
    return mixed.select("_doc", F.explode(times).alias("_time")).select("_doc.*")
