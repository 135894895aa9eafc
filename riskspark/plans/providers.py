"""Providers side by side: what each predicted for a case, how right, what score, how long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.codes import normalize_code
from riskspark.functions.demographics import DEFAULTS, member_features, readable_members
from riskspark.operators.diagnoses import typed_categories
from riskspark.operators.evaluate import prf_columns
from riskspark.operators.model import joined_hccs, pick_score, with_model
from riskspark.sources.refdata import RefData


def provider_runs(
    cases: DataFrame,
    predicted: DataFrame,
    gold: DataFrame,
    timings: DataFrame,
    members: DataFrame,
    code_map: DataFrame,
    ref: RefData,
    providers: list[str],
    case: str = "case_id",
) -> DataFrame:
    """One row per case and provider: code_list, hccs, score, P/R/F1, latency_total.

    ``cases`` (case, provider) says who ran what; a run may predict nothing. ``predicted`` is
    (case, provider, icd10), ``gold`` (case, icd10), ``timings`` (case, provider, step,
    seconds), ``members`` the demographics of each case (of several rows the largest counts;
    without a readable one there is no score). ``providers`` lists all of them; null codes
    count nowhere.

    Everything meets in one tagged union, aggregated once by run; codes join the map and
    seconds are added up by step before that. Repeats go on the map side, so a run sends its
    distinct codes once a task; P/R/F1 and the score are expressions over the aggregated row.
    """
    keys = [case, "provider"]
    each = F.explode(F.array(*map(F.lit, providers))).alias("provider")
    demographics = [c for c in members.columns if c in DEFAULTS or c == "dob"]
    typed = typed_categories(code_map, ref).withColumnRenamed("icd10", "code")
    by_step = timings.groupBy(*keys, "step").agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    parts = [
        cases.select(*keys, F.lit(True).alias("ran")),
        readable_members(members).select(case, each, F.struct(*demographics).alias("who")),
        gold.select(case, each, F.col("icd10").alias("gold")),
        predicted.select(*keys, "icd10", F.expr(normalize_code("icd10")).alias("code")).join(typed, "code", "left").drop("code"),
        by_step.drop("step"),
    ]
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    runs = tagged.groupBy(*keys).agg(
        F.max("ran").alias("ran"),
        F.max("who").alias("who"),
        F.round(F.sum("seconds"), 3).alias("latency_total"),
        F.array_sort(F.collect_set("icd10")).alias("code_list"),
        F.collect_set("gold").alias("gold"),
        F.collect_set("packed").alias("packed"),
        F.collect_set("item").alias("items"),
    ).where("ran")
    counted = prf_columns(F.size(F.array_intersect("code_list", "gold")), F.size("code_list"), F.size("gold"))
    kept = runs.select(
        *keys,
        F.struct("latency_total", "code_list", *counted).alias("kept"),
        F.col("who").isNotNull().alias("known"),
        "packed",
        "items",
        *[F.col(f"who.{c}").alias(c) for c in demographics],
    )
    scored = with_model(member_features(kept), ref)
    return scored.select(
        *keys,
        "kept.*",
        F.when(F.col("known"), F.expr(joined_hccs("hcc_active", ref))).otherwise("").alias("hccs"),
        F.when(F.col("known"), F.expr(pick_score(ref))).alias("score"),
    )


def provider_rows(runs: DataFrame) -> DataFrame:
    """The runs with their codes as one text."""
    return runs.withColumn("codes", F.array_join("code_list", " ")).drop("code_list")


def provider_compare(runs: DataFrame, first: str, second: str, case: str = "case_id") -> DataFrame:
    """Two providers of each case side by side; the difference only where both ran."""
    pick = lambda p, c: F.max(F.when(F.col("provider") == p, F.col(c))).alias(f"{c}_{p}")
    columns = ["hccs", "score", "code_f1", "latency_total"]
    wide = runs.groupBy(case).agg(*[pick(p, c) for p in (first, second) for c in ["code_list", *columns]])
    a, b = (F.col(f"code_list_{p}") for p in (first, second))
    difference = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return wide.select(
        case,
        *[x for p in (first, second) for x in (F.array_join(f"code_list_{p}", " ").alias(f"codes_{p}"), *[f"{c}_{p}" for c in columns])],
        F.array_join(difference, " ").alias("code_difference"),
    )
