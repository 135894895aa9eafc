"""Scoring a roster, and the questions asked about its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.demographics import member_features, readable_members
from riskspark.operators.diagnoses import category_items
from riskspark.operators.model import (
    by_file_order,
    hccs_by_number,
    joined_groups,
    joined_hccs,
    joined_interactions,
    names_of,
    pick_score,
    with_model,
)
from riskspark.sources import fixed_values as fv
from riskspark.sources.refdata import RefData


def score_roster(
    members: DataFrame,
    dx: DataFrame,
    code_map: DataFrame,
    ref: RefData,
    key: str = "member_id",
    cutoff: str = fv.CUTOFF_DATE,
    mce_edits: bool = True,
    scored_only: bool = False,
) -> DataFrame:
    """One row per member with position arrays, nine scores and the applicable score.

    Diagnoses are reduced to one small row per member before they meet the roster, so
    the join by member never sees a hot key. ``scored_only`` keeps members that have at
    least one code; by default members without codes get their demographic scores.
    Members whose demographics are present but no whole numbers are not scored
    (``demographics.bad_demographics``, ``sources.rejects`` for a table of them).
    """
    return score_items(members, category_items(dx, code_map, ref, key, mce_edits), ref, key, cutoff, mce_edits, dx if scored_only else None)


def score_items(
    members: DataFrame, items: DataFrame, ref: RefData, key: str = "member_id", cutoff: str = fv.CUTOFF_DATE, mce_edits: bool = True,
    only: DataFrame | None = None, how: str = "left",
) -> DataFrame:
    """``score_roster`` from the sets of ``category_items``; ``only`` keeps members with a code there.

    With ``how="inner"`` only members with a row of sets are scored.
    """
    features = member_features(readable_members(members), cutoff)
    if only is not None:
        with_codes = only.where(F.trim("icd10") != "").select(key).distinct()
        features = features.join(with_codes, key, "left_semi")
    scored = with_model(features.join(items, key, how), ref, mce_edits)
    return scored.withColumn("applicable_score", F.expr(pick_score(ref)))


def member_result(scored: DataFrame, ref: RefData, key: str = "member_id", *carried: str) -> DataFrame:
    """Flat result: labels, joined lists, nine scores, then further columns to keep."""
    return scored.select(
        key,
        "age",
        "sex_label",
        "orec_label",
        "disabl",
        "origdis",
        F.expr(joined_hccs("hcc_active", ref)).alias("active_hccs"),
        F.expr(joined_groups(ref)).alias("diag_categories"),
        F.expr(joined_interactions(ref)).alias("interactions"),
        *ref.models,
        "applicable_model",
        "applicable_score",
        *carried,
    )


def member_record(scored: DataFrame, ref: RefData, key: str = "member_id") -> DataFrame:
    """Nested result record per member.

    Everything nested is bounded by the model tables. The code→category list is not
    (it grows with a member's codes), so it stays a table: ``code_to_category``.
    """
    details = F.expr(
        f"transform({hccs_by_number('hcc_active', ref)}, x -> named_struct('hcc', x.hcc, 'description', x.description))"
    )
    scores = lambda models: F.map_from_entries(
        F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).alias("value")) for m in models])
    )
    return scored.select(
        key,
        F.struct("age", "sex_label", "orec_label", "disabl", "origdis").alias("demographics_derived"),
        details.alias("active_hccs"),
        F.expr(by_file_order("groups_active", [g for g, _ in ref.groups], ref)).alias("diag_categories_triggered"),
        F.expr(by_file_order("interactions_active", [i for i, _, _ in ref.interactions], ref)).alias("interactions_triggered"),
        scores(ref.ce_models).alias("ce_scores"),
        scores(ref.ne_models).alias("ne_scores"),
        scores(ref.models).alias("all_scores"),
        "applicable_model",
        "applicable_score",
    )


def scores_long(scored: DataFrame, models: list[str], key: str = "member_id") -> DataFrame:
    """(member, model, score, applicable), one row per model."""
    entries = ", ".join(f"'{m}', {m}" for m in models)
    return scored.selectExpr(key, "applicable_model", f"stack({len(models)}, {entries}) AS (model, score)").selectExpr(
        key, "model", "score", "model = applicable_model AS applicable"
    )


def variable_rows(scored: DataFrame, positions: str, ref: RefData, name: str, key: str = "member_id") -> DataFrame:
    """(member, name) for one of the position arrays."""
    # explode_outer, because the filter that explode implies would be pushed below the
    # model and compute it a second time
    return scored.select(key, F.explode_outer(F.expr(names_of(positions, ref))).alias(name)).where(f"{name} IS NOT NULL")


def suppression_audit(scored: DataFrame, ref: RefData, key: str = "member_id") -> DataFrame:
    """(member, suppressed, suppressed_by): why a category is not active."""
    pairs = F.broadcast(ref.hierarchy_table(scored.sparkSession))
    return (
        scored.select(key, "hcc_initial", F.explode_outer(F.array_except("hcc_initial", "hcc_active")).alias("suppressed_pos"))
        .join(pairs, "suppressed_pos")
        .where(F.array_contains("hcc_initial", F.col("hcc_pos")))
        .select(key, "suppressed", F.col("hcc").alias("suppressed_by"))
    )


def contributions(scored: DataFrame, ref: RefData, key: str = "member_id") -> DataFrame:
    """Coefficient rows behind each applicable score, largest first within a member."""
    spark = scored.sparkSession
    factors = F.broadcast(ref.factor_table(spark).withColumnRenamed("model", "applicable_model"))
    months = F.array(F.struct(F.lit(ref.position("LTIMCAID")).alias("variable_pos"), F.col("ltimcaid").alias("value")))
    ones = F.transform("variables_active", lambda i: F.struct(i.alias("variable_pos"), F.lit(1).alias("value")))
    rows = (
        scored.select(key, "applicable_model", F.explode_outer(F.concat(ones, months)).alias("v"))
        .select(key, "applicable_model", "v.variable_pos", "v.value")
        .where(F.col("value") != 0)
        .join(factors, ["variable_pos", "applicable_model"])
        .withColumn("contribution", F.col("coef") * F.col("value"))
    )
    order = Window.partitionBy(key).orderBy(F.desc("contribution"), F.asc("variable"))
    return rows.withColumn("impact_rank", F.row_number().over(order)).select(
        key,
        F.col("applicable_model").alias("model"),
        "variable",
        "label",
        F.col("contribution").cast("double").alias("contribution"),
        "impact_rank",
    )


def what_if(members: DataFrame, dx: DataFrame, added: DataFrame, code_map: DataFrame, ref: RefData, key: str = "member_id") -> DataFrame:
    """Scores before and after hypothetical codes, for the members that get some.

    One aggregate by member keeps what the added codes bring apart; both scores are then
    expressions over the same row. Diagnoses of members that are not asked stay behind.
    """
    keys = added.select(key).distinct()
    tagged = dx.select(key, "icd10").join(keys, key, "left_semi").withColumn("added", F.lit(False)).unionByName(
        added.select(key, "icd10").withColumn("added", F.lit(True))
    )
    items = category_items(tagged, code_map, ref, key, added="added")
    both = member_features(readable_members(members).join(keys, key, "left_semi")).join(items, key, "left")
    for name in ("packed", "items"):
        both = both.withColumn(f"{name}_after", F.concat(name, f"{name}_added")).drop(f"{name}_added")
    carried = [c for c in both.columns if c not in ("packed", "items")]
    before = with_model(both, ref).select(*carried, F.struct(*ref.models).alias("before"))
    after = with_model(before.withColumnsRenamed({"packed_after": "packed", "items_after": "items"}), ref)
    entries = ", ".join(f"'{m}', before.{m}, {m}" for m in ref.models)
    return after.selectExpr(key, f"stack({len(ref.models)}, {entries}) AS (model, score, score_after)").withColumn(
        "difference", F.round(F.col("score_after") - F.col("score"), 3)
    )
