"""Evaluation metrics as batch jobs.

Per-case results come from sums over long tables (case, code), so a case may hold any
share of the rows; nothing is collected per case beyond a top k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import phi
from riskspark.sources import fixed_values as fv


def rounded_mean(value: str, digits: int = 3) -> Column:
    """Mean of the values as reported (already rounded); 0.0 without rows."""
    return F.coalesce(F.round(F.avg(F.round(value, digits)), digits), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def set_overlap(predicted: DataFrame, gold: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per case: tp, n_predicted, n_gold over distinct items; one pass, no join."""
    both = predicted.select(*keys, item, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        gold.select(*keys, item, F.lit(0).alias("p"), F.lit(1).alias("g"))
    )
    per_item = both.groupBy(*keys, item).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return per_item.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum("p").alias("n_predicted"), F.sum("g").alias("n_gold")
    )


def prf_columns(tp: Column, n_predicted: Column, n_gold: Column) -> list[Column]:
    p = F.when(n_predicted > 0, tp / n_predicted).otherwise(0.0)
    r = F.when(n_gold > 0, tp / n_gold).otherwise(1.0)
    return [F.round(p, 3).alias("code_precision"), F.round(r, 3).alias("code_recall"), F.round(harmonic(p, r), 3).alias("code_f1")]


def code_prf(cases: DataFrame, predicted: DataFrame, gold: DataFrame, keys: list[str], item: str = "icd10") -> DataFrame:
    """Precision, recall and F1 of the code set of each case; F1 from unrounded parts."""
    counts = cases.select(*keys).distinct().join(set_overlap(predicted, gold, keys, item), keys, "left").fillna(0)
    return counts.select(*keys, *prf_columns(F.col("tp"), F.col("n_predicted"), F.col("n_gold")))


# retrieval ---------------------------------------------------------------------------


def _order() -> Column:
    return F.struct((-F.col("similarity")).alias("s"), F.col("ord").alias("o"), F.col("rank").alias("r"))


def retrieval_eval(cases: DataFrame, pool: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (6, 10), case: str = "case_id") -> DataFrame:
    """Per case: n_retrieved, mrr, recall at each k, precision of the pool, n_missing.

    ``pool`` is (case, doc, similarity, ord, rank), ``gold`` (case, doc), duplicates
    counted. The rank of the first gold document is the number of pool rows before it
    plus one, a sum rather than a sort of the whole pool.
    """
    pool = pool.withColumn("o", _order())
    wanted = gold.groupBy(case, "doc").agg(F.count(F.lit(1)).alias("times"))
    n_gold = wanted.groupBy(case).agg(F.sum("times").alias("n_gold"))
    # one pass over pool and gold by (case, doc)
    met = (
        pool.select(case, "doc", "o")
        .join(wanted, [case, "doc"], "full_outer")
        .groupBy(case)
        .agg(
            F.count("o").alias("n_retrieved"),
            F.min(F.when(F.col("times").isNotNull(), F.col("o"))).alias("first_gold"),
            F.count(F.when(F.col("times").isNotNull() & F.col("o").isNotNull(), 1)).alias("n_hits"),
            F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("times"))), F.lit(0)).alias("n_missing"),
        )
    )
    before = (
        pool.select(case, "o")
        .join(met.select(case, "first_gold").where("first_gold IS NOT NULL"), case)
        .groupBy(case)
        .agg(F.count(F.when(F.col("o") < F.col("first_gold"), 1)).alias("before"))
    )
    best = Window.partitionBy(case).orderBy("o")
    top = pool.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= max(ks)).select(case, "doc", "rn")
    recalled = (
        top.join(wanted, [case, "doc"])
        .groupBy(case)
        .agg(*[F.sum(F.when(F.col("rn") <= k, F.col("times")).otherwise(0)).alias(f"hit_{k}") for k in ks])
    )
    out = (
        cases.select(case).distinct()
        .join(n_gold, case, "left").join(met, case, "left").join(before, case, "left").join(recalled, case, "left")
        .fillna(0, ["n_gold", "n_retrieved", "n_hits", "n_missing", *[f"hit_{k}" for k in ks]])
    )
    return out.select(
        case,
        "n_gold",
        "n_retrieved",
        F.coalesce(F.round(1 / (F.col("before") + 1), 3), F.lit(0.0)).alias("mrr"),
        *[F.when(F.col("n_gold") > 0, F.round(F.col(f"hit_{k}") / F.col("n_gold"), 3)).otherwise(1.0).alias(f"recall_{k}") for k in ks],
        F.when(F.col("n_retrieved") > 0, F.round(F.col("n_hits") / F.col("n_retrieved"), 3)).otherwise(0.0).alias("precision_pool"),
        "n_missing",
    )


def retrieval_missing(pool: DataFrame, gold: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, doc): gold documents that no query of the case retrieved."""
    return gold.join(pool.select(case, "doc"), [case, "doc"], "left_anti").select(case, "doc")


def retrieval_means(per_case: DataFrame, ks: tuple[int, ...] = (6, 10)) -> DataFrame:
    return per_case.agg(
        F.count(F.lit(1)).alias("n_cases"), rounded_mean("mrr").alias("mrr"), *[rounded_mean(f"recall_{k}").alias(f"recall_{k}") for k in ks]
    )


# de-identification -------------------------------------------------------------------


def phi_cases_eval(cases: DataFrame, key: str = "note_id") -> DataFrame:
    """Per case from columns expected, found (arrays of types), must_survive, sanitized_text."""
    return cases.selectExpr(
        key,
        "array_join(array_sort(array_distinct(expected)), ' ') AS expected_entities",
        "array_join(array_sort(array_distinct(found)), ' ') AS found_entities",
        "array_join(array_sort(array_except(expected, found)), ' ') AS missed",
        "array_join(array_sort(array_except(found, expected)), ' ') AS extra",
        "size(array_intersect(expected, found)) AS tp",
        "size(array_except(found, expected)) AS fp",
        "size(array_except(expected, found)) AS fn",
        "size(must_survive) AS n_terms",
        "size(filter(must_survive, t -> contains(lower(sanitized_text), lower(t)))) AS n_survived",
        "array_join(filter(must_survive, t -> NOT contains(lower(sanitized_text), lower(t))), ' ') AS corrupted",
    )


def phi_means(per_case: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 (from the rounded two), and the survival rate."""
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 3)).otherwise(1.0)
    sums = per_case.agg(
        F.count(F.lit(1)).alias("n_cases"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "n_terms", "n_survived")]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = sums.select(
        "n_cases",
        ratio(tp, tp + fp).alias("entity_precision"),
        ratio(tp, tp + fn).alias("entity_recall"),
        ratio(F.col("n_survived"), F.col("n_terms")).alias("clinical_survival_rate"),
    )
    return out.withColumn("entity_f1", F.round(harmonic(F.col("entity_precision"), F.col("entity_recall")), 3))


# output audit ------------------------------------------------------------------------


def audit_records(clinical: DataFrame, phi_records: DataFrame) -> DataFrame:
    """(record_id, output, phi_values): clinical records carry no identifier values."""
    none = F.expr("cast(array() AS array<string>)")
    return clinical.select("record_id", "output", none.alias("phi_values")).unionByName(
        phi_records.select("record_id", "output", F.expr(phi.raw_identifiers("prompt")).alias("phi_values"))
    )


def leaks(records: DataFrame) -> DataFrame:
    """Adds leaked: the record's identifiers found in its output, whatever their case."""
    return records.withColumn("leaked", F.expr("filter(phi_values, v -> v != '' AND contains(lower(output), lower(v)))"))


def toxic_hits(records: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Adds terms: lexicon terms found in the output."""
    words = ", ".join(f"'{t}'" for t in (terms or fv.TOXIC_TERMS))
    return records.withColumn("terms", F.expr(f"filter(array({words}), t -> contains(lower(output), t))"))


def pipeline_audit(sanitized: DataFrame, summaries: DataFrame, key: str = "note_id") -> DataFrame:
    """What a run has written, held against the identifiers of each raw note.

    ``sanitized`` has the sanitized text and ``identifiers``, taken from the raw text before
    it was dropped; ``summaries`` is (key, summary). Per note: n_identifiers, the identifiers
    left in the text and in the summary, and lexicon terms in either. Texts are read where
    they lie; only identifiers and hits meet the summaries. A missing text or summary leaks
    nothing.
    """
    words = ", ".join(f"'{t}'" for t in fv.TOXIC_TERMS)
    left_in = lambda c: f"filter(identifiers, v -> v != '' AND contains(lower({c}), lower(v)))"
    in_text = sanitized.selectExpr(
        key, "identifiers", f"{left_in('sanitized_text')} AS in_text", f"filter(array({words}), t -> contains(lower(sanitized_text), t)) AS said"
    )
    return in_text.join(summaries.select(key, "summary"), key, "left").selectExpr(
        key,
        "size(identifiers) AS n_identifiers",
        "in_text AS leaked_in_text",
        f"{left_in('summary')} AS leaked_in_summary",
        f"filter(array({words}), t -> array_contains(said, t) OR contains(lower(summary), t)) AS terms",
    )


def hit_rate(records: DataFrame, column: str, name: str) -> DataFrame:
    hit = F.when(F.size(column) > 0, 1.0).otherwise(0.0)
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(hit).cast("bigint"), F.lit(0)).alias("n_hits"),
        F.coalesce(F.round(F.avg(hit), 3), F.lit(0.0)).alias(name),
    )


# providers ---------------------------------------------------------------------------


def provider_aggregate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_cases"), rounded_mean("code_f1").alias("mean_f1"), rounded_mean("latency_total").alias("mean_latency")
    )
