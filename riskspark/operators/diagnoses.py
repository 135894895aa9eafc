"""Diagnosis codes to condition categories, with age and sex edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.codes import normalize_code, tolerant_int
from riskspark.functions.rules import (
    MAX_AGE,
    MIN_AGE,
    compile_rule,
    interval_ends,
    is_interval,
    rule_fails_open,
    rule_holds,
)
from riskspark.sources.refdata import RefData

EDIT_COLUMNS = ("MCE_AGE_CONDITION", "AGE_EDIT_CONDITION", "SEX_EDIT_CONDITION")


RULE_COLUMNS = ("mce_rule", "age_rule", "sex_rule")
#: Distinct combinations of rules that are sent to every task; Spark chooses how more of them join.
SENT_RULES = 10_000


def _with_texts(code_map: DataFrame) -> DataFrame:
    """(icd10, cc, rules as text) of the rows with a readable category number; absent edit columns count as empty."""
    text = {c: f"string({c})" if c in code_map.columns else "string(null)" for c in EDIT_COLUMNS}
    return code_map.selectExpr(
        f"{normalize_code('icd10')} AS icd10", f"{tolerant_int('cc')} AS cc", *[f"{text[c]} AS {name}" for c, name in zip(EDIT_COLUMNS, RULE_COLUMNS, strict=True)]
    ).where("cc IS NOT NULL")


def _with_rules(typed: DataFrame, strict_rules: bool, *more: str) -> DataFrame:
    """``typed`` with mce, age_edit, sex_edit and ``more``, expressions of these three.

    A map has many rows and few rules: each combination of rule texts is read once, not once a row.
    """
    found = typed.select(*RULE_COLUMNS).distinct()
    few = found.limit(SENT_RULES + 1).count() <= SENT_RULES
    read = found.selectExpr(
        *[f"{c} AS its_{c}" for c in RULE_COLUMNS],
        f"{compile_rule('mce_rule', strict_rules)} AS mce",
        f"{compile_rule('age_rule', strict_rules)} AS age_edit",
        f"{tolerant_int('sex_rule')} AS sex_edit",
    ).selectExpr("*", *more)
    same = [typed[c].eqNullSafe(F.col(f"its_{c}")) for c in RULE_COLUMNS]
    return typed.join(F.broadcast(read) if few else read, same).drop(*[f"its_{c}" for c in RULE_COLUMNS])


def prepare_code_map(code_map: DataFrame, strict_rules: bool = False) -> DataFrame:
    """Typed map: (icd10, cc, mce_rule, age_rule, sex_rule, mce, age_edit, sex_edit).

    Rows without a readable category number are left out; absent edit columns count as
    empty. Several rows per code are kept.
    """
    return _with_rules(_with_texts(code_map), strict_rules)


def normalize_diagnoses(dx: DataFrame) -> DataFrame:
    return dx.withColumn("icd10", F.expr(normalize_code("icd10"))).where("icd10 != ''")


def edits_hold(row: str = "", mce_edits: bool = True) -> str:
    """SQL: all edits of one map row hold for a member's ``age`` and ``sex``.

    ``row`` is the prefix of the map columns, such as ``x.`` for a struct ``x``.
    """
    conditions = [rule_holds(f"{row}age_edit", "age"), f"coalesce({row}sex_edit = sex, true)"]
    if mce_edits:
        conditions.append(rule_holds(f"{row}mce", "age"))
    return "(" + " AND ".join(conditions) + ")"


def typed_categories(code_map: DataFrame, ref: RefData, mce_edits: bool = True) -> DataFrame:
    """(icd10, packed, item): each map row whose category is in the model, with its edits.

    A category whose edits are one age interval and at most one sex, which is nearly
    every row of a real map, travels as one number (``packed``); others as ``item``.
    """
    rules = ["age_edit"] + (["mce"] if mce_edits else [])
    ends = [interval_ends(r) for r in rules]
    low = f"greatest({', '.join(lo for lo, _ in ends)})" if len(ends) > 1 else ends[0][0]
    high = f"least({', '.join(hi for _, hi in ends)})" if len(ends) > 1 else ends[0][1]
    simple = " AND ".join([*(is_interval(r) for r in rules), "coalesce(sex_edit BETWEEN 0 AND 14, true)"])
    edits = f"shiftleft({low} - {MIN_AGE}, 17) | shiftleft({high} - {MIN_AGE}, 4) | bigint(coalesce(sex_edit + 1, 0))"
    return (
        _with_rules(_with_texts(code_map), False, f"if({simple}, {edits}, null) AS edits")
        .selectExpr("icd10", f"int(get({ref.position_of_cc()}, cc)) AS hcc_pos", "mce", "age_edit", "sex_edit", "edits")
        .where("hcc_pos > 0")
        .selectExpr(
            "icd10", "shiftleft(bigint(hcc_pos), 30) | edits AS packed", "if(edits IS NULL, struct(hcc_pos, mce, age_edit, sex_edit), null) AS item"
        )
    )


def category_items(
    dx: DataFrame, code_map: DataFrame, ref: RefData, key: str = "member_id", mce_edits: bool = True, added: str | None = None
) -> DataFrame:
    """Per member, the distinct (category, edits) that its codes point to.

    The map joins before the shuffle (Spark broadcasts it while its size allows, and
    splits hot codes of a shuffled join otherwise). The sets hold at most one entry per
    category and edit combination and are built on the map side first, so a member with
    any number of rows sends one small row per task: one shuffle, by member.

    ``added`` names a boolean column of ``dx``: its rows are kept apart as
    ``packed_added`` and ``items_added``, in the same aggregate.
    """
    tags = [added] if added else []
    mapped = normalize_diagnoses(dx).select(key, "icd10", *tags).join(typed_categories(code_map, ref, mce_edits), "icd10")
    sets = {"packed": "packed", "items": "item"}
    if not added:
        return mapped.groupBy(key).agg(*[F.collect_set(c).alias(name) for name, c in sets.items()])
    own = [F.collect_set(F.when(~F.col(added), F.col(c))).alias(name) for name, c in sets.items()]
    more = [F.collect_set(F.when(F.col(added), F.col(c))).alias(f"{name}_added") for name, c in sets.items()]
    return mapped.groupBy(key).agg(*own, *more)


def arriving_items(dx: DataFrame, code_map: DataFrame, ref: RefData, key: str = "member_id", mce_edits: bool = True) -> DataFrame:
    """The sets of ``category_items`` as a streaming aggregate, with ``n_rows`` seen so far.

    Members whose codes are on no map row have a row as well, with empty sets.
    """
    codes = dx.withColumn("icd10", F.expr(normalize_code("icd10"))).select(key, "icd10")
    return (
        codes.join(typed_categories(code_map, ref, mce_edits), "icd10", "left")
        .groupBy(key)
        .agg(F.collect_set("packed").alias("packed"), F.collect_set("item").alias("items"), F.count(F.lit(1)).alias("n_rows"))
    )


def packed_holds(p: str) -> str:
    """SQL: the edits of a packed category hold for ``age`` and ``sex``."""
    age = f"(greatest({MIN_AGE}, least({MAX_AGE}, age)) - {MIN_AGE})"
    interval = f"{age} BETWEEN (shiftright({p}, 17) & 8191) AND (shiftright({p}, 4) & 8191)"
    return f"({interval} AND (({p} & 15) = 0 OR ({p} & 15) - 1 = sex))"


def _mapped(members: DataFrame, dx: DataFrame, code_map: DataFrame, key: str) -> DataFrame:
    """Distinct member codes with their count, map rows and demographics.

    Counting per member and code first spreads a hot member over its codes and a hot
    code over its members.
    """
    repeats = normalize_diagnoses(dx).groupBy(key, "icd10").agg(F.count(F.lit(1)).alias("repeats"))
    return repeats.join(prepare_code_map(code_map), "icd10").join(members.select(key, "age", "sex"), key)


def code_to_category(members: DataFrame, dx: DataFrame, code_map: DataFrame, key: str = "member_id", mce_edits: bool = True) -> DataFrame:
    """Long form of the code→categories list: (member, icd10, cc, n).

    ``n`` is how often the pair occurs, so repeats are kept without a list that grows
    with them. ``members`` needs ``age`` and ``sex``.
    """
    kept = _mapped(members, dx, code_map, key).where(edits_hold("", mce_edits))
    return kept.groupBy(key, "icd10", "cc").agg(F.sum("repeats").alias("n"))


def edit_report(members: DataFrame, dx: DataFrame, code_map: DataFrame, key: str = "member_id") -> DataFrame:
    """Per rule combination: mapped rows, rows lost to each edit in turn, rows kept."""
    outcome = _mapped(members, dx, code_map, key).selectExpr(
        "mce_rule",
        "age_rule",
        "sex_rule",
        "repeats",
        f"{rule_holds('mce', 'age')} AS mce_ok",
        f"{rule_holds('age_edit', 'age')} AS age_ok",
        "coalesce(sex_edit = sex, true) AS sex_ok",
        f"({rule_fails_open('age_rule', 'age_edit')} OR {rule_fails_open('mce_rule', 'mce')}) AS fails_open",
    )
    rows = lambda cond: F.expr(f"sum(if({cond}, repeats, 0))")
    return outcome.groupBy("mce_rule", "age_rule", "sex_rule").agg(
        F.sum("repeats").alias("n_rows"),
        rows("NOT mce_ok").alias("n_mce_dropped"),
        rows("mce_ok AND NOT age_ok").alias("n_age_dropped"),
        rows("mce_ok AND age_ok AND NOT sex_ok").alias("n_sex_dropped"),
        rows("mce_ok AND age_ok AND sex_ok").alias("n_kept"),
        F.max("fails_open").alias("fails_open"),
    )
