"""Columns derived from a member's demographics, written as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.sources import fixed_values as fv

DEFAULTS = {"sex": fv.DEFAULT_SEX, "orec": 0, "ltimcaid": 0, "nemcaid": 0, "dual_status": 0}


def parse_dob(dob: str) -> str:
    """Year-month-day, one or two digits each for month and day; else the default."""
    return rf"""coalesce(
        CASE WHEN string({dob}) rlike r'^\d{{4}}-\d{{1,2}}-\d{{1,2}}$' THEN try_to_date(string({dob}), 'yyyy-M-d') END,
        DATE '{fv.DEFAULT_DOB}')"""


def age_at(dob: str, cutoff: str = fv.CUTOFF_DATE) -> str:
    """Completed years; a birthday on the cutoff itself counts. May be negative."""
    year, month, day = (int(x) for x in cutoff.split("-"))
    after = f"(month({dob}) > {month} OR (month({dob}) = {month} AND day({dob}) > {day}))"
    return f"int({year} - year({dob}) - int({after}))"


def band_name(age: str, lower_bounds: list[int]) -> str:
    """``35_44``, ``65`` for a one-year band, ``95_GT`` for the last; null below zero."""
    ends: list[int | None] = [b - 1 for b in lower_bounds[1:]] + [None]
    cases = []
    for low, high in zip(lower_bounds, ends):
        name = f"{low}_GT" if high is None else (str(low) if low == high else f"{low}_{high}")
        cases.append(f"WHEN {age} >= {low} THEN '{name}'")
    return f"CASE {' '.join(reversed(cases))} END"


def applicable_model(age: str, ltimcaid: str, dual_status: str) -> str:
    return f"""CASE
        WHEN {ltimcaid} = 1 THEN 'INSTITUTIONAL'
        WHEN {age} >= 65 THEN CASE {dual_status} WHEN 2 THEN 'COMMUNITY_FBA' WHEN 1 THEN 'COMMUNITY_PBA' ELSE 'COMMUNITY_NA' END
        ELSE CASE {dual_status} WHEN 2 THEN 'COMMUNITY_FBD' WHEN 1 THEN 'COMMUNITY_PBD' ELSE 'COMMUNITY_ND' END
        END"""


def unreadable_columns(members: DataFrame) -> str:
    """SQL: names of a member's demographics that are present but no whole numbers."""
    present = [c for c in DEFAULTS if c in members.columns]
    found = [f"if({c} IS NOT NULL AND try_cast({c} AS int) IS NULL, '{c}', null)" for c in present]
    return f"array_compact(array({', '.join(found)}))" if found else "cast(array() AS array<string>)"


def bad_demographics(members: DataFrame) -> DataFrame:
    """Members whose demographics are present but no whole numbers."""
    return members.where(f"size({unreadable_columns(members)}) > 0")


def readable_members(members: DataFrame) -> DataFrame:
    """The others: those that can be scored. Whole-number columns need no test."""
    texts = members.select(*[c for c, t in members.dtypes if c in DEFAULTS and t != "int"])
    return members.where(f"size({unreadable_columns(texts)}) = 0") if texts.columns else members


def with_defaults(members: DataFrame) -> DataFrame:
    """Absent columns and null values take the defaults; ``dob`` becomes a date."""
    given = lambda c: c if c in members.columns else "null"
    kept = [c for c in members.columns if c not in DEFAULTS and c != "dob"]
    return members.selectExpr(
        *kept,
        f"{parse_dob(given('dob'))} AS dob",
        *[f"coalesce(try_cast({given(c)} AS int), {default}) AS {c}" for c, default in DEFAULTS.items()],
    )


def member_features(members: DataFrame, cutoff: str = fv.CUTOFF_DATE) -> DataFrame:
    """Age, flags, age/sex cells of both model families, labels, applicable model.

    Narrow: projections over the roster, no shuffle.
    """
    orec_label = " ".join(f"WHEN {code} THEN '{text}'" for code, text in fv.OREC_LABELS.items())
    df = with_defaults(members).selectExpr("*", f"{age_at('dob', cutoff)} AS age")
    df = df.selectExpr(
        "*",
        "int(age < 65 AND orec IN (1, 2, 3)) AS disabl",
        "int(orec = 1 AND NOT (age < 65 AND orec IN (1, 2, 3))) AS origdis",
        "int(age >= 65 AND orec = 1) AS ne_origdis",
        # At 64 the new-enrollee cell depends on entitlement: with entitlement by age it
        # is the cell of 65.
        "if(age = 64 AND orec = 0, 65, age) AS ne_age",
        "if(sex = 1, 'M', 'F') AS sex_letter",
    )
    df = df.selectExpr(
        "*",
        f"concat(sex_letter, {band_name('age', fv.CE_AGE_BANDS)}) AS ce_cell",
        f"concat('NE', sex_letter, {band_name('ne_age', fv.NE_AGE_BANDS)}) AS ne_cell",
        """CASE WHEN nemcaid IN (0, 1)
             THEN concat(if(nemcaid = 1, 'MCAID', 'NMCAID'), if(ne_origdis = 1, '_ORIGDIS', '_NORIGDIS')) END AS ne_status""",
        """CASE WHEN origdis = 1 AND sex = 2 THEN 'OriginallyDisabled_Female'
                WHEN origdis = 1 AND sex = 1 THEN 'OriginallyDisabled_Male' END AS originally_disabled""",
        "if(sex = 1, 'Male', 'Female') AS sex_label",
        f"CASE orec {orec_label} ELSE 'Unknown' END AS orec_label",
        f"{applicable_model('age', 'ltimcaid', 'dual_status')} AS applicable_model",
    )
    # Statuses with original disability have no cells below 65, and such a member is 65
    # or older by definition; at most one crossed variable is active per member.
    return df.withColumn("ne_variable", F.expr("concat(ne_status, '_', ne_cell)")).drop("sex_letter", "ne_age")
