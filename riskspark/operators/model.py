"""From a member's categories to active variables and nine scores, all in one row.

Variables are positions in ``ref.variables``; every step is an array expression over
constant arrays, so scoring adds neither a join nor a shuffle. The functions return SQL
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.diagnoses import edits_hold, packed_holds
from riskspark.sources.refdata import UNITS, RefData


def surviving_categories(packed: str, items: str, mce_edits: bool = True) -> str:
    """Positions of the categories with at least one row that passes the edits."""
    simple = f"transform(filter({packed}, p -> {packed_holds('p')}), p -> int(shiftright(p, 30)))"
    others = f"transform(filter({items}, x -> {edits_hold('x.', mce_edits)}), x -> x.hcc_pos)"
    return f"coalesce(array_sort(array_distinct(concat({simple}, {others}))), cast(array() AS array<int>))"


def apply_hierarchy(categories: str, ref: RefData) -> str:
    """Drop what any active category suppresses, judged on the set before dropping."""
    dropped = f"flatten(transform(c, i -> element_at({ref.suppressed_by()}, i)))"
    return f"transform(array({categories}), c -> array_except(c, {dropped}))[0]"


def active_groups(categories: str, ref: RefData) -> str:
    return f"array_sort(array_distinct(flatten(transform({categories}, i -> element_at({ref.groups_of()}, i)))))"


def active_interactions(variables: str, ref: RefData) -> str:
    """Positions of the interactions both of whose factors are active, in file order."""
    has = lambda name: f"array_contains(v, {ref.position(name)})"
    terms = [f"if({has(a)} AND {has(b)}, {ref.position(name)}, null)" for name, a, b in ref.interactions]
    return f"transform(array({variables}), v -> array_compact(array({', '.join(terms)})))[0]"


def positions_of(names: list[str], ref: RefData) -> str:
    """Positions of the non-null names among a few scalar expressions."""
    known = ref.names()
    found = [f"int(array_position({known}, {n}))" for n in names]
    return f"filter(array({', '.join(found)}), i -> i > 0)"


def score(variables: str, model: str, ref: RefData) -> str:
    """Exact sum of the model's coefficients, three decimals.

    All variables are flags except ``ltimcaid``, which multiplies its coefficient.
    """
    total = f"aggregate({variables}, 0L, (acc, i) -> acc + element_at({ref.coefficients(model)}, i))"
    months = int(ref.factors.get("LTIMCAID", {}).get(model, 0) * UNITS)
    if months:
        total = f"{total} + ltimcaid * {months}L"
    return f"round(({total}) / {UNITS}D, 3)"


def with_model(df: DataFrame, ref: RefData, mce_edits: bool = True) -> DataFrame:
    """Adds the position arrays and one score column per model.

    ``df`` has the columns of ``member_features`` and of ``category_items`` (null for a
    member without mapped codes).
    """
    carried = [c for c in df.columns if c not in ("packed", "items")]
    flags = positions_of(
        [
            "ce_cell",
            "originally_disabled",
            "if(disabl = 1, 'DISABL', null)",
            "if(origdis = 1, 'ORIGDIS', null)",
            "if(origdis = 1, 'ORIGDS', null)",
            "ne_variable",
        ],
        ref,
    )
    df = df.selectExpr(*carried, f"{surviving_categories('packed', 'items', mce_edits)} AS hcc_initial")
    df = df.selectExpr("*", f"{apply_hierarchy('hcc_initial', ref)} AS hcc_active")
    df = df.selectExpr("*", f"{active_groups('hcc_active', ref)} AS groups_active")
    df = df.selectExpr("*", f"concat({flags}, hcc_active, groups_active) AS factors_active")
    df = df.selectExpr("*", f"{active_interactions('factors_active', ref)} AS interactions_active")
    df = df.selectExpr("*", "concat(factors_active, interactions_active) AS variables_active").drop("factors_active")
    return df.selectExpr("*", *[f"{score('variables_active', m, ref)} AS {m}" for m in ref.models])


def pick_score(ref: RefData) -> str:
    """Score of the applicable model; 0.0 where the model is unknown."""
    return "CASE applicable_model " + " ".join(f"WHEN '{m}' THEN {m}" for m in ref.models) + " ELSE 0D END"


def names_of(positions: str, ref: RefData) -> str:
    return f"transform({positions}, i -> element_at({ref.names()}, i))"


def hccs_by_number(positions: str, ref: RefData) -> str:
    """Structs (number, hcc, description) of the active categories, ordered by number."""
    name = f"element_at({ref.names()}, i)"
    number = rf"coalesce(try_cast(regexp_replace({name}, r'\D', '') AS int), 0)"
    return f"""array_sort(transform({positions}, i -> named_struct(
        'number', {number}, 'hcc', {name}, 'description', element_at({ref.label_array()}, i))))"""


def by_file_order(positions: str, order: list[str], ref: RefData) -> str:
    """Names of the active positions in the order of the reference file."""
    wanted = ", ".join(str(ref.position(n)) for n in order)
    return names_of(f"filter(array({wanted}), i -> array_contains({positions}, i))", ref)


def joined_hccs(positions: str, ref: RefData) -> str:
    return f"array_join(transform({hccs_by_number(positions, ref)}, x -> x.hcc), ' ')"


def joined_groups(ref: RefData) -> str:
    return f"array_join({by_file_order('groups_active', [g for g, _ in ref.groups], ref)}, ' ')"


def joined_interactions(ref: RefData) -> str:
    return f"array_join({by_file_order('interactions_active', [i for i, _, _ in ref.interactions], ref)}, ' ')"
