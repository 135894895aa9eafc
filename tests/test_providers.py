"""Provider runs on a small table: nothing predicted, null codes, no member, one hot case."""

import pytest

from riskspark.plans import providers, roster
from riskspark.sources.refdata import builtin_refdata

REF = builtin_refdata()
MEMBERS = "case_id int, dob string, sex string, orec int, dual_status int, ltimcaid int, nemcaid int"


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    code_map = make([(f"X{c}", str(c)) for c in range(1, 200)], "icd10 string, cc string")
    return {
        "cases": make([(c, p) for c in (1, 2, 3, 4) for p in ("a", "b") if (c, p) != (3, "b")], "case_id int, provider string"),
        "predicted": make(
            [(1, "a", "X18"), (1, "a", " x18 "), (1, "b", "X85"), (1, "b", None), (2, "a", "none"), (3, "a", "X18"), (9, "a", "X18")]
            + [(4, "a", f"X{i % 100}") for i in range(3000)],
            "case_id int, provider string, icd10 string",
        ),
        "gold": make([(1, "X18"), (1, "X18"), (2, None), (3, "X85"), (4, "X1")], "case_id int, icd10 string"),
        "timings": make([(1, "a", "extract", 0.2), (1, "a", "extract", 0.1), (1, "a", None, 1.0), (9, "b", "x", 5.0)], "case_id int, provider string, step string, seconds double"),
        "members": make([(1, "1950-01-21", "2", 0, 0, 0, 0), (2, "1950-01-21", "x", 0, 0, 0, 0), (4, "1950-01-21", "2", 0, 0, 0, 0)], MEMBERS),
        "code_map": code_map,
    }


def test_runs(spark, tables):
    t = tables
    runs = providers.provider_runs(*[t[k] for k in ("cases", "predicted", "gold", "timings", "members", "code_map")], REF, ["a", "b"])
    rows = {(r.case_id, r.provider): r for r in runs.collect()}
    assert set(rows) == {(c, p) for c in (1, 2, 3, 4) for p in "ab"} - {(3, "b")}
    one = rows[1, "a"]
    assert one.code_list == [" x18 ", "X18"] and one.hccs == "HCC18" and one.latency_total == 1.3
    assert (one.code_precision, one.code_recall) == (0.5, 1.0)
    assert rows[1, "b"].code_list == ["X85"] and rows[1, "b"].code_f1 == 0.0 and rows[1, "b"].latency_total is None
    # no gold counts as found, nothing predicted as imprecise; unreadable or absent members have no score
    assert (rows[2, "a"].code_recall, rows[2, "b"].code_precision) == (1.0, 0.0)
    assert rows[2, "a"].score is None and rows[3, "a"].score is None and rows[3, "a"].hccs == ""
    assert len(rows[4, "a"].code_list) == 100 and rows[4, "b"].code_list == []
    scored = roster.score_roster(t["members"], t["predicted"].where("provider = 'a'"), t["code_map"], REF, key="case_id")
    assert rows[4, "a"].score == scored.where("case_id = 4").first().applicable_score

    side = {r.case_id: r for r in providers.provider_compare(runs, "a", "b").collect()}
    assert side[1].code_difference == " x18  X18 X85" and side[2].code_difference == "none" and side[3].code_difference is None
    assert side[3].codes_b is None and side[4].codes_b == ""
    empty = providers.provider_runs(*[t[k].where("false") for k in ("cases", "predicted", "gold", "timings", "members", "code_map")], REF, ["a", "b"])
    assert empty.count() == 0


def test_few_exchanges(tables):
    t = tables
    runs = providers.provider_runs(*[t[k] for k in ("cases", "predicted", "gold", "timings", "members", "code_map")], REF, ["a", "b"])
    plan = providers.provider_compare(runs, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 3, plan
