"""Golden scores, edge members, and properties of the roster score."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions.demographics import bad_demographics, member_features
from riskspark.functions.rules import compile_rule, rule_fails_open, rule_holds
from riskspark.operators.diagnoses import code_to_category
from riskspark.plans import roster
from riskspark.sources import rejects
from riskspark.sources.refdata import builtin_refdata, category_name, load_refdata

REF = builtin_refdata()
SCHEMA = "member_id string, dob string, sex int, orec int, dual_status int, ltimcaid int, nemcaid int"

GOLDEN = {
    "G1": (("1950-01-21", 2, 0, 0, 0, 0), [18, 137, 85, 111], "COMMUNITY_NA", [2.268, 2.363, 2.694, 1.949, 2.047, 2.367, 2.452, 0.892, 1.480]),
    "G2": (("1951-06-15", 2, 0, 0, 0, 0), [18, 137, 85, 111], "COMMUNITY_NA", [2.268, 2.363, 2.694, 1.949, 2.047, 2.367, 2.452, 0.892, 1.480]),
    "G3": (("1975-07-04", 1, 1, 2, 0, 0), [85, 39, 6, 8, 9, 12], "COMMUNITY_FBD", [3.808, 3.662, 3.997, 4.455, 4.505, 5.095, 4.432, 0.834, 1.503]),
    "G4": (("1940-02-01", 2, 1, 1, 1, 1), [2, 157, 188, 114, 57, 112], "INSTITUTIONAL", [5.513, 5.451, 6.792, 4.707, 4.852, 5.551, 5.431, 1.619, 2.844]),
    "G5": (("1962-02-02", 1, 0, 0, 0, 0), [], "COMMUNITY_ND", [0, 0, 0, 0.303, 0.343, 0.486, 1.039, 0.514, 0.971]),
    "G6": (("1962-02-02", 1, 1, 0, 0, 0), [], "COMMUNITY_ND", [0, 0, 0, 0.303, 0.343, 0.486, 1.039, 0.923, 1.670]),
    "G7": (("1962-02-01", 2, 1, 0, 0, 1), [161, 106, 48, 46], "COMMUNITY_NA", [3.405, 3.145, 3.560, 4.694, 5.130, 5.996, 2.764, 1.566, 2.161]),
    "G8": (("2030-01-01", 2, 0, 0, 0, 0), [], "COMMUNITY_ND", [0] * 9),
}


def code_map(spark):
    return spark.createDataFrame([(f"X{c}", str(c)) for c in range(1, 200)], "icd10 string, cc string")


def score(spark, members, dx, mapping=None, **options):
    m = spark.createDataFrame(members, SCHEMA)
    d = spark.createDataFrame(dx, "member_id string, icd10 string")
    return roster.score_roster(m, d, mapping if mapping is not None else code_map(spark), REF, **options)


def test_golden_scores(spark):
    members = [(k, *demo) for k, (demo, *_) in GOLDEN.items()]
    dx = [(k, f" x{c} ") for k, (_, ccs, *_) in GOLDEN.items() for c in ccs]
    rows = {r.member_id: r for r in roster.member_result(score(spark, members, dx), REF).collect()}
    for k, (_, _, model, scores) in GOLDEN.items():
        assert rows[k].applicable_model == model
        assert [rows[k][m] for m in REF.models] == scores, k
        assert rows[k].applicable_score == scores[REF.models.index(model)]
    assert rows["G1"].active_hccs == "HCC18 HCC85 HCC111 HCC137"
    assert rows["G1"].diag_categories == "DIABETES CHF gCopdCF RENAL"
    assert rows["G1"].interactions == "HCC85_gDiabetesMellit HCC85_gCopdCF HCC85_gRenal CHF_gCopdCF DIABETES_CHF"
    assert rows["G3"].active_hccs == "HCC6 HCC8 HCC39 HCC85"


def test_record_is_nested(spark):
    r = roster.member_record(score(spark, [("G1", *GOLDEN["G1"][0])], [("G1", "X18"), ("G1", "X85")]), REF).first()
    assert r.demographics_derived.age == 77 and r.ce_scores["COMMUNITY_NA"] > 0 and len(r.all_scores) == 9
    assert [(h.hcc, h.description) for h in r.active_hccs][0] == ("HCC18", "Diabetes with Chronic Complications")


def test_permuting_and_repeating_codes_changes_nothing(spark):
    rng = random.Random(5)
    members, dx = [], []
    for i in range(20):
        demo = ("1950-05-05", 1 + i % 2, i % 4, i % 3, i % 2, i % 2)
        codes = rng.sample(REF.domain, 8)
        for copy in ("a", "b"):
            members.append((f"{i}{copy}", *demo))
        dx += [(f"{i}a", "X" + c[3:]) for c in codes]
        dx += [(f"{i}b", "X" + c[3:]) for c in rng.sample(codes * 3, 24)]
    rows = {r.member_id: r for r in roster.member_result(score(spark, members, dx), REF).collect()}
    for i in range(20):
        assert rows[f"{i}a"][1:] == rows[f"{i}b"][1:]


def test_suppressed_code_leaves_scores_alone(spark):
    pairs = [(h, x) for h, below in REF.hierarchy for x in below]
    members, dx = [], []
    for i, (h, x) in enumerate(pairs):
        members += [(f"{i}a", *GOLDEN["G1"][0]), (f"{i}b", *GOLDEN["G1"][0])]
        dx += [(f"{i}a", "X" + h[3:]), (f"{i}b", "X" + h[3:]), (f"{i}b", "X" + x[3:])]
    scored = score(spark, members, dx)
    rows = {r.member_id: r for r in roster.member_result(scored, REF).collect()}
    audit = {(r.member_id, r.suppressed, r.suppressed_by) for r in roster.suppression_audit(scored, REF).collect()}
    for i, (h, x) in enumerate(pairs):
        assert rows[f"{i}a"][1:] == rows[f"{i}b"][1:]
        assert (f"{i}b", x, h) in audit


def test_contributions_add_up(spark):
    members = [(k, *demo) for k, (demo, *_) in GOLDEN.items()]
    dx = [(k, f"X{c}") for k, (_, ccs, *_) in GOLDEN.items() for c in ccs]
    scored = score(spark, members, dx)
    sums = {r.member_id: r.s for r in roster.contributions(scored, REF).groupBy("member_id").agg(F.round(F.sum("contribution"), 3).alias("s")).collect()}
    for r in scored.collect():
        assert sums.get(r.member_id, 0.0) == r.applicable_score


def test_edge_demographics(spark):
    rows = [
        ("null", None, 2, 0, 0, 0, 0),
        ("bad", "not a date", 3, 9, 0, 2, 2),
        ("short", "1950-1-2", None, None, None, None, None),
        ("feb1", "1950-02-01", 1, 1, 0, 0, 0),
        ("feb2", "1950-02-02", 1, 1, 0, 0, 0),
    ]
    f = {r.member_id: r for r in member_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert f["null"].age == 77 and str(f["bad"].dob) == "1950-01-01"
    assert str(f["short"].dob) == "1950-01-02" and f["short"].sex == 2 and f["short"].orec == 0
    assert f["feb1"].age == 77 and f["feb2"].age == 76
    assert f["bad"].ce_cell.startswith("F") and f["bad"].orec_label == "Unknown" and f["bad"].ne_variable is None
    text = spark.createDataFrame([("a", "x"), ("b", "1"), ("c", None)], "member_id string, sex string")
    assert [r.member_id for r in bad_demographics(text).collect()] == ["a"]
    assert member_features(text.where("member_id = 'c'")).first().age == 77


def test_institutional_flag_multiplies(spark):
    demo = ("1940-01-01", 2, 0, 0)
    rows = {r.member_id: r.INSTITUTIONAL for r in score(spark, [("0", *demo, 0, 0), ("1", *demo, 1, 0), ("2", *demo, 2, 0)], []).collect()}
    coef = float(REF.factors["LTIMCAID"]["INSTITUTIONAL"])
    assert rows["1"] == round(rows["0"] + coef, 3) and rows["2"] == round(rows["0"] + 2 * coef, 3)


RULES = {
    "age >= 18": lambda a: a >= 18,
    "AGE = 18": lambda a: a == 18,
    "age == 18": lambda a: True,
    "age 50+": lambda a: a >= 50,
    "0 <= age <= 17": lambda a: 0 <= a <= 17,
    "age < 5 or age > 60": lambda a: a < 5 or a > 60,
    "age >= 18 and age < 65 or age = 90": lambda a: 18 <= a < 65 or a == 90,
    "age != 40": lambda a: a != 40,
    "age between 1 and 2": lambda a: True,
    "17": lambda a: True,
    "0": lambda a: False,
    "age>=12.5": lambda a: a >= 12.5,
    "age => 5": lambda a: True,
    "foo < 3": lambda a: True,
    "": lambda a: True,
    None: lambda a: True,
}


def test_age_rules(spark):
    ages = [-3, 0, 4, 12, 13, 17, 18, 40, 49, 50, 60, 61, 64, 65, 90]
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string").selectExpr("rule", f"{compile_rule('rule')} AS c")
    rows = rules.crossJoin(spark.createDataFrame([(a,) for a in ages], "age int")).selectExpr("rule", "age", f"{rule_holds('c', 'age')} AS ok", f"{rule_fails_open('rule', 'c')} AS open")
    for r in rows.collect():
        assert r.ok == RULES[r.rule](r.age), (r.rule, r.age)
        assert r.open == (r.rule in ("age == 18", "age between 1 and 2", "age => 5", "foo < 3", "")), r.rule
    strict = spark.createDataFrame([("age == 18", 18), ("age == 18", 19)], "rule string, age int").selectExpr(f"{rule_holds(compile_rule('rule', True), 'age')} AS ok")
    assert [r.ok for r in strict.collect()] == [True, False]


def test_every_rule_through_the_score(spark):
    """Interval rules travel packed, the others whole; both must agree with the rule."""
    ages = [0, 4, 12, 13, 17, 18, 40, 49, 50, 60, 61, 64, 65, 90]
    rules = list(RULES)
    mapping = spark.createDataFrame([(f"R{i}", "18", r, s) for i, r in enumerate(rules) for s in (None, "1", "77")], "icd10 string, cc string, AGE_EDIT_CONDITION string, SEX_EDIT_CONDITION string")
    mapping = mapping.unionByName(mapping.selectExpr("concat('M', icd10) AS icd10", "cc", "AGE_EDIT_CONDITION", "'1' AS SEX_EDIT_CONDITION"))
    members = [(f"{p}{i}_{a}_{x}", f"{2027 - a}-01-01", x, 0, 0, 0, 0) for p in ("R", "MR") for i in range(len(rules)) for a in ages for x in (1, 2)]
    dx = [(m[0], m[0].split("_")[0]) for m in members]
    for r in score(spark, members, dx, mapping).select("member_id", "age", "sex", "hcc_initial").collect():
        rule = RULES[rules[int(r.member_id.split("_")[0].strip("MR"))]]
        wanted = rule(r.age) and (r.member_id.startswith("R") or r.sex == 1)
        assert bool(r.hcc_initial) == wanted, r


def test_edits_and_code_lists(spark):
    mapping = spark.createDataFrame(
        [
            ("a.1", "18", None, None, None),
            ("A1", "999", None, None, None),
            ("A2", "abc", None, None, None),
            ("A3", "19.0", None, "age < 18", None),
            ("A4", "85", "age < 18", None, None),
            ("A5", "111", None, None, "1"),
            ("A6", "137", None, None, "N/A"),
        ],
        "icd10 string, cc string, MCE_AGE_CONDITION string, AGE_EDIT_CONDITION string, SEX_EDIT_CONDITION string",
    )
    dx = [("m", c) for c in ("a1", "A.1\t", "a2", "a3", "a4", "a5", "a6", "zz", "")]
    member = [("m", "1950-01-01", 2, 0, 0, 0, 0)]
    r = roster.member_result(score(spark, member, dx, mapping), REF).first()
    assert r.active_hccs == "HCC18 HCC137"
    lenient = roster.member_result(score(spark, member, dx, mapping, mce_edits=False), REF).first()
    assert lenient.active_hccs == "HCC18 HCC85 HCC137"
    features = member_features(spark.createDataFrame(member, SCHEMA))
    rows = code_to_category(features, spark.createDataFrame(dx, "member_id string, icd10 string"), mapping).collect()
    assert sorted((x.icd10, x.cc, x.n) for x in rows) == [("A1", 18, 2), ("A1", 999, 2), ("A6", 137, 1)]
    assert score(spark, member, [], mapping, scored_only=True).count() == 0


def test_absent_edit_columns(spark):
    r = score(spark, [("m", *GOLDEN["G1"][0])], [("m", "X18")], code_map(spark)).first()
    assert len(r.hcc_active) == 1


def test_hot_member_and_hot_code(spark):
    members = spark.range(50).selectExpr("string(id) AS member_id", "'1950-01-01' AS dob", "2 AS sex")
    dx = spark.range(60_000).selectExpr("if(id % 3 = 0, '0', string(id % 50)) AS member_id", "if(id % 3 = 1, 'X18', concat('X', string(id % 199))) AS icd10")
    rows = roster.score_roster(members, dx, code_map(spark), REF).select("member_id", F.size("hcc_initial").alias("n")).collect()
    assert len(rows) == 50
    expected = dx.distinct().join(code_map(spark), "icd10").where(F.concat(F.lit("HCC"), "cc").isin(REF.domain)).groupBy("member_id").count()
    assert {r.member_id: r.n for r in rows} == {r.member_id: r["count"] for r in expected.collect()}


@pytest.mark.parametrize("text, name", [("HCC18.0", "HCC18"), ("HCC18", "HCC18"), ("HCC8_5", "HCC8_5"), ("HCCx", "HCCx")])
def test_category_names(text, name):
    assert category_name(text) == name


def test_reference_folder(spark, tmp_path):
    from riskspark.sources import fixed_values as fv

    for name, text in (("hierarchies", fv.HIERARCHIES), ("groups", fv.DIAGNOSIS_GROUPS), ("interactions", fv.INTERACTIONS), ("ce_factors", fv.CE_FACTORS), ("ne_factors", fv.NE_FACTORS)):
        (tmp_path / f"{name}.csv").write_text("﻿" + text)
    loaded = load_refdata(spark, str(tmp_path))
    assert loaded == REF
    assert len(REF.domain) == 79 and sum(len(b) for _, b in REF.hierarchy) == 57 and len(REF.interactions) == 25


def test_model_tables_are_known_by_their_columns(spark, tmp_path):
    from riskspark.plans.bindings import write_model_folder

    folder = str(tmp_path / "tables")
    write_model_folder(spark, folder, 1)
    (tmp_path / "tables" / "notes.csv").write_text("a,b\n1,2\n")
    assert load_refdata(spark, folder) == REF
    write_model_folder(spark, str(tmp_path / "other"), 3)
    tripled = load_refdata(spark, str(tmp_path / "other"))
    assert tripled.factors == {v: {m: 3 * c for m, c in by.items()} for v, by in REF.factors.items()} and tripled.hierarchy == REF.hierarchy
    (tmp_path / "tables" / "more.csv").write_text("Interaction,VAR_1,var_2\nx,HCC1,HCC2\n")
    with pytest.raises(ValueError, match="interactions"):
        load_refdata(spark, folder)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        load_refdata(spark, str(tmp_path / "none"))


def test_unreadable_members_are_rejected_not_scored(spark, tmp_path):
    rows = [("a", "x", "1"), ("b", " 1 ", None), ("c", None, "2.5"), ("d", "", "y"), ("e", "2", "0"), ("e", "2", "0")]
    members = spark.createDataFrame(rows, "member_id string, sex string, orec string")
    path = str(tmp_path / "roster")
    for _ in range(2):  # written again, the same stands there
        counts = rejects.write_roster(members, path)
    assert counts == {"n_members": 6, "n_rejected": 3, "n_sex": 2, "n_orec": 2, "n_ltimcaid": 0, "n_nemcaid": 0, "n_dual_status": 0}
    good, bad = rejects.read_roster(members, path)
    assert sorted(r.member_id for r in good.collect()) == ["b", "e", "e"] and good.columns == members.columns
    assert {r.member_id: r.reasons for r in bad.collect()} == {"a": ["sex"], "c": ["orec"], "d": ["sex", "orec"]}
    dx = spark.createDataFrame([("a", "X18"), ("b", "X18")], "member_id string, icd10 string")
    scored = roster.score_roster(members, dx, code_map(spark), REF)
    assert sorted(r.member_id for r in scored.select("member_id").collect()) == ["b", "e", "e"]
    more = roster.what_if(members, dx, dx, code_map(spark), REF)
    assert {r.member_id for r in more.collect()} == {"b"}
    none = members.where("false")
    assert rejects.write_roster(none, str(tmp_path / "none"))["n_members"] == 0
    assert [side.count() for side in rejects.read_roster(none, str(tmp_path / "none"))] == [0, 0]
    with pytest.raises(ValueError):
        rejects.write_roster(members.withColumn("reasons", F.lit(1)), path)


def test_what_if_is_one_aggregate(spark):
    """Equal to scoring twice, and the diagnoses are aggregated once."""
    members = spark.createDataFrame([(k, *demo) for k, (demo, *_) in GOLDEN.items()], SCHEMA)
    dx = spark.createDataFrame([("G1", "X18"), ("G3", "X85"), ("G3", "X85"), ("G9", "X1")], "member_id string, icd10 string")
    added = spark.createDataFrame([("G1", "X85"), ("G1", "X18"), ("G2", "x1.11"), ("G3", ""), ("G4", "none"), ("G9", "X2")], "member_id string, icd10 string")
    out = roster.what_if(members, dx, added, code_map(spark), REF)
    got = {(r.member_id, r.model): (r.score, r.score_after) for r in out.collect()}
    before = roster.scores_long(roster.score_roster(members, dx, code_map(spark), REF), REF.models).collect()
    after = roster.scores_long(roster.score_roster(members, dx.unionByName(added), code_map(spark), REF), REF.models).collect()
    asked = {"G1", "G2", "G3", "G4"}
    assert {k: v[0] for k, v in got.items()} == {(r.member_id, r.model): r.score for r in before if r.member_id in asked}
    assert {k: v[1] for k, v in got.items()} == {(r.member_id, r.model): r.score for r in after if r.member_id in asked}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 4, plan  # own and added, packed and not, all in one


def test_rules_are_read_once_each_and_not_once_a_row(spark):
    """A rule column of a map is compiled after the distinct rules, also null ones; results stay a row each."""
    rows = [(f"A{i}", str(1 + i % 80), [None, "age >= 18 and age < 90"][i % 2], [None, "not age >= 70", "age == 18", "age < 65"][i % 4], [None, "1", "N/A"][i % 3]) for i in range(500)]
    mapping = spark.createDataFrame(rows, "icd10 string, cc string, MCE_AGE_CONDITION string, AGE_EDIT_CONDITION string, SEX_EDIT_CONDITION string")
    from riskspark.operators.diagnoses import prepare_code_map

    prepared = prepare_code_map(mapping)
    direct = spark.createDataFrame([(r[2], r[3]) for r in rows[:12]], "m string, a string").selectExpr("m", "a", f"{compile_rule('m')} AS mce", f"{compile_rule('a')} AS age_edit").collect()
    wanted = {(r.m, r.a): (r.mce, r.age_edit) for r in direct}
    found = prepared.collect()
    assert sorted(r.icd10 for r in found) == sorted(r[0] for r in rows)
    assert all((r.mce, r.age_edit) == wanted[r.mce_rule, r.age_rule] and r.sex_edit == (1 if r.sex_rule == "1" else None) for r in found)
    plan = prepared._jdf.queryExecution().optimizedPlan().toString().split("\n")
    reading = [line for line in plan if "regexp_extract_all" in line]
    assert any("Join" in line for line in plan) and len(reading) == 1 and "Aggregate [mce_rule" in reading[0]
