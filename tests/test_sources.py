"""Sources and sinks."""

from riskspark.functions.codes import normalize_code, tolerant_int
from riskspark.sources import jsonl, reports
from riskspark.sources.refdata import read_code_map, read_descriptions


def test_jsonl(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('// comment\n\n  {"id":"a","note":"n","expected_entities":["PERSON"],"must_survive":[]}\n{"id":"b"\n{"id":"c"}\n')
    cases, bad = jsonl.read_jsonl(spark, str(path), jsonl.PHI_CASE)
    assert sorted((r.id, r.note) for r in cases.collect()) == [("a", "n"), ("c", None)]
    assert bad.count() == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "p", 1.0, 0.5, 0.667, 1.2, 3.0, ["A", "B"], ["HCC1"], "extra")], "id string, provider string, code_precision double, code_recall double, code_f1 double, score double, latency_total double, codes array<string>, hccs array<string>, other string")
    reports.write_comparison(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == reports.COMPARISON_FIELDS and back.first().codes == "A B"
    reports.write_report(rows, rows.selectExpr("count(*) AS n"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "aggregate")).first().n == 1


def test_reference_files_by_position(spark, tmp_path):
    (tmp_path / "d.csv").write_text('title,,\nyear,,\nnote,,\nDiagnosis Code,Description,Other\nE11.9,"Diabetes, type 2",x\n')
    rows = read_descriptions(spark, str(tmp_path / "d.csv")).where("icd10 = 'E11.9'").collect()
    assert rows[0].description == "Diabetes, type 2"
    (tmp_path / "m.csv").write_text("﻿ICD10,CC\n E11.9 ,19.0\n")
    assert read_code_map(spark, str(tmp_path / "m.csv")).selectExpr(f"{normalize_code('icd10')} AS c").first().c == "E119"


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("19.0",), (" 18 ",), ("-2.7",), ("abc",), ("",), (None,), ("1e2",), ("1d",)], "t string")
    assert [r.n for r in df.selectExpr(f"{tolerant_int('t')} AS n").collect()] == [19, 18, -2, None, None, None, 100, None]
    df = spark.createDataFrame([("\t e11.9 \n",), ("i50.22",)], "t string")
    assert [r.c for r in df.selectExpr(f"{normalize_code('t')} AS c").collect()][1] == "I5022"
