"""JSON-lines case files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.notes import stripped

CLINICAL_CASE = (
    "id string, note string, demographics struct<dob:string,sex:int,orec:int,dual_status:int,ltimcaid:int,nemcaid:int>, "
    "search_queries array<string>, expected_icd10 array<string>, expected_hccs array<string>, applicable_model string"
)
PHI_CASE = "id string, note string, expected_entities array<string>, must_survive array<string>"


def parse_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(cases, bad lines) from a table with a text column ``value``.

    Blank lines and lines that start with ``//`` are skipped.
    """
    body = lines.withColumn("value", F.expr(stripped("value"))).where("value != '' AND NOT startswith(value, '//')")
    readable = F.expr("startswith(value, '{') AND try_parse_json(value) IS NOT NULL")
    cases = body.where(readable).select(F.from_json("value", schema).alias("c")).select("c.*")
    return cases, body.where(~readable)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return parse_jsonl(spark.read.text(path), schema)
