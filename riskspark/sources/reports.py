"""Report sinks: JSON (per case and aggregate) and the flat comparison CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.fixed_values import COMPARISON_FIELDS


def write_report(per_case: DataFrame, aggregate: DataFrame, path: str) -> None:
    """``path/per_case`` and ``path/aggregate`` as JSON lines."""
    per_case.write.mode("overwrite").json(f"{path}/per_case")
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")


def read_report(spark: SparkSession, path: str, per_case: DataFrame, aggregate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts of a report, with the schemas of what was written."""
    return spark.read.schema(per_case.schema).json(f"{path}/per_case"), spark.read.schema(aggregate.schema).json(f"{path}/aggregate")


def write_comparison(rows: DataFrame, path: str, key: str = "id") -> None:
    """Fixed fields in order, ``key`` as id; list columns joined by a blank; other columns left out."""
    rows = rows.withColumnRenamed(key, "id")
    types = dict(rows.dtypes)
    fields = [F.array_join(c, " ").alias(c) if types[c].startswith("array") else F.col(c) for c in COMPARISON_FIELDS]
    rows.select(*fields).write.mode("overwrite").option("header", True).csv(path)
