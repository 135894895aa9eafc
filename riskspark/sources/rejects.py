"""A roster split at intake: readable members on one side, rejected ones on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from riskspark.functions.demographics import DEFAULTS, unreadable_columns


def write_roster(members: DataFrame, path: str) -> dict[str, int]:
    """Writes both sides below ``path`` in one scan and returns the counts of the run.

    ``n_members`` and ``n_rejected`` count rows, ``n_<column>`` the rows in which that column
    is present but no whole number. An extra column of the name ``rejected`` or ``reasons``
    is refused. Writing again replaces what stood there.
    """
    taken = {"rejected", "reasons"} & set(members.columns)
    if taken:
        raise ValueError(f"columns of these names are written here: {sorted(taken)}")
    seen = Observation("roster intake")
    split = members.withColumn("reasons", F.expr(unreadable_columns(members))).withColumn("rejected", F.expr("int(size(reasons) > 0)"))
    counted = split.observe(
        seen,
        F.count(F.lit(1)).alias("n_members"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("n_rejected"),
        *[F.count_if(F.array_contains("reasons", c)).alias(f"n_{c}") for c in DEFAULTS],
    )
    counted.write.mode("overwrite").partitionBy("rejected").parquet(path)
    return seen.get


def read_roster(like: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable members, rejected ones with ``reasons``); ``like`` is the table that was written.

    Each side reads its own folder only. The sides may be empty.
    """
    schema = StructType(list(like.schema)).add("reasons", ArrayType(StringType())).add("rejected", IntegerType())
    stored = like.sparkSession.read.schema(schema).parquet(path)
    side = lambda n: stored.where(F.col("rejected") == n).drop("rejected")
    return side(0).drop("reasons"), side(1)
