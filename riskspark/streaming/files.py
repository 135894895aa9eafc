"""Tables as streams: a table may be one file or a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stream of the Parquet files at ``path``, or under it if it is a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = spark.readStream.schema(schema)
    if files.getFileStatus(hadoop).isDirectory():
        return source.parquet(path)
    parent, name = path.rsplit("/", 1)
    return source.option("pathGlobFilter", name).parquet(parent)


def written_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the batches wrote under ``path``; without any batch an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none where there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
