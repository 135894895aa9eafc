"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "riskspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; keywords override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # collect_set per member keeps at most one entry per category, so many members
        # fit into one hash map before it has to sort
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as the session names it.

    A session on one machine (``local[..]``) that names none gets a folder of its own; on a
    cluster that would scatter the files, so there it is an error.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="riskspark-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's kept steps."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one job, under the run's."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run(spark: SparkSession) -> None:
    """Removes all kept steps of this application; results read from them must be written first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """``keep(df, step)`` writes a step under the shared folder and reads it back.

    For a step that several later ones use: it is computed once, and a lost executor
    costs no more than reading it again.
    """
    folder = shared_dir(spark, name)

    def keep(df: DataFrame, step: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    return keep

