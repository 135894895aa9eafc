"""Diagnoses arriving over time: members they touch are scored again.

A streaming aggregate keeps each member's categories (the sets of ``category_items``, a few
numbers a member) in the state store. A batch merges what arrived into the sets of the
members it touches and scores these; it never reads earlier diagnoses, so its cost does not
grow with history. The number of state partitions is ``spark.sql.shuffle.partitions`` at
the first start.

Results stand under run and batch. A run is the life of one checkpoint: a batch replayed by
the same run overwrites itself, and a run that starts without a checkpoint (lost, say) gets
a new number and rebuilds the sets from the source, whose files must still be there. As
sets only grow, the current result of a member is the one with most rows behind it, and of
those the latest; a run that is still catching up hides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.diagnoses import arriving_items
from riskspark.plans import bindings
from riskspark.plans.roster import member_result, score_items
from riskspark.sources.refdata import RefData
from riskspark.streaming.files import arriving_rows, folder_names, make_folder


def run_number(spark: SparkSession, out: str) -> int:
    """The run that the checkpoint under ``out`` belongs to; a new one without checkpoint."""
    runs = [int(name.split("=")[1]) for name in folder_names(spark, f"{out}/scores") if name.startswith("run=")]
    latest = max(runs, default=-1)
    if latest >= 0 and "offsets" in folder_names(spark, f"{out}/checkpoint"):
        return latest
    # before the first batch, so that no restart can take this run for the one before
    make_folder(spark, f"{out}/scores/run={latest + 1}")
    return latest + 1


def start(dx: DataFrame, members: DataFrame, code_map: DataFrame, ref: RefData, out: str, key: str = "member_id"):
    """Starts the query over a streaming DataFrame (member, icd10)."""
    here = f"{out}/scores/run={run_number(members.sparkSession, out)}"

    def rescore(batch: DataFrame, batch_id: int) -> None:
        scored = score_items(members, batch, ref, key, how="inner")
        result = member_result(scored, ref, key, "n_rows")
        result.write.mode("overwrite").parquet(f"{here}/batch_id={batch_id}")

    return (
        arriving_items(dx, code_map, ref, key)
        .writeStream.outputMode("update")
        .foreachBatch(rescore)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_scores(spark: SparkSession, out: str, key: str = "member_id") -> DataFrame:
    """Current result row of every member."""
    rows = spark.read.parquet(f"{out}/scores")
    columns = [c for c in rows.columns if c not in (key, "run", "batch_id", "n_rows")]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("n_rows", "run", "batch_id")).alias("r"))
    return latest.select(key, "r.*")


def run_once(spark: SparkSession, sf_dir: str, ref: RefData, out: str) -> DataFrame:
    """All order lines of a folder that have arrived so far, as one available-now run."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = arriving_rows(spark, f"{sf_dir}/lineitem.parquet", schema)
    dx = bindings.diagnoses_of_lines(lines, bindings.table(spark, sf_dir, "orders"))
    members, code_map = bindings.members(spark, sf_dir), bindings.code_map(spark, sf_dir, ref)
    start(dx, members, code_map, ref, out).awaitTermination()
    return current_scores(spark, out)
