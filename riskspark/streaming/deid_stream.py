"""Notes arriving over time: de-identify and gate each micro-batch.

A batch is written under its own number and overwritten when it is replayed, so a
restart leaves neither gaps nor doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.operators.deid import deidentify
from riskspark.plans.bindings import gazetteer as known_names
from riskspark.plans.bindings import note_text
from riskspark.plans.notes import gate
from riskspark.streaming.files import arriving_rows, written_batches


def start(notes: DataFrame, out: str, gazetteer: DataFrame | None = None):
    """Starts the query over a streaming DataFrame (note_id, text)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = gate(deidentify(batch, gazetteer))
        done.write.mode("overwrite").parquet(f"{out}/notes/batch_id={batch_id}")

    return (
        notes.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_output(spark: SparkSession, out: str) -> DataFrame:
    empty = spark.createDataFrame([], "note_id bigint, text string")
    return written_batches(spark, f"{out}/notes", gate(deidentify(empty)).schema)


def run_once(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """All documents of a folder that have arrived so far, as one available-now run."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = arriving_rows(spark, f"{sf_dir}/documents.parquet", schema)
    arriving = arriving.selectExpr("doc_id AS note_id", f"{note_text()} AS text")
    start(arriving, out, known_names(spark, sf_dir)).awaitTermination()
    return read_output(spark, out)
