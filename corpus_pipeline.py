"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back
as the next one's ``docs``. All but the last return the columns of ``documents``; a stage that
changes a text also renews ``n_chars``. Null and empty texts, repeated rows and ids, empty
tables and extra columns behave as the operators of the stages say.

What a stage keeps in the shared folder goes when a later stage begins, as its result has been
written by then; so write a stage's result before calling the next one in the same session.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, lines, mixing, near_copies, rules
from riskspark.llm.common import Keep, keeping, small_batches, table
from riskspark.session import run_dir

RANKS = "byte_bpe_50k.tiktoken"
KEPT = "stage-of-pipeline"


def _keeping(spark: SparkSession, stage: str) -> Keep:
    """Keeps steps of a stage, without those of the stages before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = path(run_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in files.globStatus(path(folder, f"{KEPT}-*")) or ():
        files.delete(old.getPath(), True)
    return keeping(spark, f"{KEPT}-{stage}")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the distributions of their language accept."""
    return rules.accepted(docs, _keeping(spark, "rules"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, up to one edit; emptied documents go."""
    kept = lines.remaining(docs, _keeping(spark, "lines"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more in five-word shingles: that of the smallest id."""
    return near_copies.one_of_each(docs, _keeping(spark, "near"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs, _keeping(spark, "mix"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    small_batches(spark)
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: XXH64 and the merges of BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, keep = table(spark, sf_dir, "documents"), keeping(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"stage-{i}")
    return docs
