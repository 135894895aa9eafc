"""Times the headline queries; prints one JSON line.

Each query runs twice and writes to a no-op sink; the faster run counts, so that the
start of the JVM and of the code generator is not part of a figure. The index build is
timed on its own, without reuse of a stored one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from riskspark import catalog
from riskspark.operators import retrieval
from riskspark.session import build_session, keeper

HEADLINE = [
    "member_result",
    "all_scores",
    "score_contributions",
    "icd10_to_cc",
    "what_if",
    "index_build",
    "code_index_build",
    "search_topk",
    "candidate_pool",
    "retrieval_eval",
    "deidentify",
    "phi_eval",
    "note_to_score",
    "provider_compare",
    "conversation_history",
    "stream_rescore",
]


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh TF-IDF index over every document."""
    docs = catalog.b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.build_index(docs, "doc_id", "text", keeper(spark, "bench-index")).terms


def code_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh TF-IDF index over the short code descriptions."""
    corpus = catalog.Data(spark, sf_dir).corpus.select("icd10", "description")
    return retrieval.build_index(corpus, "icd10", "description", keeper(spark, "bench-codes")).terms


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # documents.parquet is one row group, which one task would read
        spark__riskspark__documents__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**catalog.QUERIES, "index_build": index_build, "code_index_build": code_index_build}
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(queries[name](spark, sf_dir))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
