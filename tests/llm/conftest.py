import pytest

from riskspark.llm.common import keeping


@pytest.fixture
def keep(spark):
    return keeping(spark, "test")


@pytest.fixture
def docs(spark):
    """Null and empty texts, a very long one, repeated rows and ids, null ids, clashing columns."""

    def make(rows, **more):
        rows = [(*r, *([None] * (4 - len(r)))) for r in rows]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        for name, value in more.items():
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit(value))
        return frame

    return make
