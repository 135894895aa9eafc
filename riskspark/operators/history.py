"""Conversation history kept as rows.

The history of a request is the messages of its conversation up to it. Keeping a copy
inside every row would grow with the square of a conversation, so each message is one
row with its place and the running size of the history; the history of any request is
the rows with a smaller or equal place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.deid import deidentify

#: Turns per block of the running sums; a long conversation spreads over its blocks.
BLOCK_TURNS = 1_000


def running_sums(df: DataFrame, key: str, order: str, values: dict[str, str], block: int = BLOCK_TURNS) -> DataFrame:
    """Adds a running sum of each column, ordered by an integer column, per key.

    Two levels: sums inside blocks of the order column, and the totals of the blocks
    before. No task sees more than one block of rows of a key, or its block totals.
    """
    blocked = df.withColumn("block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(key, "block").agg(*[F.sum(c).alias(f"t_{c}") for c in values])
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "block", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"b_{c}") for c in values])
    inside = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocked.join(before, [key, "block"])
    for column, name in values.items():
        summed = summed.withColumn(name, F.col(f"b_{column}") + F.sum(column).over(inside))
    return summed.drop("block", *[f"b_{c}" for c in values])


def conversation_history(turns: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, content, messages, chars) from (conv_id, turn, role, text).

    What users wrote is de-identified; their raw text does not reach the history.
    """
    said = turns.where("role = 'user'").withColumn("note_id", F.struct("conv_id", "turn"))
    users = deidentify(said, gazetteer).select("conv_id", "turn", "role", F.col("sanitized_text").alias("content"))
    others = turns.where("role != 'user' OR role IS NULL").select("conv_id", "turn", "role", F.col("text").alias("content"))
    messages = users.unionByName(others).withColumns({"one": F.lit(1), "size": F.coalesce(F.length("content"), F.lit(0))})
    return running_sums(messages, "conv_id", "turn", {"one": "messages", "size": "chars"}).drop("one", "size")


def open_requests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn): the last user message of each conversation that no assistant message follows."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("turn")))
    ends = turns.groupBy("conv_id").agg(last("user").alias("turn"), last("assistant").alias("answered"))
    return ends.where("turn IS NOT NULL AND (answered IS NULL OR answered < turn)").select("conv_id", "turn")


def request_messages(history: DataFrame, prompts: DataFrame) -> DataFrame:
    """(conv_id, turn, position, role, content): the messages sent for each request, one a row.

    ``history`` is ``conversation_history``, ``prompts`` (conv_id, turn, prompt) the text that
    stands in place of a request's own message. A conversation has one request at a time, the
    latest one of ``prompts``, so no message is copied and the result grows with the history.
    The long texts of the prompts meet single messages only, never a whole conversation.
    """
    asked = prompts.groupBy("conv_id").agg(F.max("turn").alias("request"))
    numbered = history.join(asked, "conv_id")
    before = numbered.where("turn < request").select("conv_id", F.col("request").alias("turn"), F.col("messages").alias("position"), "role", "content")
    own = numbered.where("turn = request").select("conv_id", "turn", F.col("messages").alias("position"), "role")
    return before.unionByName(own.join(prompts.select("conv_id", "turn", F.col("prompt").alias("content")), ["conv_id", "turn"]))


def history_of(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of the history of each request (conv_id, turn), in long form."""
    asked = requests.select("conv_id", F.col("turn").alias("request_turn")).distinct()
    return history.join(asked, "conv_id").where("turn <= request_turn")
