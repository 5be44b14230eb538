"""Latest user message per conversation, kept across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_user_turns(turns: DataFrame) -> DataFrame:
    """Update stream of ``(conv_id, turn, text)``; the state is one small row per conversation."""
    newest = F.max_by(F.struct("turn", "text"), "turn").alias("m")
    users = turns.where(F.col("role") == "user").groupBy("conv_id").agg(newest)
    return users.select("conv_id", "m.turn", "m.text")
