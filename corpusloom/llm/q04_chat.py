"""op4: all conversations as preference pairs: shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.chat_format import format_preferences, pair_up


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_preferences(pair_up(turns))
