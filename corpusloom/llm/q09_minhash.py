"""op9: the near-duplicate class of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import prepare
from corpusloom.llm.minhash import near_duplicates


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    named = lambda c: F.lower(F.hex(c)).alias(c)  # noqa: E731 - all 128 bits
    return found.select("doc_id", named("class_key"), named("class_id"), "n_words")
