"""op5: every document's log-likelihood, learned from four fifths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import gru_lm
from corpusloom.llm.common import prepare
from corpusloom.llm.q06_language import fold


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (fold() == 1).alias("held_out"), "text")
    counts, model = gru_lm.gather(docs.where("NOT held_out").select("text"))
    encoded = gru_lm.encode(docs, model)
    gru_lm.fit(encoded.where("NOT held_out"), model)
    return gru_lm.score(encoded, counts, model)
