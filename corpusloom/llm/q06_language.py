"""op6: the language of every document, learned from four fifths of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id
from corpusloom.llm.common import prepare


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold() != 0))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
