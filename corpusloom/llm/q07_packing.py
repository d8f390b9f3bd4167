"""op7: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import prepare
from corpusloom.llm.packing import pack_documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
