"""op10: all documents into 24 shards of near equal size, equal texts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import prepare
from corpusloom.llm.sharding import shard

SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
