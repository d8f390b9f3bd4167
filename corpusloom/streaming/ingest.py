"""Incremental intake: files that arrive are gated, fingerprinted and dropped when near a stored document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.profile import Profile
from corpusloom.operators import cards, dedup
from corpusloom.operators.nearindex import NearIndex
from corpusloom.sources.tables import written


def gated(batch: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, text, reason, simhash of a batch (doc_id, text)."""
    return dedup.with_simhash(batch.select("doc_id", "text").withColumn("reason", cards.gate_reason(F.col("text"), profile)))


def take_in(batch: DataFrame, stored: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, text, simhash, reason, duplicate_of for a batch (doc_id, text) against stored (doc_id, simhash)."""
    rows = gated(batch, profile)
    good = rows.where("reason IS NULL").select(F.col("doc_id").alias("id"), "simhash")
    return judged(rows, dedup.without_known(good, stored.select(F.col("doc_id").alias("id"), "simhash")))


def take_in_indexed(batch: DataFrame, index: NearIndex, seq: int, profile: Profile) -> DataFrame:
    """As take_in, against an index of what was kept before, which the batch's own kept documents join under seq."""
    rows = written(gated(batch, profile), "gated")
    return judged(rows, index.admit(rows.where("reason IS NULL").select(F.col("doc_id").alias("id"), "simhash"), seq))


def judged(rows: DataFrame, kept: DataFrame) -> DataFrame:
    out = rows.join(kept.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.withColumn("reason", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("reason")))


def report(taken: DataFrame) -> DataFrame:
    """reason (null: taken in), n."""
    return taken.groupBy("reason").agg(F.count("*").alias("n"))


def stream_in(spark: SparkSession, inbox: str, store: str, checkpoint: str, profile: Profile, bands: int = 256) -> StreamingQuery:
    """Parquet files (doc_id, text) that arrive in inbox go to the store, each once; their fingerprints to `<store>-index`.

    A batch reads the bands of the index that its own keys fall into, and nothing of the store.
    """
    index = NearIndex(spark, store.rstrip("/") + "-index", bands)

    def land(batch: DataFrame, epoch: int) -> None:
        # A batch that runs again replaces what it wrote, in the index and in the store.
        taken = take_in_indexed(batch, index, epoch, profile).where("reason IS NULL").select("doc_id", "text", "simhash")
        taken.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(store)

    source = spark.readStream.schema("doc_id long, text string").parquet(inbox)
    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
