"""Digest of mined patterns: the most frequent items of several lists at once, and the median of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many items of each list a digest shows.
TOPS = {"beats": 30, "hooks": 20, "reversals": 20}


def pattern_digest(rows: DataFrame, tops: dict[str, int] = TOPS) -> DataFrame:
    """kind, item, n, rank: each list column's most frequent items, ties to the smaller item. Null lists and items don't count.

    All lists are counted by one shuffle of different items; what is ranked was cut to the greatest top within each task before.
    """

    def named(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))

    lists = F.explode(F.flatten(F.array(*map(named, tops))))
    counted = rows.select(lists.alias("x")).select("x.*").where("item IS NOT NULL").groupBy("kind", "item").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "item"))
    most = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in tops.items()])
    return counted.withColumn("rank", rank).where(F.col("rank") <= max(tops.values())).where(F.col("rank") <= most)


def digest_head(rows: DataFrame, episodes: Column) -> DataFrame:
    """n, median: how many works there are, and the median of their episodes; works without any don't count."""
    return rows.agg(F.count("*").alias("n"), F.median(F.when(episodes > 0, episodes)).alias("median"))
