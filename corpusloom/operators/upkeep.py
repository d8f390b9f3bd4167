"""Upkeep of a store: cards computed anew, texts of cards, run artefacts, ledgers, merged lexicons, forbidden paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Fixed value: a placeholder file that may lie anywhere.
PLACEHOLDER = ".gitkeep"
#: What is claimed of a text and isn't computed from it.
CLAIMED = ("claimed_genre", "claimed_platform")


def restat(fresh: DataFrame, old: DataFrame, name: str = "name", script_id: str = "script_id") -> DataFrame:
    """fresh cards under the ids and claims of the old ones; a card that is new keeps its own id."""
    claims = [c for c in CLAIMED if c in old.columns]
    before = old.select(name, F.col(script_id).alias("__id"), *[F.col(c).alias(f"__{c}") for c in claims])
    both = fresh.join(before, name, "left")
    out = [F.coalesce("__id", script_id).alias(script_id) if c == script_id else F.col(f"`{c}`") for c in fresh.columns if c not in claims]
    claimed = [F.coalesce(f"__{c}", *([F.col(c)] if c in fresh.columns else [])).alias(c) for c in claims]
    return both.select(*out, *claimed)


def with_texts(cards: DataFrame, texts: DataFrame, key: str = "script_id") -> DataFrame:
    """Cards with their texts; a card whose text is missing is left out."""
    return cards.join(texts, key)


def artefacts(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """path, ir_path, text: the first texts that aren't empty of runs whose meta.json can be read and names one."""
    meta = spark.read.option("wholetext", True).option("pathGlobFilter", "meta.json").option("recursiveFileLookup", True).text(folder)
    named = meta.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "ir_path string")["ir_path"].alias("ir_path")).where("ir_path <> ''")
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    texts = texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("tail"), F.col("value").alias("text"))
    run = F.regexp_extract("path", r"([^/]+)/meta\.json$", 1)
    found = named.withColumn("tail", F.concat_ws("/", run, F.col("ir_path"))).join(texts, "tail").where(T.stripped(F.col("text")) != "")
    return found.select("path", "ir_path", "text").orderBy("path").limit(most)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """An appended ledger in the order of round and time."""
    return spark.read.parquet(path).orderBy("round", "ts")


def merged_lexicon(seeds: list[str], mined: DataFrame, phrase: str = "phrase", rank: str = "rank") -> DataFrame:
    """phrase, place: the seeds, then mined phrases in their order, each once and none of white space only."""
    sown = mined.sparkSession.createDataFrame([(i - len(seeds), p) for i, p in enumerate(seeds)], "place long, phrase string")
    found = mined.select(F.col(rank).cast("long").alias("place"), T.stripped(F.col(phrase)).alias("phrase")).where("phrase <> ''")
    return sown.unionByName(found).groupBy("phrase").agg(F.min("place").alias("place"))


def forbidden_paths(paths: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """The paths that lie below a forbidden prefix, placeholders excepted."""
    below = F.lit(False)
    for p in prefixes:
        below = below | F.col(path).startswith(p)
    return paths.where(below & ~F.col(path).endswith(PLACEHOLDER))
