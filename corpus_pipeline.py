"""A training-data pipeline over `documents`: language, near duplicates, repeats, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as a table and read again as
the next stage's docs. All but the last return the columns of `documents`. Documents are told apart by
doc_id and 128 bits over the text, so null and repeated ids do no harm; extra columns are carried along,
whatever their names (the stages' own columns begin with `__loom_`). Empty tables go through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, language_id, minhash, packing, suffix_dedup
from corpusloom.llm.common import attach, broadcast_if_small, prepare, text_key, written
from corpusloom.llm.q07_packing import tokenizer_path

KEY = "__loom_key"
#: Bytes of a string that counts as a repeat: 50 short words.
REPEAT = 256


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, text_key(F.col("text")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a[KEY] == b[KEY])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or without a letter) go; a missing lang is filled in.

    A text is judged whole however long it is; of equal scores the first language by name is taken; repeated rows all stay or go.
    """
    prepare(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UND)
    return found.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays; wordless documents stay."""
    prepare(spark)
    rows = _keyed(docs)
    classes = written(minhash.near_duplicates(rows, carried=(KEY,)), "classes")
    # Ties of doc_id go to the smaller key; a null doc_id comes last.
    least = classes.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))).alias("first"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select("class_id", "first"), "least")
    mine = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))
    others = attach(classes, least, "class_id").where(F.col("first").isNotNull() & ~mine.eqNullSafe(F.col("first"))).select("doc_id", KEY).distinct()
    others = broadcast_if_small(written(others, "others"))
    out = rows.join(others, _same(rows, others), "left_anti")
    if classes.groupBy("doc_id", KEY).count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", KEY])
    return out.drop(KEY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT bytes that occur twice are cut out in every place, in whole characters; a document of which nothing is left goes.

    n_chars, where there is such a column, counts what is left. Null and empty texts lose nothing and stay.
    """
    prepare(spark)
    _, changes = suffix_dedup.repeats(docs, length=REPEAT, keep_text=True)
    changed = broadcast_if_small(changes.select(F.col("key").alias(KEY)))
    rows, kept = _keyed(docs), "__loom_kept"
    cut = rows.join(changed, KEY, "left_semi").join(changes.select(F.col("key").alias(KEY), F.col("kept").alias(kept)), KEY).where(F.col(kept) != "")
    new = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    cut = cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
    return rows.join(changed, KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(cut)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: four fifths of its word shingles, wherever they are in the whole text.

    Null and empty texts contain nothing and stay; of rows that repeat doc_id and text all go or none.
    """
    prepare(spark)
    found = decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.col("key").alias(KEY)).distinct()
    found = broadcast_if_small(written(found, "contaminated"))
    rows = _keyed(docs)
    return rows.join(found, _same(rows, found), "left_anti").drop(KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens, as op7: a null text has only its end token.

    Repeated rows are packed each; of documents of equal length the earlier row goes first, of equally loaded sequences the one of
    the lower number. A very long text gives full sequences and a rest; no document gives no piece. Other columns aren't read.
    """
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]
#: Language identification is a fitted model and can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
