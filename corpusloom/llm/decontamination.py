"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

An item counts as contained in a document when at least `threshold` of its distinct word shingles
(five words, lower-cased, punctuation dropped) occur in the document.

Items are partitioned by their number of shingles (powers of two). An item's sketch is its bottom-k
MinHash: the k least hashes among its n shingles, with k = n - ceil(threshold * n) + 1. A document
that holds threshold * n of the shingles misses at most k - 1 of them, so it holds at least one of any
k, in particular one of the sketch: no contained item is ever lost, however long the document is. As
sketches are made of least hashes, every partition has a cut, the largest hash in its sketches. A
document's shingle probes just the partitions whose cut it doesn't exceed, so short items, whose sketches
hold any hash, don't open the index of the long ones.

Documents are streamed through a join with the sketches (broadcast when counted to be small, else
joined by shuffle). The candidates, pairs of document and item, are then verified: the documents among
them are cut into shingles again and those that the candidate items really have, compared as text, are
counted. Items with the same shingles are one while searching and get separate rows at the end.

An item of fewer than five words is one shingle of all its words and is found as that run of words in
documents of any length: the shingles of documents are made for each such shorter width too.

Nulls and empty texts have no words: such documents hold nothing, such items are in nothing. Rows that
repeat doc_id and text give one row for each item; two texts under one doc_id are told apart by key. Empty
tables give no rows. Columns of either table other than the named ones aren't read, whatever their names. A
very long text is one row like any other: its shingles leave it one by one. There are no ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, text_key, written

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")


def _hashes(width: int) -> str:
    """Hashes of all runs of `width` of the word hashes h."""
    run = ", ".join(f"element_at(h, i + {k})" for k in range(width))
    return f"if(size(h) >= {width}, transform(sequence(1, greatest(size(h) - {width - 1}, 1)), i -> xxhash64({width}, {run})), cast(array() as array<bigint>))"


def _texts(width: int) -> str:
    return f"if(size(w) >= {width}, transform(sequence(1, greatest(size(w) - {width - 1}, 1)), i -> array_join(slice(w, i, {width}), ' ')), cast(array() as array<string>))"


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, item_id, n_shingles, n_found, containment: every item that a document contains.

    key stands for the text and tells documents with one doc_id apart.
    """
    source = items.select(F.col(f"`{item_id}`").alias("item_id"), words(F.col(f"`{item_text}`")).alias("w")).where("size(w) > 0")
    source = source.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    widths = sorted(r["width"] for r in source.select("width").distinct().collect())  # at most WIDTH rows
    if not widths:
        widths = [WIDTH]
    shingled = F.array_sort(F.array_distinct(F.coalesce(*[F.when(F.col("width") == k, F.expr(_texts(k))) for k in widths])))
    members = source.select("item_id", "width", shingled.alias("s")).withColumn("set_id", F.xxhash64("width", "s"))
    members = written(members, "items")
    n = F.size("s")
    need = F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")
    # One set for all items with the same shingles.
    sets = members.dropDuplicates(["set_id", "s"]).select("set_id", n.alias("n"), need.alias("need"), F.floor(F.log2(n.cast("double"))).cast("int").alias("partition"), "s")
    # The hash of a shingle is made from the hashes of its words, as on the documents' side.
    sketch = F.slice(F.array_sort(F.transform("s", _shingle_hash)), 1, F.col("n") - F.col("need") + 1)
    sketches = written(sets.select("set_id", "partition", F.explode(sketch).alias("h")), "sketches")
    cuts = {r["partition"]: r["cut"] for r in sketches.groupBy("partition").agg(F.max("h").alias("cut")).collect()}  # a row for each power of two
    top = max(cuts.values(), default=-(1 << 63))
    partitions = F.array(*[F.struct(F.lit(p).alias("partition"), F.lit(c).alias("cut")) for p, c in sorted(cuts.items())] or [F.struct(F.lit(0).alias("partition"), F.lit(top).alias("cut"))])

    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    # explode_outer: for explode the optimizer adds a filter below that would compute the words anew for each run.
    probes = body.select("doc_id", "key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    runs = F.concat(*[F.expr(_hashes(k)) for k in widths])
    probes = probes.select("doc_id", "key", F.explode_outer(F.filter(runs, lambda x: x <= F.lit(top))).alias("h"))
    probes = probes.select("doc_id", "key", "h", F.explode(F.filter(partitions, lambda p: p["cut"] >= F.col("h"))["partition"]).alias("partition"))
    # Sets that share a sketch hash meet it once.
    lookup = sketches.groupBy("partition", "h").agg(F.collect_set("set_id").alias("sets"))
    met = probes.join(broadcast_if_small(lookup), ["partition", "h"]).select("doc_id", "key", F.explode("sets").alias("set_id"))
    wanted = written(met.groupBy("doc_id", "key").agg(F.collect_set("set_id").alias("sets")), "candidates")

    # Verification, on the documents that have a candidate.
    few = broadcast_if_small(wanted)
    held = body.join(few, body["doc_id"].eqNullSafe(few["doc_id"]) & (body["key"] == few["key"])).select(body["doc_id"], body["key"], "sets", words(F.col("text")).alias("w"))
    held = held.select("doc_id", "key", "sets", F.explode_outer(F.array_distinct(F.concat(*[F.expr(_texts(k)) for k in widths]))).alias("t"))
    shingles = broadcast_if_small(sets.select("set_id", F.explode("s").alias("t")).groupBy("t").agg(F.collect_set("set_id").alias("of")))
    common = held.join(shingles, "t").select("doc_id", "key", "t", F.explode(F.array_intersect("sets", "of")).alias("set_id")).distinct()
    counted = common.groupBy("doc_id", "key", "set_id").agg(F.count("*").cast("int").alias("n_found"))
    known = members.select("set_id", "item_id", n.alias("n"), need.alias("need")).distinct()
    rows = counted.join(broadcast_if_small(known), "set_id").where("n_found >= need")
    return rows.select("doc_id", "key", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def _shingle_hash(t: Column) -> Column:
    """xxhash64 over the number of words and the words' own hashes, for a shingle given as text."""
    parts = F.split(t, " ")
    out = None
    for k in range(WIDTH, 0, -1):
        h = F.xxhash64(F.lit(k), *[F.xxhash64(F.get(parts, F.lit(i))) for i in range(k)])
        out = h if out is None else F.when(F.size(parts) == k, h).otherwise(out)
    return out
