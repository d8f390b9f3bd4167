"""Interaction audit of document filters: what each filter removes, in every order, and what it removes alone.

Every document gets a flag for each filter that it fails. Equal flag combinations of a part are counted first, so
that what is shuffled doesn't grow with the documents. A CUBE over the flags and the part then gives, in the grouping
sets whose selected flags are all false, the survivors of every subset of filters. A step of an order goes from a subset to
the same subset and one filter more: survivors joined with survivors, once for each such pair (80 with five filters). From
these pairs come what is removed, what fails but was removed before, what fails this filter only and the sum
over all orders; the orders are read off the pairs by a table that depends on the number of filters alone.

Whether a text is a copy of an earlier one is told by SHA-256 of the whole text. Texts with very many copies
(at least a thousandth of all rows, so at most a thousand texts) are joined by broadcast, the others by a shuffle, so no
task gets all copies of a text.

Nulls: a null text is empty, a null part the empty string; a null doc_id has no smaller one, is smaller than none, and
has no labels. Rows with equal doc_id and text aren't copies of each other. Several label rows of a document count as one
that holds any of their ones. An empty table gives no rows. Very long texts are judged whole. Other columns aren't read,
whatever their names. Ties: there are none; every count is exact.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, drop_written, written

#: Words are what white space sets apart.
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
#: The filters in their order of names: short, repetitive, shouting, marked, copied.
FILTERS = "ABCDE"
#: A text with at least so many copies, and at least this share of all rows, is joined by broadcast.
HOT_ROWS, HOT_SHARE = 1000, 0.001


def own_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that need nothing but the text: a name to a boolean that is never null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # Both counts from one array, so that the words are cut once.
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "counts": counts,
        "A": F.col("counts.n") < LEAST_WORDS,
        "B": F.col("counts.d") * 100 < F.col("counts.n") * LEAST_DISTINCT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(MARKS),
    }


def flagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, A to E: one row for each document, with the filters that it fails."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    flags = own_flags(F.col("text"))
    rows = base.withColumn("counts", flags.pop("counts")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("k"), *[c.alias(f) for f, c in flags.items()])
    rows = written(rows, "flags")
    copies = written(rows.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    at_least = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(copies.where(F.col("n") >= at_least).select("k", "first"))  # at most 1 / HOT_SHARE rows
    others = broadcast_if_small(copies.where(F.col("n") < at_least).select("k", "first"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    out = ["doc_id", "part", *FILTERS[:-1], late]
    return rows.join(hot, "k").select(*out).unionByName(rows.join(hot, "k", "left_anti").join(others, "k", "left").select(*out))


def labelled(rows: DataFrame, labels: DataFrame, ones: dict[str, str], doc_id: str = "doc_id") -> DataFrame:
    """rows with a boolean for each name of ones: whether labels (doc_id, columns of 0 and 1) has a one for the document.

    Rows without a doc_id are dealt out by their flags and don't meet in one task.
    """
    any_one = [F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(n) for n, c in ones.items()]
    known = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(*any_one)
    known = broadcast_if_small(written(known.where(" OR ".join(ones)), "labels"))
    met = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select(*rows.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in ones])
    return met.unionByName(rows.where("doc_id IS NULL").select("*", *[F.lit(False).alias(n) for n in ones]))


def survivors(rows: DataFrame, filters: str, measures: list[str]) -> DataFrame:
    """part, subset, n and measures: how many rows of a part fail none of the filters of a subset, zeros included.

    rows: part, a boolean for each filter, a boolean for each measure. Bit i of subset is filter i.
    """
    counted = rows.groupBy("part", *filters).agg(F.count("*").alias("n"), *[F.count_if(m).alias(m) for m in measures])
    cube = counted.cube("part", *filters).agg(F.grouping("part").alias("no_part"), F.grouping_id().alias("g"), *[F.sum(m).alias(m) for m in ["n", *measures]])
    free = F.lit(True)
    for f in filters:
        free &= F.col(f).isNull() | ~F.col(f)
    # grouping_id has the first column in its highest bit; a one says that the column isn't selected.
    last = len(filters) - 1
    chosen = sum(((F.lit(1) - F.getbit("g", F.lit(last - i)).cast("int")) * (1 << i) for i in range(len(filters))), F.lit(0))
    got = cube.where((F.col("no_part") == 0) & free).select("part", chosen.cast("int").alias("subset"), "n", *measures)
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(got, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in ["n", *measures]])


def interactions(rows: DataFrame, filters: str = FILTERS, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, <measure>_lost, shapley."""
    spark, n = rows.sparkSession, len(filters)
    full = (1 << n) - 1
    alive = written(survivors(rows, filters, list(measures)), "survivors")
    # Pairs of subsets: (before, filter), and in how many orders they follow one another. n * 2**(n-1) rows.
    pairs = [(b, i, b | 1 << i, factorial(b.bit_count()) * factorial(n - 1 - b.bit_count())) for b in range(full + 1) for i in range(n) if not b >> i & 1]
    steps = F.broadcast(spark.createDataFrame(pairs, "subset int, filter int, after int, orders long"))
    left = alive.join(steps, "subset")
    right = alive.select("part", F.col("subset").alias("after"), *[F.col(m).alias(f"{m}_after") for m in ["n", *measures]])
    pair = left.join(right, ["part", "after"]).select("part", "subset", "filter", "orders", F.col("n_after").alias("kept"), (F.col("n") - F.col("n_after")).alias("removed"), *[(F.col(m) - F.col(f"{m}_after")).alias(f"{m}_lost") for m in measures])
    pair = written(pair, "pairs")
    alone = pair.groupBy("part", "filter").agg(
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("subset") == F.lit(full) - F.expr("shiftleft(1, filter)"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"),
    )
    orders = [("".join(filters[i] for i in o), s + 1, o[s], sum(1 << i for i in o[:s])) for o in permutations(range(n)) for s in range(n)]
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter int, subset int"))
    out = pair.join(alone, ["part", "filter"]).join(orders, ["filter", "subset"])
    name = F.substring(F.lit(filters), F.col("filter") + 1, F.lit(1))
    out = out.select("part", "filter_order", "step", name.alias("filter"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{m}_lost" for m in measures], "shapley")
    drop_written(alive)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over documents (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    rows = labelled(flagged(docs), labels, {"good": "quality", "toxic": "toxic"})
    return interactions(rows)
