"""Frequencies within one row: items of an array by count, speakers of a text, genre by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def by_frequency(items: Column) -> Column:
    """array<struct<item, n>>: the different items of an array, the most frequent first, of equally frequent ones the one seen first.

    The array is sorted once and read in runs, so a long one costs n log n. Null gives null.
    """
    places = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("at"))))

    def runs(s: Column) -> Column:
        opens = F.transform(s, lambda x, j: F.when((j == 0) | ~F.get(s, j - 1)["item"].eqNullSafe(x["item"]), F.struct(x["item"].alias("item"), x["at"].alias("at"), j.alias("j"))))
        return T.let(F.filter(opens, lambda r: r.isNotNull()), lambda o: ordered(o, F.size(s)))

    def ordered(o: Column, total: Column) -> Column:
        less = F.transform(o, lambda r, k: F.struct((r["j"] - F.coalesce(F.get(o, k + 1)["j"], total)).alias("m"), r["at"].alias("at"), r["item"].alias("item")))
        return F.transform(F.sort_array(less), lambda e: F.struct(e["item"].alias("item"), (-e["m"]).alias("n")))

    return F.when(items.isNotNull(), T.let(places, runs))


def speakers(text: Column, pattern: str, not_speaker: str) -> Column:
    """array<struct<item, n>>: who speaks in a text and in how many lines, as by_frequency. Group 1 of pattern is the name."""
    names = F.transform(T.lines(text), lambda s: F.regexp_extract(s, pattern, 1))
    return by_frequency(F.filter(names, lambda s: (s != "") & (s != not_speaker)))


def most_frequent(text: Column, pattern: str) -> Column:
    """The run of a text that is found most often, the first seen of equally frequent ones; null if there is none."""
    return F.get(by_frequency(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0))["item"]


def genre_of(text: Column, keywords: dict[str, tuple[str, ...]], default: str) -> Column:
    """The genre of whose keywords the most are in the text, the first named of equal ones; default where none is, and for null."""
    hits = {g: sum((F.coalesce(text.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0)) for g, words in keywords.items()}
    ranked = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(g).alias("g")) for i, (g, n) in enumerate(hits.items())])
    return T.let(F.array_max(ranked), lambda best: F.when(best["n"] > 0, best["g"]).otherwise(default))
