"""Excerpts for judging: packed paragraphs, scenes, their dialogue and brand scenes, and a pool of anchor texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: How a scene opens, what speech has, what opens other lines, least and most characters.
SCENE, SAYS, ASIDE = "### 场", "：", ("#", "[", "△")
PACK, SPEECH, BRAND, ANCHOR = 700, 700, 900, 300


def paragraph_packs(text: Column, chars: int = PACK) -> Column:
    """Paragraphs (lines that aren't headings) gathered until they have so many characters; a rest of half as many stays."""
    paragraphs = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda p: ~p.startswith("#")), T.stripped), lambda p: p != "")
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        grown = F.concat(a["open"], p, F.lit("\n"))
        full = F.length(grown) >= chars
        return F.struct(F.when(full, "").otherwise(grown).alias("open"), F.when(full, F.concat(a["done"], F.array(T.stripped(grown)))).otherwise(a["done"]).alias("done"))

    def close(a: Column) -> Column:
        return F.when(F.length(a["open"]) >= chars // 2, F.concat(a["done"], F.array(T.stripped(a["open"])))).otherwise(a["done"])

    return F.aggregate(paragraphs, state, step, close)


def scenes(script: Column) -> Column:
    """The scenes of a script, headings included."""
    return F.filter(F.transform(F.split(script, rf"\n(?={SCENE} )"), lambda s: F.when(s.startswith(SCENE), T.stripped(s))), lambda s: s.isNotNull())


def dialogues(script: Column, chars: int = SPEECH) -> Column:
    """The spoken lines of each scene, if they have a third of so many characters, cut there."""

    def spoken(scene: Column) -> Column:
        aside = lambda line: F.substring(line, 1, 1).isin(*ASIDE)
        return T.stripped(F.array_join(F.filter(F.split(scene, "\n"), lambda x: F.contains(x, F.lit(SAYS)) & ~aside(x)), "\n"))

    return F.transform(F.filter(F.transform(scenes(script), spoken), lambda s: F.length(s) >= chars // 3), lambda s: F.substring(s, 1, chars))


def brand_scenes(script: Column, brand: str, chars: int = BRAND) -> Column:
    """The scenes in which a brand is named, cut at so many characters. brand is a regular expression."""
    return F.transform(F.filter(scenes(script), lambda s: s.rlike(brand)), lambda s: F.substring(s, 1, chars))


#: Characters of a unit's body at least; shares of a spread sample for the head and the middle.
UNIT, HEAD, MIDDLE = 200, 0.6, 0.2


def units(text: Column, schemes: list[str]) -> Column:
    """array<struct<title, body>>: what stands between titles, by the scheme that gives most units, the first one on a tie.

    A scheme is a regular expression of a title; `^` and `$` are ends of lines. Short bodies are left out.
    """

    def by(scheme: str) -> Column:
        marked = F.split(F.regexp_replace(text, f"(?m){scheme}", "\x01$0\x02"), "\x01")
        each = F.transform(F.slice(marked, 2, F.greatest(F.size(marked), F.lit(1))), lambda u: F.split(u, "\x02"))
        made = F.transform(each, lambda u: F.struct(T.stripped(F.get(u, F.lit(0))).alias("title"), T.stripped(F.get(u, F.lit(1))).alias("body")))
        return F.filter(made, lambda u: F.length(u["body"]) >= UNIT)

    best, *others = map(by, schemes)
    for other in others:
        best = F.when(F.size(other) > F.size(best), other).otherwise(best)
    return best


def spread(items: Column, most: int) -> Column:
    """At most so many elements of an array: three fifths from the head, a fifth from the middle on, the rest from the tail."""
    head, middle = int(most * HEAD), max(1, int(most * MIDDLE))
    n = F.size(items)
    from_middle = F.slice(items, F.floor(n / 2).cast("int") + 1, F.lit(middle))
    tail = F.greatest(F.lit(1), most - head - F.size(from_middle))
    return F.when(n > most, F.concat(F.slice(items, 1, head), from_middle, F.slice(items, n - tail + 1, tail))).otherwise(items)


def anchor_pool(pairs: DataFrame, axis: str, order: str = "position", least: int = ANCHOR) -> DataFrame:
    """a_text, axis, first, other: different texts of enough characters, each with the axis of its first row.

    Those of the wanted axis come first: read it by (other, first), such as orderBy(...).limit(n).
    """
    rows = pairs.where(F.length("a_text") >= least)
    once = rows.groupBy("a_text").agg(F.min(F.struct(F.col(order).alias("first"), F.col("axis"))).alias("x"))
    return once.select("a_text", F.col("x.axis").alias("axis"), F.col("x.first").alias("first"), (~F.col("x.axis").eqNullSafe(F.lit(axis))).alias("other"))
