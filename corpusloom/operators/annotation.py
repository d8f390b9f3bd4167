"""Annotation cards: majority of several cards of a unit, agreement of two annotators, genres, craft rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that are voted on, fields that come with the card of the median tension, what two annotators must reach.
CATEGORIES = ("hook_type", "cliffhanger", "conflict_type", "info_gap", "scene_turn")
TEXTS = ("stakes", "reversals", "summary")
AGREE, VALID = 0.7, 0.7
#: The five craft rates, their mixed anchors and weights.
MIXED = {"hook_attack": (0.75, 0.25), "conflict_person": (0.83, 0.25), "info_gap": (0.72, 0.20), "cliffhanger_rd": (0.70, 0.15), "scene_turn": (0.66, 0.15)}


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def majority_card(cards: DataFrame, unit: str, order: str) -> DataFrame:
    """unit, n, tension, the categories, the texts: one card from all cards of a unit.

    tension is the upper median, a missing one counts as 0; a category is its most frequent value, the one seen first (least
    order) of equally frequent ones, empty if no card has one; the texts are those of the first card with the median tension.
    Values are counted by unit first, so no task holds the cards of a frequent unit.
    """
    tension = F.coalesce(F.col("tension").cast("int"), F.lit(0))
    texts = [F.col(f) if f in cards.columns else F.lit(None).cast("string").alias(f) for f in TEXTS]
    by_tension = cards.groupBy(unit, tension.alias("tension")).agg(F.count("*").alias("c"), F.min_by(F.struct(*texts), order).alias("texts"))
    of = Window.partitionBy(unit)
    upto = F.sum("c").over(of.orderBy("tension"))
    place = by_tension.withColumn("upto", upto).withColumn("n", F.sum("c").over(of)).where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2)))
    votes = cards.select(unit, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _plain(F.col(f)).alias("value")) for f in CATEGORIES])).alias("x")).select(unit, order, "x.*").where("value <> ''")
    counted = votes.groupBy(unit, "field", "value").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    best = counted.groupBy(unit).agg(*[F.min_by("value", F.when(F.col("field") == f, F.struct((-F.col("c")).alias("c"), "first"))).alias(f) for f in CATEGORIES])
    out = place.select(unit, "n", "tension", "texts.*").join(best, unit, "left")
    return out.select(unit, "n", "tension", *[F.coalesce(f, F.lit("")).alias(f) for f in CATEGORIES], *TEXTS)


def card_agreement(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """n, valid, rate, pass: two annotators over the same units, a row of each for a unit; a null `tension` marks a card that couldn't be read.

    Tensions agree when they are at most one apart, categories when equal but for case; the rate is the mean over all fields of the units
    that both have read. Passed with AGREE of the fields and VALID of the units.
    """
    one, two = (df.select(unit, *[F.col(f).alias(f"{f}_{s}") for f in ("tension", *CATEGORIES)]) for df, s in ((a, "a"), (b, "b")))
    both = one.join(two, unit)
    read = F.col("tension_a").isNotNull() & F.col("tension_b").isNotNull()
    same = [_plain(F.col(f"{f}_a")) == _plain(F.col(f"{f}_b")) for f in CATEGORIES]
    score = (F.abs(F.col("tension_a") - F.col("tension_b")) <= 1).cast("int") + sum((s.cast("int") for s in same), F.lit(0))
    rate = F.sum(F.when(read, score)) / (F.count_if(read) * (1 + len(CATEGORIES)))
    valid = F.count_if(read) / F.count("*")
    out = both.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") > 0, valid).otherwise(0.0), 4).alias("valid"), F.round(F.when(F.count_if(read) > 0, rate).otherwise(0.0), 4).alias("rate"))
    return out.withColumn("pass", (F.col("rate") >= AGREE) & (F.col("valid") >= VALID))


def genre_agreement(a: DataFrame, b: DataFrame, unit: str, genre: str) -> DataFrame:
    """n, rate, pass over the units that both have given a genre."""
    both = a.select(unit, F.col(genre).alias("x")).join(b.select(unit, F.col(genre).alias("y")), unit).where("x IS NOT NULL AND y IS NOT NULL")
    rate = F.coalesce(F.avg((F.col("x") == F.col("y")).cast("double")), F.lit(0.0))
    return both.agg(F.count("*").alias("n"), F.round(rate, 4).alias("rate"), (rate >= AGREE).alias("pass"))


def genre_distribution(rows: DataFrame, genre: str, known: list[str], fallback: str) -> DataFrame:
    """genre, n, fell_back: how many works of each genre; what isn't known goes to the fallback and is counted there."""
    fine = F.coalesce(F.col(genre).isin(known), F.lit(False))
    return rows.groupBy(F.when(fine, F.col(genre)).otherwise(fallback).alias("genre")).agg(F.count("*").alias("n"), F.count_if(~fine).alias("fell_back"))


def craft_rates() -> dict[str, Column]:
    """The five rates of cards as booleans of a card."""
    c = {f: _plain(F.col(f)) for f in CATEGORIES}
    return {
        "hook_attack": c["hook_type"].isin("threat", "promise", "inversion"),
        "conflict_person": c["conflict_type"] == "person",
        "info_gap": c["info_gap"] != "none",
        "cliffhanger_rd": c["cliffhanger"].isin("reveal", "danger"),
        "scene_turn": c["scene_turn"] == "true",
    }


def craft_score(cards: DataFrame, by: list[str] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """by, n, the five rates (3 places), score: sum of weight * min(1, rate / anchor).

    Without anchors the mixed ones hold; anchors: the columns of by, and one for each rate; groups without an anchor aren't scored.
    """
    got = cards.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in craft_rates().items()]).where("n > 0")
    if anchors is not None:
        got = got.join(anchors.select(*(by or []), *[F.col(k).alias(f"a_{k}") for k in MIXED]), by)
    anchor = lambda k: F.lit(MIXED[k][0]) if anchors is None else F.col(f"a_{k}")
    total = sum((F.least(F.lit(1.0), F.col(k) / anchor(k)) * w for k, (_, w) in MIXED.items()), F.lit(0.0))
    return got.select(*(by or []), "n", *[F.round(k, 3).alias(k) for k in MIXED], F.round(total, 4).alias("score"))
