"""Best of n: pairs of a pivot tournament and strengths by maximum likelihood (Bradley and Terry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import drop_written, written

#: Comparisons of each item with one of strength 1, half won: strengths stay finite, and their scale is fixed.
PRIOR = 1.0


def pivot_pairs(items: DataFrame, group: str, item: str, pivots: int = 2) -> DataFrame:
    """group, item, rival: each item against the pivots of its group, which are those of the smallest md5; O(n * pivots) pairs."""
    order = Window.partitionBy(group).orderBy(F.md5(F.col(item).cast("string")), item)
    few = items.select(group, item).distinct().withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= pivots)
    few = few.select(group, F.col(item).alias("rival"))
    return items.select(group, item).distinct().join(few, group).where(F.col(item) != F.col("rival"))


def strengths(comparisons: DataFrame, group: str, a: str, b: str, share: str, tolerance: float = 1e-7, rounds: int = 200) -> DataFrame:
    """group, item, strength (log), n, rounds: the most likely strengths, item i beating j with a chance of s_i / (s_i + s_j).

    comparisons: share is what a got of the comparison with b: 1, 0, or a half for a tie; null shares and an item against itself don't
    count. Equal pairs are counted first, so a round costs a join over different pairs, not over comparisons. Rounds
    of the minorising step go on until no logarithm moves by more than the tolerance.
    """
    own = comparisons.where(F.col(share).isNotNull() & (F.col(a) != F.col(b)))
    both = own.select(F.col(group).alias("g"), F.explode(F.array(
        F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(share).cast("double").alias("w")),
        F.struct(F.col(b).alias("i"), F.col(a).alias("j"), (1 - F.col(share)).cast("double").alias("w")),
    )).alias("x")).select("g", "x.*")
    pairs = written(both.groupBy("g", "i", "j").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "pairs")
    state = written(pairs.groupBy("g", "i").agg(F.sum("w").alias("won"), F.sum("n").alias("n"), F.lit(1.0).alias("s")), "strengths")
    done = 0
    for _ in range(rounds):
        done += 1
        mine, rival = state.select("g", "i", "s"), state.select("g", F.col("i").alias("j"), F.col("s").alias("t"))
        load = pairs.join(rival, ["g", "j"]).join(mine, ["g", "i"]).groupBy("g", "i").agg(F.sum(F.col("n") / (F.col("s") + F.col("t"))).alias("load"))
        new = state.join(load, ["g", "i"]).withColumn("new", (F.col("won") + PRIOR / 2) / (F.col("load") + PRIOR / (F.col("s") + 1)))
        new = written(new.select("g", "i", "won", "n", "s", "new"), "step")
        # At the maximum the chances against strength 1 sum up to half the items: a Newton step moves a group's scale there.
        chance = F.col("new") / (F.col("new") + 1)
        scale = new.groupBy("g").agg(F.exp(F.sum(0.5 - chance) / F.sum(chance * (1 - chance))).alias("c"))
        moved = new.join(scale, "g").withColumn("new", F.col("new") * F.col("c"))
        moved = written(moved.select("g", "i", "won", "n", F.col("new").alias("s"), F.abs(F.log("new") - F.log("s")).alias("moved")), "strengths")
        drop_written(new)
        new = moved
        drop_written(state)
        state = new
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return state.select(F.col("g").alias(group), F.col("i").alias("item"), F.log("s").alias("strength"), "n", F.lit(done).alias("rounds"))


def select_best(comparisons: DataFrame, group: str, a: str, b: str, share: str) -> DataFrame:
    """group, item, strength: the strongest item of each group; ties to the smaller item."""
    fit = strengths(comparisons, group, a, b, share)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("strength", 6)), "item"))
    return fit.withColumn("__r", first).where(F.col("__r") <= 1).select(group, "item", "strength")
