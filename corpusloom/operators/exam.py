"""Votes to exam metrics, paired comparison with bootstrap, ledgers, panels, annotation and craft scores."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as T
from corpusloom.sources.tables import broadcast_if_small

#: Operators whose defect must never pass, and the gates of an exam.
BLOCK_OPS = ("D07_pov_break", "D08_inject_contradiction", "D09_brand_cut", "D14_setup_cut")
GATES = {"n": 100, "sensitivity": 0.85, "block": 0.95, "bias": 0.08, "agreement": 0.70, "transitivity": 0.95}


def packs(pairs: DataFrame, k: int, size: int) -> DataFrame:
    """pair_id, axis, direction, k_index, pack: vote items of an axis, by pair, direction and k, in packs of `size`.

    The place of a pair is the number of pairs in the runs of ids before its own (first eight characters, or 4,096 whole
    numbers) and its place in the run, so no task has a whole axis where ids are spread. An id is one pair of an axis.
    """
    text = isinstance(pairs.schema["pair_id"].dataType, StringType)
    rows = pairs.select("pair_id", "axis").withColumn("__run", F.substring("pair_id", 1, 8) if text else F.floor(F.col("pair_id") / 4096))
    runs = rows.groupBy("axis", "__run").agg(F.count("*").alias("__n"))
    runs = runs.select(F.col("axis").alias("__axis"), F.col("__run").alias("__of"), (F.sum("__n").over(Window.partitionBy("axis").orderBy("__run")) - F.col("__n")).alias("__before"))
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy("axis", "__run").orderBy("pair_id")) - 1)
    placed = placed.join(runs, F.col("axis").eqNullSafe(F.col("__axis")) & F.col("__run").eqNullSafe(F.col("__of")))
    votes = F.explode(F.expr(f"flatten(transform(array(0, 1), d -> transform(sequence(0, {k} - 1), i -> struct(d as direction, i as k_index))))"))
    items = placed.select("pair_id", "axis", (F.col("__before") + F.col("__r")).alias("__place"), votes.alias("x"))
    place = F.col("__place") * (2 * k) + F.col("x.direction") * k + F.col("x.k_index")
    return items.select("pair_id", "axis", "x.*", F.floor(place / size).cast("int").alias("pack"))


def axis_metrics(votes: DataFrame) -> DataFrame:
    """The exam of each axis from votes (pair_id, axis, op_id, direction, letter); '' abstains and counts below the line."""
    got = F.coalesce(F.col("letter"), F.lit(""))  # a missing letter abstains as well
    share = lambda d, letter: F.coalesce(F.avg(F.when(F.col("direction") == d, (got == letter).cast("double"))), F.lit(0.5))
    by_pair = votes.groupBy("axis", "pair_id", "op_id").agg(share(0, "A").alias("r0"), share(1, "B").alias("r1"))
    ok = ((F.col("r0") + F.col("r1")) / 2 > 0.5).cast("double")
    block = F.col("op_id").isin(*BLOCK_OPS)
    out = by_pair.groupBy("axis").agg(
        F.count("*").alias("n_pairs"), F.avg(ok).alias("s"), F.avg(F.when(block, ok)).alias("b"),
        F.abs(F.avg("r0") - F.avg("r1")).alias("p"), F.avg(((F.col("r0") > 0.5) != (F.col("r1") > 0.5)).cast("double")).alias("f"),
    )
    passed = (F.col("n_pairs") >= GATES["n"]) & (F.col("s") >= GATES["sensitivity"]) & F.coalesce(F.col("b") >= GATES["block"], F.lit(True)) & (F.col("p") <= GATES["bias"])
    r = lambda c: F.round(c, 4)
    return out.select("axis", "n_pairs", r("s").alias("sensitivity"), r("b").alias("block_sensitivity"), r("p").alias("position_bias"), r("f").alias("pair_flip_rate"), passed.alias("pass"))


def directed_metrics(scores: DataFrame) -> DataFrame:
    """axis, sensitivity, position_bias of directed scores (pair_id, axis, direction, score_a, score_b).

    Here the bias is the share of swapped calls in which the degraded text still wins.
    """
    a = F.when(F.col("direction") == 0, F.col("score_a")).otherwise(F.col("score_b"))
    b = F.when(F.col("direction") == 0, F.col("score_b")).otherwise(F.col("score_a"))
    wrong = F.avg(F.when(F.col("direction") == 1, (a < b).cast("double")))
    pair = scores.groupBy("axis", "pair_id").agg(F.avg(a).alias("a"), F.avg(b).alias("b"), wrong.alias("w"))
    return pair.groupBy("axis").agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("a") > F.col("b")).cast("double")), 4).alias("sensitivity"), F.round(F.avg("w"), 4).alias("position_bias"))


def transitivity(scores: DataFrame) -> DataFrame:
    """axis, checked, rate: of sources with orig > mild and mild > strong, how many have orig > strong.

    scores: axis, source, op_id, severity, orig_wins, and beats_strong (the mild text against the strongest).
    """
    by = scores.groupBy("axis", "source", "op_id").agg(F.count_distinct("severity").alias("n"), F.min_by("orig_wins", "severity").alias("m"), F.min_by("beats_strong", "severity").alias("ms"), F.max_by("orig_wins", "severity").alias("s"))
    held = by.where("n >= 2 AND m AND ms")
    return held.groupBy("axis").agg(F.count("*").alias("checked"), F.round(F.avg(F.col("s").cast("double")), 4).alias("rate"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, rate, pass: how often two judges agree."""
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys)
    rate = F.avg(F.col("va").eqNullSafe(F.col("vb")).cast("double"))
    return both.agg(F.count("*").alias("n"), F.round(rate, 4).alias("rate"), (rate >= GATES["agreement"]).alias("pass"))


def abstentions(votes: DataFrame) -> DataFrame:
    """axis, n_votes, n_abstain: votes without a letter."""
    return votes.groupBy("axis").agg(F.count("*").alias("n_votes"), F.count_if(F.coalesce(F.col("letter"), F.lit("")) == "").alias("n_abstain"))


def overall(metrics: DataFrame) -> DataFrame:
    """n_axes, n_passed, pass: an exam is passed when all its axes are, and there is one."""
    return metrics.agg(F.count("*").alias("n_axes"), F.count_if("pass").alias("n_passed")).withColumn("pass", (F.col("n_axes") > 0) & (F.col("n_passed") == F.col("n_axes")))


def outcome(champion: Column, candidate: Column) -> Column:
    """win, loss, tie or invalid of the candidate."""
    return F.when(champion.isNull() | candidate.isNull(), "invalid").when(candidate > champion, "win").when(candidate < champion, "loss").otherwise("tie")


def paired(champion: DataFrame, candidate: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, outcome of every run of the candidate against every run of the champion with its keys."""
    both = champion.select(*keys, F.col(score).alias("c0")).join(candidate.select(*keys, F.col(score).alias("c1")), keys)
    return both.select(*keys, outcome(F.col("c0"), F.col("c1")).alias("outcome"))


def winrate(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0))
    valid = n("win") + n("loss") + n("tie")
    return outcomes.agg(valid.alias("n_pairs"), n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"), F.when(valid > 0, F.round((n("win") + n("tie") * 0.5) / valid, 4)).otherwise(0.0).alias("winrate"))


def _resampled(x: list[float], resamples: int, seed: int) -> list[float]:
    """Means of resamples of x, each drawn by random.Random(seed).choice one after the other."""
    key = random.Random(seed).getstate()[1]
    chance = np.random.MT19937()
    chance.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], np.uint32), "pos": key[-1]}}
    n, values, shift = len(x), np.array(x, float), np.uint64(32 - len(x).bit_length())
    exact = bool((values * 2 == np.round(values * 2)).all())  # halves add up the same in any order
    means: list[float] = []
    left = np.zeros(0, np.uint64)
    while len(means) < resamples:
        drawn = chance.random_raw(max(1 << 20, n)) >> shift
        left = np.concatenate([left, drawn[drawn < n]])
        m = min(len(left) // n, resamples - len(means))
        got = values[left[: m * n].astype(np.int64)].reshape(m, n)
        means += (got.sum(1) / n).tolist() if exact else [sum(r) / n for r in got.tolist()]
        left = left[m * n :]
    return means


def bootstrap(scores: DataFrame, group: str, order: str, value: str = "score", resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """group, ci_lo, ci_hi: percentile interval of the mean; no scores give (0, 0).

    The draws are those of random.Random(seed).choice, made in blocks, so large groups are resampled whole. A
    group is one task and costs resamples times its scores.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().tolist()
        lo = hi = 0.0
        if x:
            means = sorted(_resampled(x, resamples, seed))
            lo, hi = means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ci_lo": [lo], "ci_hi": [hi]})

    return scores.select(group, order, value).groupBy(group).applyInPandas(one, f"{group} {scores.schema[group].dataType.simpleString()}, ci_lo double, ci_hi double")


def quota_ledger(submissions: DataFrame, ts: str = "ts", quota: int = 20) -> DataFrame:
    """round, used, over_quota of each ISO week."""
    return submissions.groupBy(T.iso_week(F.col(ts)).alias("round")).agg(F.count("*").alias("used")).withColumn("over_quota", F.col("used") > quota)


def admitted(submissions: DataFrame, key: str, ts: str = "ts", quota: int = 20, unit: str = "minute") -> DataFrame:
    """submissions with round, place, admitted: in each ISO week the first `quota` by time and key are let in, later ones refused.

    place is the running number in the round. It is made of the counts of the time units before, at most some ten thousand a
    round, and the place within the unit; so no task has a whole round, and a finer unit splits a crowded one. Submissions without a
    time have no round and are refused.
    """
    rows = submissions.withColumn("round", T.iso_week(F.col(ts))).withColumn("__unit", F.date_trunc(unit, F.col(ts)))
    upto = F.sum("__n").over(Window.partitionBy("round").orderBy("__unit"))
    before = rows.where("round IS NOT NULL").groupBy("round", "__unit").agg(F.count("*").alias("__n")).select("round", "__unit", (upto - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("round", "__unit").orderBy(ts, key))
    timed = rows.where("round IS NOT NULL").withColumn("__r", within).join(before, ["round", "__unit"])
    place = F.col("__before") + F.col("__r")
    out = timed.select(*[f"`{c}`" for c in submissions.columns], "round", place.alias("place"), (place <= quota).alias("admitted"))
    late = rows.where("round IS NULL").select(*[f"`{c}`" for c in submissions.columns], "round", F.lit(None).cast("long").alias("place"), F.lit(False).alias("admitted"))
    return out.unionByName(late)


def promoted(ab: DataFrame) -> DataFrame:
    """The declared rule: interval above parity, twelve briefs, a sealed confirmation."""
    return ab.withColumn("promote", F.coalesce((F.col("ci_lo") > 0.5) & (F.col("n_briefs") >= 12) & F.col("sealed_score").isNotNull(), F.lit(False)))


def panels(ledger: DataFrame) -> dict[str, DataFrame]:
    """The five panels of the dashboard, and the 20 latest rows, from an experiment ledger."""
    ab = ledger.where("kind = 'ab'")
    sealed = ab.where("sealed_score IS NOT NULL")
    accepted = F.col("decision").startswith("accepted") | (F.col("decision") == "promoted")
    ratio = F.avg(accepted.cast("double"))
    blind = ledger.where("kind = 'blind_corpus' AND winrate IS NOT NULL")
    return {
        "sealed": sealed.select("round", "winrate", "ci_lo", "ci_hi", "sealed_score", (F.coalesce("ci_lo", F.lit(0.0)) > 0.5).alias("ahead")),
        "divergence": sealed.where("winrate IS NOT NULL").select("round", "winrate", "sealed_score", (F.abs(F.col("sealed_score") - F.col("winrate")) > 0.15).alias("alarm")),
        "blind": blind.select("round", "winrate"),
        "decisions": ab.where("decision IS NOT NULL").agg(F.count("*").alias("n"), F.sum(accepted.cast("long")).alias("accepted"), F.round(ratio, 4).alias("ratio"), ((ratio >= 0.3) & (ratio <= 0.7)).alias("healthy")),
        "recent": ledger.orderBy(F.desc("ts")).limit(20),
    }


def worst_axis(exam: DataFrame) -> DataFrame:
    return exam.agg(F.min("sensitivity").alias("worst"), (F.min("sensitivity") < GATES["sensitivity"]).alias("closed"))


def majority(rows: DataFrame, group: str, value: str, order: str, number: str) -> DataFrame:
    """group, mode (the value seen first wins ties), upper_median of number."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    mode = counted.groupBy(group).agg(F.max_by(value, F.struct("c", (-F.col("first")).alias("f"))).alias("mode"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(number, order)) - 1
    total = F.count("*").over(Window.partitionBy(group))
    median = rows.where(F.col(number).isNotNull()).select(group, number, place.alias("i"), total.alias("n")).where(F.col("i") == F.floor(F.col("n") / 2)).select(group, F.col(number).alias("upper_median"))
    return mode.join(median, group, "full")


def attainment(cards: DataFrame, anchors: DataFrame, rates: dict[str, Column], weights: dict[str, float], genre: str = "genre") -> DataFrame:
    """genre, n_cards, score: sum of weight * min(1, rate / anchor). anchors: genre and a column for each rate."""
    per = cards.groupBy(genre).agg(F.count("*").alias("n_cards"), *[F.avg(c.cast("double")).alias(k) for k, c in rates.items()])
    a = anchors.select(F.col(genre), *[F.col(k).alias(f"a_{k}") for k in rates])
    part = lambda k: F.when(F.col(f"a_{k}") > 0, F.least(F.lit(1.0), F.col(k) / F.col(f"a_{k}"))).otherwise(1.0) * weights[k]
    return per.join(broadcast_if_small(a), genre).select(genre, "n_cards", F.round(sum((part(k) for k in rates), F.lit(0.0)), 4).alias("score"))


def chi_square(rows: DataFrame, buckets: DataFrame, expected_total: float | None = None, critical: dict[int, float] | None = None) -> DataFrame:
    """stat, dof, pass of counts against shares. rows: value; buckets: bucket, lo, hi, share (a handful of rows)."""
    hit = rows.join(F.broadcast(buckets), (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).groupBy("bucket").agg(F.count("*").alias("o"))
    all_ = buckets.join(hit, "bucket", "left").where("share > 0").withColumn("o", F.coalesce("o", F.lit(0)))
    e = F.col("share") * (F.lit(expected_total) if expected_total else F.sum("o").over(Window.partitionBy(F.lit(1))))
    got = all_.withColumn("e", e).agg(F.round(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")), 6).alias("stat"), (F.count("*") - 1).cast("int").alias("dof"))
    table = critical or CRITICAL
    limit = F.coalesce(*[F.when(F.col("dof") == d, v) for d, v in table.items()])
    return got.withColumn("pass", F.col("stat") <= limit)


#: Chi-square at 5 percent by degrees of freedom.
CRITICAL = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.07, 6: 12.592}


def stratified(rows: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """rows of a sample of about n: each stratum gets its share, one at least; the order is by a hash of the key."""
    h = F.md5(F.col(key).cast("string"))
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__size"))
    total = rows.count()
    give = sizes.withColumn("__give", F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.col("__size") / F.lit(float(max(1, total)))).cast("int")))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))
    # No stratum gets more than n: with the literal each task keeps the n first of a stratum before they meet.
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= max(1, n)).join(broadcast_if_small(give), strata).where("__rank <= __give").drop("__rank", "__size", "__give")


def apportioned(sizes: DataFrame, strata: list[str], size: str, n: int) -> DataFrame:
    """strata, give: n seats over strata (a row each) by largest remainder, with one for each stratum first.

    All n are given where there are as many rows. Of more strata than seats the largest get one. Ties go to the larger stratum, then
    by name. A stratum never gets more than it has.
    """
    one = Window.partitionBy(F.lit(1))  # over strata, not over rows
    by_size = F.row_number().over(one.orderBy(F.desc(size), *strata))
    table = sizes.select(*strata, F.col(size).cast("long").alias("__size"), by_size.alias("__by"), F.count("*").over(one).alias("__strata"), F.sum(size).over(one).alias("__total"))
    seats = F.least(F.lit(n), F.col("__total")) - F.col("__strata")
    rest = F.greatest(F.col("__total") - F.col("__strata"), F.lit(1))
    # Whole numbers throughout: the share is seats * (size - 1) / rest.
    table = table.withColumn("__whole", F.expr(f"(least({n}L, __total) - __strata) * (__size - 1) div greatest(__total - __strata, 1L)"))
    table = table.withColumn("__over", seats * (F.col("__size") - 1) - F.col("__whole") * rest)
    left = seats - F.sum("__whole").over(one)
    place = F.row_number().over(one.orderBy(F.desc("__over"), F.desc("__size"), *strata))
    give = F.when(F.col("__strata") >= n, (F.col("__by") <= n).cast("int")).otherwise(1 + F.col("__whole") + (place <= left).cast("int"))
    return table.select(*strata, give.cast("int").alias("give"))


def stratified_exact(rows: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """rows of a sample of exactly n (or all, if fewer), each stratum with its apportioned share; within a stratum by md5 of the key, then the key.

    No stratum is sorted as a whole: each task keeps the n first of a stratum before they meet.
    """
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__n"))
    give = apportioned(sizes, strata, "__n", n)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key))
    few = rows.withColumn("__rank", rank).where(F.col("__rank") <= n)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in strata]
    met = few.alias("s").join(broadcast_if_small(give).alias("g"), same)
    return met.where("__rank <= give").select("s.*").drop("__rank")


def best_of(scores: DataFrame, group: str, item: str) -> DataFrame:
    """group, item: the item with the highest rate of wins in a round of comparisons (group, item, won); ties by item."""
    rate = scores.groupBy(group, item).agg(F.avg(F.col("won").cast("double")).alias("rate"))
    return rate.groupBy(group).agg(F.max_by(item, F.struct("rate", (-F.col(item)).alias("i"))).alias(item))
