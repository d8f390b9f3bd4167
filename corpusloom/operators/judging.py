"""Scores of texts and products: the penalty score, votes of k samples, artefacts, exam filters, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the penalty score, the density at which phrases cost all they can, buckets of episodes.
OFF_BAND, PHRASES, DENSITY = 0.7, 0.3, 20.0
EPISODES = ((0, 0), (1, 24), (25, 59), (60, 99))
#: Pairs that an artefact needs, and works that an anchor needs.
LEAST_PAIRS, LEAST_WORKS = 6, 50
NOT_EXAMINED = "corpus_vs_gen"


def penalty_score(rows: DataFrame, band: DataFrame, metrics: list[str], density: str) -> DataFrame:
    """rows with score: 1 less what its metrics are off the band and what its phrases cost, at least 0.

    band: metric, p25, p75; a row for each metric. Without a band a metric costs nothing.
    """
    limits = band.agg(*[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"__{m}_{p}") for m in metrics for p in ("p25", "p75")])

    def off(m: str) -> Column:
        v, lo, hi = F.col(m), F.col(f"__{m}_p25"), F.col(f"__{m}_p75")
        far = F.least(F.lit(1.0), F.abs(v - (lo + hi) / 2) / F.greatest(hi - lo, F.lit(1e-9)))
        return F.when(lo.isNull() | v.between(lo, hi), F.lit(0.0)).otherwise(far)

    mean = sum((off(m) for m in metrics[1:]), off(metrics[0])) / len(metrics)
    score = F.greatest(F.lit(0.0), 1 - mean * OFF_BAND - F.least(F.lit(1.0), F.col(density) / DENSITY) * PHRASES)
    one_row = rows.crossJoin(F.broadcast(limits))  # limits is one row
    return one_row.withColumn("score", F.round(score, 4)).drop(*limits.columns)


def sample_votes(votes: DataFrame) -> DataFrame:
    """pair_id, n, score_a, score_b: shares of the votes (pair_id, first_is_a, letter) in which either text is better."""
    mine = (F.col("letter") == F.when(F.col("first_is_a"), "A").otherwise("B")).cast("double")
    share = votes.groupBy("pair_id").agg(F.count("*").alias("n"), F.avg(F.coalesce(mine, F.lit(0.0))).alias("score_a"))
    return share.withColumn("score_b", 1 - F.col("score_a"))


def scored_pairs(directed: DataFrame, votes: DataFrame) -> DataFrame:
    """pair_id, score_a, score_b, engine, calls, reason of every pair of either table.

    directed: pair_id, direction (1: text B is shown first), score_first, score_second, a row for each call of a scorer. A text's score is
    its mean over both directions. Where a direction is missing or has no score (`missing`), or all scores are a half, as a
    scorer gives that can't be read (`flat`), votes (pair_id, first_is_a, letter) decide; without these too the scores are null.
    """
    at = lambda c, d: F.avg(F.when(F.col("direction") == d, F.col(c)))
    sides = {"a0": at("score_first", 0), "b0": at("score_second", 0), "b1": at("score_first", 1), "a1": at("score_second", 1)}
    half = F.bool_and((F.col("score_first") == 0.5) & (F.col("score_second") == 0.5))
    two = directed.groupBy("pair_id").agg(*[c.alias(k) for k, c in sides.items()], half.alias("flat"), F.count("*").alias("c"))
    whole = F.col("a0").isNotNull() & F.col("a1").isNotNull() & F.col("b0").isNotNull() & F.col("b1").isNotNull()
    reason = F.when(~whole, "missing").when(F.col("flat"), "flat")
    two = two.select("pair_id", "a0", "a1", "b0", "b1", "c", reason.alias("reason"), F.lit(True).alias("met"))
    by_vote = sample_votes(votes).select("pair_id", F.col("n").alias("v"), F.col("score_a").alias("va"), F.col("score_b").alias("vb"))
    both = two.join(by_vote, "pair_id", "full").withColumn("reason", F.when(F.col("met").isNull(), "missing").otherwise(F.col("reason")))
    direct = F.col("reason").isNull()
    pick = lambda d, v: F.when(direct, d).otherwise(v)
    engine = F.when(direct, "compare").when(F.col("v").isNotNull(), "votes")
    return both.select("pair_id", pick((F.col("a0") + F.col("a1")) / 2, F.col("va")).alias("score_a"), pick((F.col("b0") + F.col("b1")) / 2, F.col("vb")).alias("score_b"), engine.alias("engine"), pick(F.col("c"), F.coalesce("v", F.lit(0))).alias("calls"), "reason")


def examinable(pairs: DataFrame, kind: str = "kind", verified: str = "verified") -> DataFrame:
    """The pairs of an exam: constructed defects that are verified to be there."""
    return pairs.where((F.coalesce(F.col(kind), F.lit("")) != NOT_EXAMINED) & F.coalesce(F.col(verified), F.lit(False)))


def exam_counts(pairs: DataFrame, kind: str = "kind", verified: str = "verified") -> DataFrame:
    """excluded, unverified, kept: one row."""
    out = F.coalesce(F.col(kind), F.lit("")) == NOT_EXAMINED
    good = F.coalesce(F.col(verified), F.lit(False))
    return pairs.agg(F.count_if(out).alias("excluded"), F.count_if(~out & ~good).alias("unverified"), F.count_if(~out & good).alias("kept"))


def artefact_scores(votes: DataFrame) -> DataFrame:
    """axis, n_pairs, score, winrate, enough: a product against corpus texts, from votes (axis, pair, direction, letter).

    In direction 0 the product is text B, in direction 1 text A; a direction without votes counts a half.
    """
    share = lambda d, letter: F.coalesce(F.avg(F.when(F.col("direction") == d, F.coalesce((F.col("letter") == letter).cast("double"), F.lit(0.0)))), F.lit(0.5))
    by_pair = votes.groupBy("axis", "pair").agg(((share(0, "B") + share(1, "A")) / 2).alias("s"))
    out = by_pair.groupBy("axis").agg(F.count("*").alias("n_pairs"), F.round(F.avg("s"), 4).alias("score"), F.round(F.avg((F.col("s") > 0.5).cast("double")), 4).alias("winrate"))
    return out.withColumn("enough", F.col("n_pairs") >= LEAST_PAIRS)


def smoke_groups(outcomes: DataFrame) -> DataFrame:
    """candidate, n_pairs, wins, losses, ties, winrate: each candidate configuration against the default.

    outcomes: candidate, ours, theirs, the scores of both on a brief and seed; a tie is half a win.
    """
    won, lost = F.col("ours") > F.col("theirs"), F.col("ours") < F.col("theirs")
    out = outcomes.groupBy("candidate").agg(F.count("*").alias("n_pairs"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"))
    ties = F.col("n_pairs") - F.col("wins") - F.col("losses")
    return out.select("*", ties.alias("ties"), F.round((F.col("wins") + ties / 2) / F.col("n_pairs"), 4).alias("winrate"))


def episode_bucket(episodes: Column) -> Column:
    """The bucket of a number of episodes, as `1-24`; beyond the last one `100+`."""
    out = F.lit(f"{EPISODES[-1][1] + 1}+")
    for lo, hi in reversed(EPISODES):
        out = F.when(episodes <= hi, f"{lo}-{hi}").otherwise(out)
    return F.when(episodes.isNotNull(), out)


def anchored(band_status: str, n_works: int) -> None:
    """Refuse to go on without bands of a real corpus."""
    if band_status != "corpus" or n_works < LEAST_WORKS:
        raise ValueError(f"bands of {n_works} works with status {band_status!r} are no anchor; {LEAST_WORKS} works of a corpus are needed")


def briefs(ids: DataFrame, buckets: list[tuple[int, int, float]], genres: dict[str, float], anchors: list[str], mentions: tuple[int, int], seed: int, brief_id: str = "brief_id") -> DataFrame:
    """brief_id, episodes, genre, anchor, mentions: a drawn brief for each id, the same at every run and in any order.

    buckets: least, most, weight. Draws are 31-bit checksums of seed, id and what is drawn, so a brief needs no other one.
    """
    draw = lambda what: F.crc32(F.concat_ws("|", F.lit(seed), F.col(brief_id), F.lit(what)).cast("binary")) % (1 << 31)

    def weighted(what: str, weights: list[float]) -> Column:
        """The place of the drawn weight."""
        upto, total, place = 0.0, sum(weights), F.lit(len(weights) - 1)
        u = draw(what) / float(1 << 31) * total
        for i, w in enumerate(weights[:-1]):
            upto += w
            place = F.least(place, F.when(u < upto, i).otherwise(len(weights) - 1))
        return place

    of = ids.select(brief_id, weighted("bucket", [b[2] for b in buckets]).alias("b"), weighted("genre", list(genres.values())).alias("g"))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    lo, hi = pick([b[0] for b in buckets], F.col("b")), pick([b[1] for b in buckets], F.col("b"))
    return of.select(
        brief_id,
        (lo + draw("episodes") % (hi - lo + 1)).cast("int").alias("episodes"),
        pick(list(genres), F.col("g")).alias("genre"),
        pick(anchors, (draw("anchor") % len(anchors)).cast("int")).alias("anchor"),
        (mentions[0] + draw("mentions") % (mentions[1] - mentions[0] + 1)).cast("int").alias("mentions"),
    )
