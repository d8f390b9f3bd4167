"""Over-represented phrases: frequencies, smoothed log ratios, three sources, a quota for each, and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile

SMOOTH, HEAD = 0.5e-6, 200_000
#: Phrases that are always in the lexicon.
SEEDS = (
    "他的眼中闪过一丝不易察觉的复杂情绪",
    "空气仿佛凝固了一般",
    "嘴角勾起一抹意味深长的弧度",
    "她的心跳漏了一拍",
    "一股无名火从心底窜起",
    "时间仿佛静止了",
    "他的声音里带着一丝颤抖",
    "让人不寒而栗",
    "所有的努力都化为了泡影",
    "命运的齿轮开始转动",
    "仿佛抓住了最后一根救命稻草",
    "夜色如墨,压得人喘不过气",
)


def frequencies(docs: DataFrame, profile: Profile, group: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """grp, phrase, n, df: occurrences and documents of each token, counted on the map side first."""
    runs = T.tokens(F.substring(F.coalesce(F.col(text), F.lit("")), 1, HEAD), profile)
    each = docs.select(group.alias("grp"), F.col(doc_id).alias("d"), F.explode_outer(runs).alias("phrase")).where("grp IS NOT NULL AND phrase IS NOT NULL")
    return each.groupBy("grp", "d", "phrase").agg(F.count("*").alias("c")).groupBy("grp", "phrase").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


def lift(p: Column, q: Column) -> Column:
    return F.log((p + SMOOTH) / (q + SMOOTH))


def mine(freq: DataFrame, profile: Profile, top: int = 150, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """phrase, pmi, source, freq_our, freq_corpus, freq_drama, freq_novel, df_drama, rank.

    freq has the groups our, drama and novel. A phrase that two signals find keeps the first one's ratio
    and source, and the second one's frequencies too. Each source has a quota; ties go to the smaller phrase.
    """
    totals = {r["grp"]: r["t"] for r in freq.groupBy("grp").agg(F.sum("n").alias("t")).collect()}  # three rows
    side = lambda g: freq.where(F.col("grp") == g).select("phrase", F.col("n").alias(g), F.col("df").alias(f"df_{g}"))
    rate = lambda g: F.coalesce(F.col(g), F.lit(0)) / F.lit(float(totals.get(g) or 1))
    our, drama, novel = side("our"), side("drama"), side("novel")
    df_drama = F.coalesce("df_drama", F.lit(0))
    first = our.where("our >= 2").join(drama, "phrase", "left").where((df_drama >= 2) | (F.length("phrase") >= profile.short_phrase))
    first = first.withColumn("l1", lift(rate("our"), rate("drama"))).where("l1 > 0.5").select("phrase", "l1", F.col("our").alias("freq_our"), F.coalesce("drama", F.lit(0)).alias("freq_corpus"), df_drama.alias("d1"))
    least = max(5, int(totals.get("drama") or 0) // 2_000_000)
    second = drama.where((F.col("drama") >= least) & (F.col("df_drama") >= 3)).join(novel, "phrase", "left").withColumn("l2", lift(rate("drama"), rate("novel"))).where("l2 > 1.0")
    second = second.select("phrase", "l2", F.col("drama").alias("freq_drama"), F.coalesce("novel", F.lit(0)).alias("freq_novel"), F.col("df_drama").alias("d2"))
    found = first.join(second, "phrase", "full").select("phrase", F.coalesce("l1", "l2").alias("pmi"), F.when(F.col("l1").isNotNull(), "our_vs_drama").otherwise("drama_vs_novel").alias("source"), "freq_our", "freq_corpus", "freq_drama", "freq_novel", F.coalesce("d2", "d1").alias("df_drama"))
    sown = freq.sparkSession.createDataFrame([(s,) for s in seeds], "phrase string").join(found, "phrase", "left_anti")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("pmi", "double"),)]
    rest = [F.lit(None).cast("long").alias(c) for c in ("freq_our", "freq_corpus", "freq_drama", "freq_novel", "df_drama")]
    everything = found.unionByName(sown.select("phrase", *blank, F.lit("seed").alias("source"), *rest))
    quota = {"drama_vs_novel": top // 5, "our_vs_drama": top - top // 5 - 12, "seed": 12}
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.coalesce("pmi", F.lit(99.0)).desc(), "phrase"))
    limit = F.coalesce(*[F.when(F.col("source") == s, q) for s, q in quota.items()])
    # The literal lets each task keep the first of a source before they meet.
    return everything.withColumn("rank", rank).where(F.col("rank") <= max(quota.values())).where(F.col("rank") <= limit)


def density(text: Column, phrases: list[str]) -> Column:
    """Occurrences of the phrases of two or more characters for each 1000 characters without white space, to 4 places.

    The lexicon has at most a few hundred phrases (its quotas) and is folded in as a literal.
    """
    solid = T.solid_length(text)
    use = F.array(*[F.lit(p) for p in phrases if len(p) >= 2]) if any(len(p) >= 2 for p in phrases) else F.array().cast("array<string>")
    hits = F.aggregate(use, F.lit(0).cast("bigint"), lambda a, p: a + T.occurrences(text, p))
    return F.when(solid > 0, F.round(hits * 1000 / solid, 4)).otherwise(0.0)
