"""One statistics card for each document, the quality gate, and percentile bands over cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile

METRICS = ("dialogue_ratio", "sent_len_mean", "sent_len_cv", "para_len_cv", "hook_density", "n_episodes", "ep_char_median")


def cards(docs: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """docs with the card's columns, computed in place without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    ls = F.col("__lines")
    is_title = lambda s: s.rlike(profile.title)
    said = lambda s: F.when(is_speech(s, profile), F.regexp_extract(s, profile.speech, 2)).otherwise("")
    base = docs.withColumn("__lines", T.lines(t)).withColumn("__sents", F.transform(T.sentences(t, profile), lambda s: T.solid_length(s).cast("double"))).withColumn("__paras", F.transform(T.paragraphs(t), lambda s: T.solid_length(s).cast("double")))
    total = T.solid_length(t).cast("long")
    spoken = F.aggregate(ls, F.lit(0), lambda a, s: a + T.solid_length(said(s)))
    n_lines, n_titles = F.size(ls), F.size(F.filter(ls, is_title))
    n_scenes = F.size(F.filter(ls, lambda s: s.rlike(profile.scene)))
    n_said = F.size(F.filter(ls, lambda s: is_speech(s, profile)))
    mean, cv = T.mean_and_cv(F.col("__sents"))
    _, pcv = T.mean_and_cv(F.col("__paras"))
    hooks = F.filter(F.transform(ls, lambda s, i: F.when(is_hook(s, profile), (i + 1) / n_lines)), lambda p: p.isNotNull())
    out = base.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when((n_scenes > 0) | (n_titles > 0) & (n_said / F.greatest(n_lines, F.lit(1)) >= 0.3), "drama_script").otherwise("novel").alias("kind"),
        n_titles.alias("n_episodes"), n_scenes.alias("n_scenes"), n_lines.alias("n_lines"), total.alias("total_chars"),
        F.when(total > 0, spoken / total).otherwise(0.0).alias("dialogue_ratio"),
        F.size("__sents").alias("n_sents"), mean.alias("sent_len_mean"), cv.alias("sent_len_cv"),
        F.size("__paras").alias("n_paras"), F.when(F.size("__paras") > 1, pcv).otherwise(0.0).alias("para_len_cv"),
        hooks.alias("hook_positions"), segment_chars(ls, profile).alias("ep_char_counts"),
    )
    sorted_counts = F.array_sort("ep_char_counts")
    k = F.size("ep_char_counts")
    median = F.when(k == 0, 0.0).otherwise((F.get(sorted_counts, F.floor((k - 1) / 2).cast("int")) + F.get(sorted_counts, F.floor(k / 2).cast("int"))) / 2.0)
    density = F.when(F.col("n_episodes") > 0, F.size("hook_positions") / F.col("n_episodes")).otherwise(0.0)
    return out.withColumn("hook_density", density).withColumn("ep_char_median", median)


def is_speech(line: Column, profile: Profile) -> Column:
    return line.rlike(profile.speech) & (F.regexp_extract(line, profile.speech, 1) != profile.not_speaker) & ~line.startswith("【")


def is_hook(line: Column, profile: Profile) -> Column:
    out = F.lit(False)
    for h in profile.hooks:
        out = out | line.contains(h)
    return out


def segment_chars(lines: Column, profile: Profile) -> Column:
    """Characters of the segments that titles open; text before the first title is a segment of its own."""
    state = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("bigint").alias("open"))

    def step(a: Column, s: Column) -> Column:
        n = T.solid_length(s).cast("bigint")
        shut = s.rlike(profile.title) & (a["open"] >= 0)
        return F.struct(
            F.when(shut, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(shut | (a["open"] < 0), n).otherwise(a["open"] + n).alias("open"),
        )

    return F.aggregate(lines, state, step, lambda a: F.when(a["open"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def gate_reason(text: Column, profile: Profile, readable: Column | None = None) -> Column:
    """Why a text isn't taken in, or null: nontext, unextractable or not_scriptlike.

    readable tells whether a file's suffix is one that is read at all; without it every text is.
    """
    return (
        F.when(F.lit(False) if readable is None else ~readable, "nontext")
        .when(text.isNull(), "unextractable")
        .when((T.solid_length(text) < profile.gate_chars) | (T.letter_ratio(text, profile) < profile.gate_ratio), "not_scriptlike")
    )


def exclusive_quartiles(values: Column) -> list[Column]:
    """[p25, p50, p75] of an ascending array by the exclusive rule; fewer than 4 values give least, median, most."""
    n = F.size(values)

    def at(i: int) -> Column:
        j = F.greatest(F.least(F.floor(i * (n + 1) / 4), n - 1), F.lit(1)).cast("int")
        rest = i * (n + 1) - 4 * j
        return (F.get(values, j - 1) * (4 - rest) + F.get(values, j) * rest) / 4.0

    median = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0
    few = [F.array_min(values), median, F.array_max(values)]
    return [F.round(F.when(n == 0, 0.0).when(n < 4, few[i - 1]).otherwise(at(i)), 6) for i in (1, 2, 3)]


#: Runs that the values of a metric of a group are cut into; a power of two.
RUNS = 256


def run_of(v: Column, edges: Column) -> Column:
    """How many of up to RUNS - 1 ascending edges are less than v, by halving."""
    steps = F.array(*[F.lit(RUNS >> i) for i in range(1, RUNS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < v, at + step).otherwise(at))


def bands(rows: DataFrame, metrics: dict[str, str], group: str | None = None) -> DataFrame:
    """metric, n, p25, p50, p75 over all rows (group null) and for each group.

    Equal values are counted first. Approximate quantiles cut the different values of a metric into RUNS runs;
    exact counts of the runs tell which few of them hold the places that an exclusive quartile is made of, and
    only their values are ranked, each run by itself. No task sees a whole metric, and the result is exact.
    """
    from corpusloom.sources.tables import broadcast_if_small, written

    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in metrics.items()]))
    own = F.col(group).cast("string") if group else F.lit(None).cast("string")
    long = rows.select(own.alias("grp"), stacked.alias("x")).select("grp", "x.*").where("v IS NOT NULL")
    counted = long.groupBy("grp", "metric", "v").agg(F.count("*").alias("c"))
    # A key that tells the rows of all from those of the group null.
    each = counted.select(F.concat(F.lit("="), F.coalesce("grp", F.lit("\0"))).alias("key"), "grp", "metric", "v", "c")
    if group:
        total = counted.groupBy("metric", "v").agg(F.sum("c").alias("c"))
        each = each.unionByName(total.select(F.lit("*").alias("key"), F.lit(None).cast("string").alias("grp"), "metric", "v", "c"))
    each = written(each, "counted")
    edges = written(each.groupBy("key", "metric").agg(F.percentile_approx("v", [i / RUNS for i in range(1, RUNS)], 4 * RUNS).alias("edges")), "edges")
    each = each.join(broadcast_if_small(edges), ["key", "metric"]).withColumn("run", run_of(F.col("v"), F.col("edges"))).drop("edges")
    sizes = each.groupBy("key", "metric", "run").agg(F.sum("c").alias("size"))
    of = Window.partitionBy("key", "metric")
    sizes = sizes.withColumn("n", F.sum("size").over(of)).withColumn("before", F.sum("size").over(of.orderBy("run")) - F.col("size"))
    n = F.col("n")
    place = {i: F.greatest(F.least(F.floor(i * (n + 1) / 4), n - 1), F.lit(1)) for i in (1, 2, 3)}
    few = [F.lit(1).cast("long"), F.floor((n + 1) / 2), F.floor((n + 2) / 2), n]
    wanted = F.when(n < 4, F.array(*few)).otherwise(F.array(*place.values(), *[p + 1 for p in place.values()]))
    sizes = written(sizes.where(F.exists(wanted, lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("size")))).drop("size"), "sizes")
    ranked = each.join(broadcast_if_small(sizes), ["key", "metric", "run"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("key", "metric", "run").orderBy("v"))
    ranked = ranked.withColumn("upto", upto)

    def value_at(pos: Column) -> Column:
        return F.max(F.when((pos > F.col("upto") - F.col("c")) & (pos <= F.col("upto")), F.col("v")))

    parts, out = [], []
    for i, name in ((1, "p25"), (2, "p50"), (3, "p75")):
        parts += [value_at(place[i]).alias(f"a{i}"), value_at(place[i] + 1).alias(f"b{i}")]
        rest = i * (n + 1) - 4 * place[i]
        short = {1: F.col("low"), 2: (F.col("m1") + F.col("m2")) / 2.0, 3: F.col("high")}[i]
        out.append(F.round(F.when(n < 4, short).otherwise((F.col(f"a{i}") * (4 - rest) + F.col(f"b{i}") * rest) / 4.0), 6).alias(name))
    parts += [value_at(p).alias(x) for p, x in zip(few, ("low", "m1", "m2", "high"), strict=True)]
    return ranked.groupBy("key", "grp", "metric", "n").agg(*parts).select("grp", "metric", "n", *out)


#: Fixed value: cards that bands need to serve as an anchor.
LEAST_CARDS = 50


def checked_bands(rows: DataFrame, metrics: dict[str, str], group: str | None = None) -> DataFrame:
    """bands with status: `corpus` where all rows are at least LEAST_CARDS, else `placeholder`; ValueError for no rows at all."""
    from corpusloom.sources.tables import broadcast_if_small

    if rows.isEmpty():
        raise ValueError("no cards: bands over nothing would mislead whatever is held against them")
    n = rows.agg(F.when(F.count("*") >= LEAST_CARDS, "corpus").otherwise("placeholder").alias("status"))
    return bands(rows, metrics, group).crossJoin(broadcast_if_small(n))  # n is one row
