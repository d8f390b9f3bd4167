"""Reports as tables of lines (section, part, place, line): a line is made where its row is, a sink writes them in that order.

Nothing is collected to make a report; `text_of` fetches a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import exam

ORDER = ("section", "part", "place", "line")
#: How far a sealed score may be from the open one, shares of accepted experiments that are healthy, rows of the appendix.
APART, HEALTHY, LATEST = 0.15, (0.3, 0.7), 20


def _each(rows: DataFrame, section: int, line: Column, part: Column | None = None, place: Column | None = None) -> DataFrame:
    part, place = F.lit("") if part is None else part, F.lit(0) if place is None else place
    return rows.select(F.lit(section).alias("section"), part.cast("string").alias("part"), place.cast("double").alias("place"), line.alias("line"))


def _said(one: DataFrame, section: int, *lines: Column | str) -> DataFrame:
    """The lines of a frame of one row, in their order; null ones are left out."""
    each = F.array(*[F.struct(F.lit(float(i)).alias("place"), (F.lit(c) if isinstance(c, str) else c).alias("line")) for i, c in enumerate(lines)])
    return one.select(F.lit(section).alias("section"), F.lit("").alias("part"), F.explode(each).alias("x")).select("section", "part", "x.*").where("line IS NOT NULL")


def _together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def number(c: Column, places: int = 4) -> Column:
    """A number in print; null has a dash."""
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{places}f", c.cast("double")))


def _cells(*cols: Column) -> Column:
    shown = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def _table(*names: str) -> tuple[str, str]:
    return "| " + " | ".join(names) + " |", "|" + "---|" * len(names)


def text_of(report: DataFrame, most: int = 10_000) -> str:
    """A small report as one text; ValueError if it has more lines than `most`."""
    rows = report.orderBy(*ORDER).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines: write the report")
    return "\n".join(r["line"] for r in rows) + "\n"


def write_report(report: DataFrame, path: str) -> None:
    """A report as one text file in a folder."""
    report.repartition(1).sortWithinPartitions(*ORDER).select("line").write.mode("overwrite").text(path)


def exam_report(metrics: DataFrame, judge: str) -> DataFrame:
    """The exam of a judge: its result, and a row for each axis. metrics: as exam.axis_metrics."""
    result = F.when(F.col("pass"), "- result: **PASS**, scores count").otherwise("- result: **FAIL**, scores are only reported")
    head = _said(exam.overall(metrics), 0, "# Exam of the judges", "", f"- judge: {judge}", result, "", *_table("axis", "n", "sensitivity", "block sensitivity", "position bias", "pair flip rate", "pass"))
    shown = [number(F.col(c)) for c in ("sensitivity", "block_sensitivity", "position_bias", "pair_flip_rate")]
    rows = _each(metrics, 1, _cells(F.col("axis"), F.col("n_pairs"), *shown, F.when(F.col("pass"), "yes").otherwise("no")), F.col("axis"))
    return _together(head, rows)


def dashboard(ledger: DataFrame, metrics: DataFrame) -> DataFrame:
    """Five panels and the latest rows of an experiment ledger (round, ts, kind, decision, winrate, ci_lo, ci_hi, sealed_score).

    Rounds are in the order of their names (numbers by value), then by time; a round without a score has a dash. A panel without
    rows says so.
    """
    part, none = F.lpad(F.col("round").cast("string"), 20, "0"), "_no data_"
    at = F.struct(part, F.col("ts"))
    num = lambda c: number(F.col(c), 6)
    ab = ledger.where("kind = 'ab'")
    sealed = ab.where("sealed_score IS NOT NULL")
    last = sealed.agg(F.count("*").alias("n"), F.max_by(F.struct("round", "ci_lo"), at).alias("last"))
    some, name = F.col("n") > 0, F.col("last.round").cast("string")
    ahead = F.when(F.coalesce("last.ci_lo", F.lit(0.0)) > 0.5, ": ahead, the interval is above 0.5**").otherwise(": not ahead, the interval reaches 0.5 or less: roll back**")
    out = [_said(last, 10, "# Dashboard", "", "## 1. Sealed win rate", "", *[F.when(some, t) for t in _table("round", "win rate", "CI95", "sealed")], F.when(~some, none))]
    out.append(_each(sealed, 11, _cells(F.col("round"), num("winrate"), F.concat(F.lit("["), num("ci_lo"), F.lit(", "), num("ci_hi"), F.lit("]")), num("sealed_score")), part, F.col("ts")))
    out.append(_said(last, 12, F.when(some, ""), F.when(some, F.concat(F.lit("**latest round "), name, ahead))))

    both = sealed.where("winrate IS NOT NULL")
    apart = F.abs(F.col("sealed_score") - F.col("winrate")) > APART
    counts = both.agg(F.count("*").alias("n"), F.count_if(apart).alias("alarms"))
    found = F.concat(F.lit("- rounds with both: "), F.col("n").cast("string"), F.lit(f"; more than {APART} apart: **"), F.col("alarms").cast("string"), F.lit("**"))
    out.append(_said(counts, 20, "", "## 2. Open against sealed", "", F.when(some, found).otherwise(none), F.when(some & (F.col("alarms") == 0), "- none apart, open scores can be trusted")))
    out.append(_each(both.where(apart), 21, F.concat(F.lit("  - round "), F.col("round").cast("string"), F.lit(": open "), num("winrate"), F.lit(", sealed "), num("sealed_score")), part, F.col("ts")))

    blind = ledger.where("kind = 'blind_corpus' AND winrate IS NOT NULL")
    trend = blind.agg(F.count("*").alias("n"), F.min_by("winrate", at).alias("first"), F.max_by("winrate", at).alias("latest"))
    out.append(_said(trend, 30, "", "## 3. Blind win rate", "", *[F.when(some, t) for t in _table("round", "blind win rate")], F.when(~some, none)))
    out.append(_each(blind, 31, _cells(F.col("round"), num("winrate")), part, F.col("ts")))
    flat = (F.col("n") >= 2) & (F.col("latest") <= F.col("first"))
    out.append(_said(trend, 32, F.when(flat, ""), F.when(flat, "**the blind rate does not rise: the inner figures may be spoiled**")))

    worst = exam.worst_axis(metrics)
    state = F.concat(F.lit("- worst axis: **"), number(F.col("worst")), F.lit("**"), F.when(F.col("closed"), ", gate closed").otherwise(", gate open"))
    out.append(_said(worst, 40, "", "## 4. Defects found", "", F.coalesce(F.when(F.col("worst").isNotNull(), state), F.lit(none))))

    good = F.col("decision").startswith("accepted") | (F.col("decision") == "promoted")
    ratio = F.col("good") / F.col("n")
    told = F.when(ratio.between(*HEALTHY), "healthy").when(ratio == 1.0, "all accepted: cheated or noise").when(ratio > HEALTHY[1], "too many").otherwise("too few")
    share = F.concat(F.lit("- decisions "), F.col("n").cast("string"), F.lit(", accepted "), F.col("good").cast("string"), F.lit(": "), told)
    out.append(_said(ab.where("decision <> ''").agg(F.count("*").alias("n"), F.count_if(good).alias("good")), 50, "", "## 5. Accepted experiments", "", F.when(some, share).otherwise(none)))

    latest = ledger.orderBy(F.desc_nulls_last("ts"), F.desc("round")).limit(LATEST)
    out.append(_said(ledger.limit(1).agg(F.count("*").alias("n")), 60, "", "## Latest rows", "", *[F.when(some, t) for t in _table("round", "kind", "decision", "win rate", "sealed")], F.when(~some, none)))
    out.append(_each(latest, 61, _cells(F.col("round"), F.col("kind"), F.col("decision"), num("winrate"), num("sealed_score")), place=-F.coalesce(F.col("ts"), F.lit(float("-inf")))))
    return _together(*out)


def _band(indent: str) -> Column:
    return F.concat(F.lit(indent), F.col("metric"), F.lit(": {p25: "), number(F.col("p25"), 6), F.lit(", p50: "), number(F.col("p50"), 6), F.lit(", p75: "), number(F.col("p75"), 6), F.lit("}"))


def bands_yaml(bands: DataFrame, source: str) -> DataFrame:
    """Bands (as cards.checked_bands) as YAML: version, number, status, all bands, bands of each kind. Kinds are quoted."""
    whole, kinds = bands.where("grp IS NULL"), bands.where("grp IS NOT NULL")
    status = whole.agg(F.max("n").cast("string").alias("n"), F.max("status").alias("status"))
    out = [_said(status, 0, "version: 2", F.concat(F.lit("n_scripts: "), "n"), f'data_source: "{source}"', F.concat(F.lit("status: "), "status"), "bands:")]
    out.append(_each(whole, 1, _band("  "), F.col("metric")))
    sizes = kinds.groupBy("grp").agg(F.max("n").cast("string").alias("n"))
    some = sizes.limit(1).agg(F.count("*").alias("n"))
    out.append(_said(some, 2, F.when(F.col("n") > 0, "by_kind:").otherwise("by_kind: {}")))
    title = F.array(F.concat(F.lit('  "'), "grp", F.lit('":')), F.concat(F.lit("    n: "), "n"), F.lit("    bands:"))
    out.append(_each(sizes.select("grp", F.posexplode(title).alias("i", "t")), 3, F.col("t"), F.col("grp"), F.col("i") - 3))
    out.append(_each(kinds, 3, _band("      "), F.col("grp")))
    return _together(*out)


def profile_report(cards: DataFrame, bands: DataFrame, genre: str) -> DataFrame:
    """The profile of a corpus: its size, kinds and genres, and a table of bands for each kind."""
    text = lambda c: c.cast("string")
    total = cards.agg(F.count("*").alias("n"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("chars"), F.coalesce(F.min("n_episodes"), F.lit(0)).alias("lo"), F.coalesce(F.max("n_episodes"), F.lit(0)).alias("hi"))
    span = F.concat(F.lit("- episodes: "), text(F.col("lo")), F.lit(" to "), text(F.col("hi")))
    out = [_said(total, 0, "# Profile of the corpus", "", F.concat(F.lit("- scripts: **"), text(F.col("n")), F.lit("**")), F.concat(F.lit("- characters without white space: "), text(F.col("chars"))), span)]
    counted = lambda c, label: cards.groupBy(F.coalesce(text(F.col(c)), F.lit("-")).alias("g")).agg(F.count("*").alias("n")).select("g", F.concat(F.lit(f"- {label} "), "g", F.lit(": "), text(F.col("n"))).alias("t"))
    for section, (c, label) in enumerate((("kind", "kind"), (genre, "genre")), 1):
        out.append(_each(counted(c, label), section, F.col("t"), F.col("g")))
    kinds = bands.where("grp IS NOT NULL")
    title = F.array(F.lit(""), F.concat(F.lit("## Bands of "), "grp", F.lit(" (n="), text(F.col("n")), F.lit(")")), F.lit(""), *[F.lit(t) for t in _table("metric", "P25", "P50", "P75")])
    out.append(_each(kinds.groupBy("grp").agg(F.max("n").alias("n")).select("grp", F.posexplode(title).alias("i", "t")), 3, F.col("t"), F.col("grp"), F.col("i") - 5))
    out.append(_each(kinds, 3, _cells(F.col("metric"), *[number(F.col(p), 6) for p in ("p25", "p50", "p75")]), F.col("grp")))
    return _together(*out)


def smoke_report(groups: DataFrame, judge: str) -> DataFrame:
    """Candidates against the champion. groups: candidate, n_pairs, wins, losses, ties, winrate."""
    one = groups.agg(F.count("*").alias("n"))
    head = _said(one, 0, "# Smoke test", "", f"- judge: {judge}", F.concat(F.lit("- candidates: "), F.col("n").cast("string")), "", *_table("candidate", "n", "wins", "losses", "ties", "win rate"))
    rows = _each(groups, 1, _cells(*[F.col(c) for c in ("candidate", "n_pairs", "wins", "losses", "ties")], number(F.col("winrate"))), F.col("candidate"))
    return _together(head, rows)


def digest_report(head: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns of a corpus: head has n and median, patterns kind, item, n, rank."""
    number_of = F.concat(F.lit("- cards: "), F.col("n").cast("string"), F.lit("; median of episodes: "), number(F.col("median"), 1))
    titles = patterns.groupBy("kind").agg(F.count("*").alias("c")).select("kind", F.posexplode(F.array(F.lit(""), F.concat(F.lit("## "), "kind"), F.lit(""))).alias("i", "t"))
    rows = _each(patterns, 1, F.concat(F.lit("- "), "item", F.lit(" ×"), F.col("n").cast("string")), F.col("kind"), F.col("rank"))
    return _together(_said(head, 0, "# Patterns", "", number_of), _each(titles, 1, F.col("t"), F.col("kind"), F.col("i") - 3), rows)


def yaml_list(rows: DataFrame, name: str, place: Column) -> DataFrame:
    """A table as a YAML list under a name, in the order of place; an item is JSON, which YAML reads."""
    item = F.concat(F.lit("- "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))
    some = rows.limit(1).agg(F.count("*").alias("n"))
    return _together(_said(some, 0, F.when(F.col("n") > 0, f"{name}:").otherwise(f"{name}: []")), _each(rows, 1, item, place=place))
