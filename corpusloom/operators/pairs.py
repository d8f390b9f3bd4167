"""Preference pairs: ids, validation, splits, construction from degraded texts and from bands, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile
from corpusloom.operators import cards, degrade

#: Axes and kinds that a pair may have.
AXES = ("hook_strength", "prose_craft", "naturalness", "transportation", "placement_integration", "producibility", "l0_structure", "l0_fact", "l0_brand", "l0_dialogue")
KINDS = ("corpus_degraded", "gen_degraded", "corpus_vs_gen")
#: Patterns of lines that are not narrative, and of those that are.
META = r"▲|【[^】]{1,12}】|剧\s*名|书名|类型|梗概|题材|作者|出品|集数|主演|简介|文案|备注|人物表|人物介绍|人物小传|主要人物|原著|时长|基本信息|故事亮点|故事大纲|分集|目录|^\s*\d+[-—.、]\d+、"
CHAPTER = r"^(第[0-9零一二三四五六七八九十百千]+[集章节回卷部]|序章|楔子|番外|尾声)"
QUOTED = r"[“「『].{2,}?[”」』]"
TALK = r"^场景:|" + degrade.SPOKEN
BUDGET, LEAST = 1200, 100


def excerpt(text: Column) -> Column:
    """Narrative from the first scene or spoken line on, else a chapter line, else a long line; null if too thin."""
    def first(whole: Column, test) -> Column:
        return F.get(F.filter(F.transform(whole, lambda s, i: F.when((s != "") & ~s.rlike(META) & test(s), i)), lambda i: i.isNotNull()), F.lit(0))

    def anchor(bare: Column) -> Column:
        return F.coalesce(first(bare, lambda s: s.rlike(TALK)), first(bare, lambda s: s.rlike(CHAPTER)), first(bare, lambda s: F.length(s) >= 30))

    def valid(body: Column) -> Column:
        talk = F.exists(body, lambda s: s["bare"].rlike(TALK) | s["bare"].rlike(QUOTED))
        long = F.size(F.filter(body, lambda s: F.length(s["bare"]) >= 30)) >= 2
        out = F.substring(F.array_join(F.transform(body, lambda s: s["raw"]), "\n"), 1, BUDGET)
        return F.when((talk | long) & (F.length(out) >= LEAST), out)

    def from_anchor(whole: Column, start: Column) -> Column:
        rest = F.slice(whole, start + 1, F.greatest(F.size(whole), F.lit(1)))
        return F.when(start.isNotNull(), T.let(F.filter(rest, lambda s: (s["bare"] != "") & ~s["bare"].rlike(META)), valid))

    pieces = F.transform(T.raw_lines(text), lambda s: F.struct(s.alias("raw"), T.stripped(s).alias("bare")))
    return T.let(pieces, lambda w: T.let(anchor(F.transform(w, lambda s: s["bare"])), lambda start: from_anchor(w, start)))


def pair_id(axis: Column, a: Column, b: Column, kind: Column, op: Column) -> Column:
    """`pair:` and 26 digits from the content, whatever the split."""
    body = F.sha2(F.concat(a, F.char(F.lit(0)), b), 256)
    return F.concat(F.lit("pair:"), T.base32_id(F.concat_ws("|", axis, body, kind, F.coalesce(op, F.lit("")))))


def violations(pairs: DataFrame, only: tuple[str, ...] | None = None, unknown: bool = True) -> DataFrame:
    """pair_id, violation: every rule that a pair breaks, of those named in `only`. unknown: a rule that a null leaves open is broken."""
    rules = {
        "axis": ~F.col("axis").isin(*AXES),
        "label": ~F.col("label").isin("a_win", "b_win"),
        "kind": ~F.col("construction.kind").isin(*KINDS),
        "empty_text": (T.stripped(F.col("a_text")) == "") | (T.stripped(F.col("b_text")) == ""),
        "same_text": F.col("a_text") == F.col("b_text"),
        "op_missing": F.col("construction.kind").endswith("_degraded") & F.col("construction.op_id").isNull(),
        "split": ~F.col("split").isin("exam", "train", "val"),
        "pair_id": ~F.col("pair_id").rlike("^pair:[0-9a-z]{26}$"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(unknown)), F.lit(k)) for k, c in rules.items() if only is None or k in only]))
    return pairs.select("pair_id", F.explode(broken).alias("violation"))


def strict(pairs: DataFrame) -> DataFrame:
    """pairs, or a ValueError that names a broken rule."""
    if bad := violations(pairs).limit(1).collect():
        raise ValueError(f"{bad[0]['pair_id']} breaks rule {bad[0]['violation']}")
    return pairs


def from_degraded(degraded: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """The pair table of (key, op_id, severity, original, degraded): the original wins."""
    axis = F.coalesce(*[F.when(F.col("op_id") == k, o.axis) for k, o in degrade.REGISTRY.items()])
    source = F.col(key).cast("string")
    run = kind == "gen_degraded"
    none = F.lit(None).cast("string")
    built = F.struct(F.lit(kind).alias("kind"), "op_id", "severity", (none if run else source).alias("source_script_id"), (source if run else none).alias("source_run_id"))
    rows = degraded.select(axis.alias("axis"), F.col("original").alias("a_text"), F.col("degraded").alias("b_text"), F.lit("a_win").alias("label"), built.alias("construction"))
    rows = rows.withColumn("split", T.split_of(F.concat(F.lit("run:"), F.col("construction.source_run_id")) if run else F.col("construction.source_script_id")))
    return rows.withColumn("pair_id", pair_id(F.col("axis"), F.col("a_text"), F.col("b_text"), F.lit(kind), F.concat(F.col("construction.op_id"), F.col("construction.severity").cast("string")))).select("pair_id", "axis", "a_text", "b_text", "label", "construction", "split")


def leaks(pairs: DataFrame) -> DataFrame:
    """id, n_splits: sources that are in more than one split."""
    return pairs.groupBy(F.col("construction.source_script_id").alias("id")).agg(F.count_distinct("split").alias("n_splits")).where("id IS NOT NULL AND n_splits > 1")


def still_to_do(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done, keys, "left_anti")


def out_of_band(generated: DataFrame, bands: DataFrame, corpus: DataFrame, metrics: dict[str, str], first: int = 20) -> DataFrame:
    """gen_id, axis, corpus_id: generated texts outside the middle half of a band, each with the first corpus texts.

    generated: id and the metrics; bands: metric, p25, p75 (a row for each metric); corpus: id. Only the
    `first` corpus ids of least value and the few bands are broadcast.
    """
    long = generated.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for a, m in metrics.items()])).alias("x")).select("id", "x.*")
    outside = long.join(F.broadcast(bands.select("metric", "p25", "p75")), "metric").where("v < p25 OR v > p75")
    heads = corpus.orderBy("id").limit(first).select(F.col("id").alias("corpus_id"))
    return outside.crossJoin(F.broadcast(heads)).select(F.col("id").alias("gen_id"), "axis", "corpus_id")


#: The metric that stands for an axis where corpus and generated texts are compared, and the characters compared.
AXIS_METRICS = {"naturalness": "dialogue_ratio", "l0_dialogue": "dialogue_ratio", "prose_craft": "sent_len_cv", "transportation": "sent_len_mean"}


def against_corpus(generated: DataFrame, bands: DataFrame, corpus: DataFrame, profile: Profile, metrics: dict[str, str] | None = None, first: int = 20) -> DataFrame:
    """The pair table of generated texts (id, text) against corpus texts (id, text): the corpus text wins.

    A generated text is judged by the card of its first BUDGET characters, and paired on every axis whose metric is outside
    the band (bands: metric, p25, p75) with the `first` corpus texts of least id; inside, nothing can be said. The split is that of the
    corpus text, so no source is in two splits. The corpus texts, at most `first` of BUDGET characters, are broadcast.
    """
    metrics = metrics or AXIS_METRICS
    piece = F.substring("text", 1, BUDGET)
    own = cards.cards(generated.where("text IS NOT NULL").select("id", piece.alias("text")), profile)
    texts = own.select("id", F.col("text").alias("b_text"), *sorted(set(metrics.values())))
    long = texts.select("id", "b_text", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for a, m in metrics.items()])).alias("x")).select("id", "b_text", "x.*")
    outside = long.join(F.broadcast(bands.select("metric", "p25", "p75")), "metric").where("v < p25 OR v > p75")
    heads = corpus.where("text IS NOT NULL").orderBy("id", "text").limit(first).select(F.col("id").cast("string").alias("source"), piece.alias("a_text"))
    none = F.lit(None)
    built = F.struct(F.lit("corpus_vs_gen").alias("kind"), none.cast("string").alias("op_id"), none.cast("double").alias("severity"), F.col("source").alias("source_script_id"), F.col("id").cast("string").alias("source_run_id"))
    rows = outside.crossJoin(F.broadcast(heads)).select("axis", "a_text", "b_text", F.lit("a_win").alias("label"), built.alias("construction"), T.split_of(F.col("source")).alias("split"))
    named = pair_id(F.col("axis"), F.col("a_text"), F.col("b_text"), F.lit("corpus_vs_gen"), F.lit(""))
    return rows.select(named.alias("pair_id"), "axis", "a_text", "b_text", "label", "construction", "split")


def summary(pairs: DataFrame) -> DataFrame:
    """split, kind, n with subtotals (null)."""
    return pairs.rollup("split", F.col("construction.kind").alias("kind")).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, key: str, most: int = 300) -> DataFrame:
    """The first `most` rows by key: a budget for calls of a model."""
    return rows.orderBy(key).limit(most)


