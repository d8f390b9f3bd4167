"""Reports, frequencies, fallback scores, packs, sinks and sources against plain Python."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import frequency, replies
from corpusloom.functions import text as T
from corpusloom.functions.profile import LATIN
from corpusloom.operators import cards, degrade, exam, judging, nearindex, pairs, reports
from corpusloom.sources import readers

LEDGER = "round string, ts double, kind string, decision string, winrate double, ci_lo double, ci_hi double, sealed_score double"


def test_by_frequency_is_a_stable_count(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(n)]) for i, n in enumerate((0, 1, 2, 7, 50, 400))] + [(9, None), (10, ["x", None, None])]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, a array<string>").select("i", frequency.by_frequency(F.col("a")).alias("f")).collect()}
    for i, a in rows:
        want = None if a is None else Counter(a).most_common()
        assert (got[i] and [tuple(x) for x in got[i]]) == want if want else got[i] == want or got[i] == []


def test_speakers_tokens_and_genres(spark):
    text = "甲:早\n乙:早\n场景:家\n乙:走吧\n丙\n甲:好"
    rows = spark.createDataFrame([(0, text), (1, ""), (2, None)], "i int, text string")
    got = rows.select("i", frequency.speakers(F.col("text"), r"^([一-龥A-Za-z]{1,8})[:：]", "场景").alias("s"), frequency.most_frequent(F.col("text"), "[一-龥]{2,3}").alias("t"), frequency.genre_of(F.col("text"), {"a": ("早", "无"), "b": ("走", "好"), "c": ("家", "丙")}, "none").alias("g")).orderBy("i").collect()
    assert [tuple(x) for x in got[0]["s"]] == [("甲", 2), ("乙", 2)] and got[0]["t"] == "场景" and got[0]["g"] == "b"  # of equal genres the first named
    assert got[1]["s"] == [] and got[1]["t"] is None and got[1]["g"] == "none"
    assert got[2]["s"] is None and got[2]["t"] is None and got[2]["g"] == "none"


@pytest.mark.parametrize("n", [0, 5, 9, 10, 11, 30])
def test_fragment(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    m = (n - 3) // 2
    want = text if n <= 9 else f"{text[:3]}\n……\n{text[m:m + 3]}\n……\n{text[-3:]}"
    assert spark.createDataFrame([(text,)], "t string").select(T.head_mid_tail(F.col("t"), 3)).first()[0] == want


def test_vote_letters_and_labels(spark):
    said = ["A", " @x b", "@a @b 选B", "no vote", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(T.vote_letter(F.col("s"))).collect()]
    assert got == ["A", "B", "B", "", "", None]
    given = ['@c [{"genre": " war "}, {"genre": "odd"}]', '[{"genre": "war"}]', '[3, {"genre": "love"}]', "nothing", '[{"genre": "war"}, {]', None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").orderBy("i").select(replies.labels(F.col("s"), 2, "genre", ["war", "love"])).collect()]
    assert got == [["war", None], [None, None], [None, "love"], [None, None], [None, None], [None, None]]


def test_scores_fall_back_to_votes(spark):
    directed = [("whole", 0, 0.9, 0.2), ("whole", 1, 0.4, 0.6), ("flat", 0, 0.5, 0.5), ("flat", 1, 0.5, 0.5), ("half", 0, 0.9, 0.1), ("blank", 0, None, 0.3), ("blank", 1, 0.2, 0.4)]
    votes = [(p, f, x) for p in ("whole", "flat", "half", "alone") for f, x in ((True, "A"), (False, "B"), (True, "B"), (False, None))]
    got = judging.scored_pairs(spark.createDataFrame(directed, "pair_id string, direction int, score_first double, score_second double"), spark.createDataFrame(votes, "pair_id string, first_is_a boolean, letter string"))
    got = {r["pair_id"]: tuple(r)[1:] for r in got.collect()}
    assert got["whole"] == (pytest.approx(0.75), pytest.approx(0.3), "compare", 2, None)
    assert got["flat"] == (0.5, 0.5, "votes", 4, "flat")
    assert got["half"][2:] == ("votes", 4, "missing") and got["alone"][2:] == ("votes", 4, "missing")
    assert got["blank"] == (None, None, None, 0, "missing")


@pytest.mark.parametrize("kind", ["string", "long"])
def test_packs_are_in_order(spark, kind):
    rng = random.Random(5)
    ids = rng.sample(range(30_000), 200)
    rows = [(f"pair:{i:08d}" if kind == "string" else i, rng.choice(["x", "y", None])) for i in ids]
    got = {(r["pair_id"], r["direction"], r["k_index"]): r["pack"] for r in exam.packs(spark.createDataFrame(rows, f"pair_id {kind}, axis string"), 3, 7).collect()}
    want = {}
    for axis in ("x", "y", None):
        items = [(p, d, k) for p in sorted(p for p, a in rows if a == axis) for d in (0, 1) for k in range(3)]
        want |= {x: i // 7 for i, x in enumerate(items)}
    assert got == want


def test_promotion_needs_all_three(spark):
    rows = [(1, 0.51, 12, 0.6), (2, 0.5, 12, 0.6), (3, 0.6, 11, 0.6), (4, 0.6, 12, None), (5, None, 12, 0.6)]
    got = exam.promoted(spark.createDataFrame(rows, "i int, ci_lo double, n_briefs int, sealed_score double"))
    assert [r["i"] for r in got.where("promote").collect()] == [1]


def test_bands_have_a_status(spark):
    rows = spark.createDataFrame([("a" if i % 2 else "b", float(i)) for i in range(60)], "kind string, v double")
    assert {r["status"] for r in cards.checked_bands(rows, {"v": "v"}, "kind").collect()} == {"corpus"}
    assert {r["status"] for r in cards.checked_bands(rows.limit(49), {"v": "v"}).collect()} == {"placeholder"}
    with pytest.raises(ValueError, match="no cards"):
        cards.checked_bands(rows.where("false"), {"v": "v"})


def test_pairs_against_the_corpus(spark):
    talk, flat = "Anna: so it is.\n" * 40, "It is a long and even line of text here. " * 40
    made = spark.createDataFrame([("g1", talk), ("g2", flat), ("g3", None)], "id string, text string")
    corpus = spark.createDataFrame([(f"s{i:02d}", f"text {i} " * 300) for i in range(30)] + [("s00x", None)], "id string, text string")
    band = spark.createDataFrame([("dialogue_ratio", 0.0, 0.1), ("sent_len_cv", 0.0, 9.0), ("sent_len_mean", 0.0, 1e9)], "metric string, p25 double, p75 double")
    got = pairs.against_corpus(made, band, corpus, LATIN).collect()
    assert {(r["axis"], r["construction"]["source_run_id"]) for r in got} == {("naturalness", "g1"), ("l0_dialogue", "g1")}
    assert {r["construction"]["source_script_id"] for r in got} == {f"s{i:02d}" for i in range(20)} and len(got) == 40
    assert all(len(r["a_text"]) <= 1200 and r["b_text"] == talk[:1200] and r["label"] == "a_win" for r in got)
    assert pairs.violations(pairs.against_corpus(made, band, corpus, LATIN)).isEmpty()
    total = {(r["split"], r["kind"]): r["n"] for r in pairs.summary(pairs.against_corpus(made, band, corpus, LATIN)).collect()}
    assert total[(None, None)] == 40


def test_splits_and_lines_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([(1, "exam", "x"), (2, "train", "y"), (3, "train", "z")], "id long, split string, t string")
    assert {tuple(r) for r in readers.write_splits(rows, str(tmp_path / "pairs")).collect()} == {("exam", 1), ("train", 2)}
    assert sorted(os.listdir(tmp_path / "pairs"))[-2:] == ["split=exam", "split=train"]
    (tmp_path / "s.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2,\n\n{"id": 3}\n')
    assert {tuple(r) for r in readers.read_lines(spark, str(tmp_path / "s.jsonl"), "id long, t string").collect()} == {(1, "a"), (3, None)}
    docs = spark.createDataFrame([("in/a.txt",), ("in/b.docx",), ("in/c.txt",)], "path string")
    side = spark.createDataFrame([("in/a.meta.yaml", "claimed_genre: war\nclaimed_platform: 'web'\n"), ("in/b.meta.yml", "claimed_platform: tv\n")], "path string, text string")
    got = {r["path"]: (r["claimed_genre"], r["claimed_platform"]) for r in readers.with_sidecars(docs, side).collect()}
    assert got == {"in/a.txt": ("war", "web"), "in/b.docx": ("未声明", "tv"), "in/c.txt": ("未声明", "未声明")}


def test_criteria():
    assert readers.criteria("# head\n\n## clear\nIs it clear?\nAnd why?\n\n## short\nIs it short?\n") == {"clear": "Is it clear?\nAnd why?", "short": "Is it short?"}
    with pytest.raises(ValueError, match="no signal"):
        readers.criteria("# head only\n")


def test_budget_of_a_model(spark):
    rows = spark.range(500).where("id % 2 = 0").withColumnRenamed("id", "doc_id")
    assert sorted(r[0] for r in pairs.capped(rows, "doc_id", 10).collect()) == list(range(0, 20, 2))


def test_degraded_without_the_original(spark):
    docs = spark.createDataFrame([(1, "甲:你好啊\n乙:走吧\n" * 20), (2, None)], "doc_id long, text string")
    whole, bare = degrade.degraded(docs), degrade.degraded(docs, original=False)
    assert "original" not in bare.columns
    assert sorted(map(tuple, whole.drop("original").collect())) == sorted(map(tuple, bare.collect()))


def test_dashboard(spark, tmp_path):
    metrics = spark.createDataFrame([("x", 120, 0.9, 0.96, 0.01, 0.02, True), ("y", 120, 0.8, None, 0.01, 0.02, False)], "axis string, n_pairs long, sensitivity double, block_sensitivity double, position_bias double, pair_flip_rate double, pass boolean")
    rows = [("2024-W01", 1.0, "ab", "accepted", 0.6, 0.52, 0.7, 0.61), ("2024-W02", 2.0, "ab", "rejected", 0.7, 0.4, 0.8, 0.5), ("2024-W01", 1.0, "blind_corpus", None, 0.4, None, None, None), ("2024-W02", 2.0, "blind_corpus", None, 0.3, None, None, None), ("2024-W03", 3.0, "ab", None, None, None, None, None)]
    report = reports.dashboard(spark.createDataFrame(rows, LEDGER), metrics)
    text = reports.text_of(report)
    assert [s for s in text.split("\n") if s.startswith("## ")] == ["## 1. Sealed win rate", "## 2. Open against sealed", "## 3. Blind win rate", "## 4. Defects found", "## 5. Accepted experiments", "## Latest rows"]
    for line in ("| 2024-W01 | 0.600000 | [0.520000, 0.700000] | 0.610000 |", "**latest round 2024-W02: not ahead, the interval reaches 0.5 or less: roll back**", "- rounds with both: 2; more than 0.15 apart: **1**", "  - round 2024-W02: open 0.700000, sealed 0.500000",
                 "**the blind rate does not rise: the inner figures may be spoiled**", "- worst axis: **0.8000**, gate closed", "- decisions 2, accepted 1: healthy", "| 2024-W03 | ab | - | - | - |"):
        assert line in text.split("\n")
    assert text.index("| 2024-W01 | 0.6") < text.index("| 2024-W02 | 0.7")
    assert text.index("| 2024-W03 | ab") < text.index("| 2024-W01 | ab")  # the latest first
    reports.write_report(report, str(tmp_path / "dash"))
    (file,) = [f for f in os.listdir(tmp_path / "dash") if f.endswith(".txt")]
    assert (tmp_path / "dash" / file).read_text() == text
    with pytest.raises(ValueError, match="more than 3 lines"):
        reports.text_of(report, 3)
    empty = reports.text_of(reports.dashboard(spark.createDataFrame([], LEDGER), metrics.where("false")))
    assert empty.count("_no data_") == 6
    told = reports.text_of(reports.exam_report(metrics, "j"))
    assert "- result: **FAIL**, scores are only reported" in told and "| y | 120 | 0.8000 | - | 0.0100 | 0.0200 | no |" in told


def test_yaml_documents(spark):
    rows = spark.createDataFrame([(2, 'say "no"', None), (1, "b", 0.5)], "rank int, item string, v double")
    text = reports.text_of(reports.yaml_list(rows, "items", F.col("rank")))
    head, *items = text.strip().split("\n")
    assert head == "items:" and [json.loads(s[2:]) for s in items] == [{"rank": 1, "item": "b", "v": 0.5}, {"rank": 2, "item": 'say "no"', "v": None}]
    assert reports.text_of(reports.yaml_list(rows.where("false"), "items", F.col("rank"))) == "items: []\n"
    band = spark.createDataFrame([(None, "m", 60, 1.0, 2.0, 3.0, "corpus"), ("novel", "m", 60, 1.0, 2.0, 3.0, "corpus")], "grp string, metric string, n long, p25 double, p50 double, p75 double, status string")
    want = 'version: 2\nn_scripts: 60\ndata_source: "store"\nstatus: corpus\nbands:\n  m: {p25: 1.000000, p50: 2.000000, p75: 3.000000}\nby_kind:\n  "novel":\n    n: 60\n    bands:\n      m: {p25: 1.000000, p50: 2.000000, p75: 3.000000}\n'
    assert reports.text_of(reports.bands_yaml(band, "store")) == want
    assert reports.text_of(reports.bands_yaml(band.where("grp IS NULL"), "store")).endswith("by_kind: {}\n")


def test_index_merges_its_batches(spark, tmp_path):
    rng = random.Random(8)
    heads = [rng.getrandbits(64) for _ in range(8)]
    rows = [(i, f"{rng.choice(heads) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)):016x}") for i in range(60)]
    cut = lambda a, b: spark.createDataFrame(rows[a:b], "id long, simhash string")
    plain, merged = (nearindex.NearIndex(spark, str(tmp_path / n), bands=4) for n in ("plain", "merged"))
    assert merged.merge(0) == 0
    for seq, (a, b) in enumerate(((0, 15), (15, 30), (30, 45), (45, 60))):
        want = sorted(map(tuple, plain.admit(cut(a, b), seq).collect()), key=str)
        assert sorted(map(tuple, merged.admit(cut(a, b), seq).collect()), key=str) == want
        if seq in (1, 2):
            before = {tuple(r) for r in merged.stored().collect()}
            assert merged.merge(seq) > 0 and {tuple(r) for r in merged.stored().collect()} == before
    parts = {p for b in os.listdir(tmp_path / "merged") if b.startswith("band=") for p in os.listdir(tmp_path / "merged" / b)}
    assert parts == {"part=-3", "part=3"}
    again = sorted(map(tuple, merged.admit(cut(30, 45), 2).collect()), key=str)  # a batch that runs again after its merge
    assert again == sorted(map(tuple, plain.admit(cut(30, 45), 2).collect()), key=str)


def test_cards_are_computed_once_for_profile_and_bands(spark):
    """The report read and parsed all documents for its counts and again for its bands."""
    from corpusloom.plans import catalogue, report_queries  # noqa: F401 - registers the query
    from tests.conftest import SF

    plan = catalogue.QUERIES["report_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "corpusloom-cards" in plan
