"""Text primitives and cards against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import LATIN, ZH_DRAMA
from corpusloom.operators import cards

TEXTS = ["", "a", " 　\x1c", "one\r\ntwo\x0bthree\n\n  four  ", "第1集\n场景:家\n甲:你好。\n【钩子】门!\n第2集\n\n乙：走…\n完", "前言\n第一章\n\n正文很长。真的?\n\n尾", "x y\x85z", "A. B! C? D"]


def _rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_spaces_lines(spark):
    t = F.col("text")
    for r in _rows(spark).select("text", T.squeezed(t).alias("z"), T.lines(t).alias("l"), T.raw_lines(t).alias("raw")).collect():
        assert r["z"] == "".join(r["text"].split())
        assert r["l"] == [s.strip() for s in r["text"].splitlines() if s.strip()]
        assert r["raw"] == r["text"].splitlines()


def test_counts_ids_splits(spark):
    import hashlib

    row = _rows(spark, ["aaaa banana", "甲乙"]).select("text", T.occurrences(F.col("text"), F.lit("ana")).alias("n"), T.base32_id(F.col("text")).alias("b"), T.split_of(F.col("text")).alias("s")).collect()
    for r in row:
        n = int(hashlib.sha256(r["text"].encode()).hexdigest()[:32], 16)
        assert r["b"] == "".join(T.BASE32[n >> (5 * i) & 31] for i in range(25, -1, -1))
        assert r["n"] == r["text"].count("ana")
        h = int(hashlib.sha256(r["text"].encode()).hexdigest()[:8], 16) % 100
        assert r["s"] == ("exam" if h < 20 else "train" if h < 80 else "val")


def test_card_of_a_drama(spark):
    r = cards.cards(_rows(spark), ZH_DRAMA).where("id = 4").first()
    assert (r["kind"], r["n_episodes"], r["n_scenes"], r["n_lines"]) == ("drama_script", 2, 1, 7)
    assert r["hook_positions"] == [4 / 7]
    assert r["ep_char_counts"] == [len("第1集场景:家甲:你好。【钩子】门!"), len("第2集乙：走…完")]
    assert abs(r["dialogue_ratio"] - 5 / r["total_chars"]) < 1e-12


def test_text_before_the_first_title_is_a_segment(spark):
    r = cards.cards(_rows(spark), ZH_DRAMA).where("id = 5").first()
    assert r["ep_char_counts"] == [2, 12] and r["kind"] == "novel"


def test_null_text_has_an_empty_card(spark):
    r = cards.cards(_rows(spark, [None]), LATIN).first()
    assert r["total_chars"] == 0 and r["ep_char_counts"] == [] and r["sent_len_cv"] == 0.0


def test_bands_follow_the_exclusive_rule(spark):
    groups = {"a": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0], "b": [3.0, 1.0, 2.0], "c": [5.0] * 9, "d": [7.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["grp"]: (r["p25"], r["p50"], r["p75"]) for r in cards.bands(rows, {"v": "v"}, "g").collect()}
    every = sum(groups.values(), [])
    assert got[None] == tuple(statistics.quantiles(every, n=4))
    assert got["a"] == (2.0, 8.0, 32.0) and got["b"] == (1.0, 2.0, 3.0) and got["c"] == (5.0, 5.0, 5.0) and got["d"] == (7.0, 7.0, 7.0)
    arrays = rows.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("a")).select("g", *cards.exclusive_quartiles(F.col("a")))
    assert {r[0]: tuple(r[1:]) for r in arrays.collect()} == {g: got[g] for g in groups}


def test_gate(spark):
    rows = _rows(spark, [None, " \n", "短", "字" * 200, "x" * 300])
    got = [r[0] for r in rows.orderBy("id").select(cards.gate_reason(F.col("text"), ZH_DRAMA)).collect()]
    assert got == ["unextractable", "not_scriptlike", "not_scriptlike", None, "not_scriptlike"]
    got = [r[0] for r in rows.orderBy("id").select(cards.gate_reason(F.col("text"), ZH_DRAMA, F.col("id") != 3)).collect()]
    assert got[3] == "nontext"


def test_bands_of_skewed_ties_and_a_null_group(spark):
    r = random.Random(3)
    values = [(None if i % 7 == 0 else "ab"[i % 2], float(r.choice([0, 0, 0, 5, r.random(), 1e9 * r.random()]))) for i in range(3001)]
    got = {x["grp"]: (x["n"], x["p25"], x["p50"], x["p75"]) for x in cards.bands(spark.createDataFrame(values, "g string, v double"), {"v": "v"}, "g").orderBy("n").collect() if x["grp"] or x["n"] > 2000}
    for g in (None, "a", "b"):
        of = [v for k, v in values if g is None or k == g]
        assert got[g] == (len(of), *(round(q, 6) for q in statistics.quantiles(of, n=4)))
    both = cards.bands(spark.createDataFrame(values, "g string, v double"), {"v": "v"}, "g").where("grp IS NULL")
    assert sorted(x["n"] for x in both.collect()) == [sum(k is None for k, _ in values), 3001]


def test_votes(spark):
    rows = _rows(spark, ["1:A 2:B 3:A", "A B", "1:B 3:A", "@x 2:a 2:B", ""])
    got = [r[0] for r in rows.orderBy("id").select(T.packed_votes(F.col("text"), 3)).collect()]
    assert got == [["A", "B", "A"], ["A", "B", ""], ["B", "", "A"], ["", "B", ""], ["", "", ""]]


def test_lists_of_spaces_and_breaks_are_the_patterns(spark):
    """Texts are trimmed and squeezed by a list of characters, not by a pattern, which took most of the time of cards."""
    import random

    from pyspark.sql import functions as F

    from corpusloom.functions import text as T
    from corpusloom.functions.profile import LATIN, LINE_BREAK, SPACE, SPACES

    odd = [*SPACES, "\r\n", "", ".", "..", "a", "é", "中", "😀", "​", "﻿", "\x1b", "b c.", "!?"]
    rng = random.Random(4)
    texts = ["", " ", SPACES, SPACES + "x" + SPACES, *("".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(500))]
    t, ends = F.col("t"), f"^[{SPACE}]+|[{SPACE}]+$"
    cut = lambda parts: F.filter(F.transform(parts, lambda s: F.regexp_replace(s, ends, "")), lambda s: s != "")
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    pairs = [(T.squeezed(t), F.regexp_replace(t, f"[{SPACE}]", "")), (T.stripped(t), F.regexp_replace(t, ends, "")), (T.lines(t), cut(F.split(t, LINE_BREAK))), (T.sentences(t, LATIN), cut(F.split(t, f"(?<=[{LATIN.sentence_end}])")))]
    differ = rows.select("t", *[(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    assert differ.where("d0 OR d1 OR d2 OR d3").collect() == []


def test_raw_lines_are_those_of_splitlines_without_a_pattern_for_the_end(spark):
    """The end was found by a pattern that was tried at every character."""
    import random

    from pyspark.sql import functions as F

    from corpusloom.functions import text as T

    rng = random.Random(6)
    texts = ["", "\n", "\r\n", "\n\r", "a\r\n", "a\n\n", *("".join(rng.choices(["\n", "\r", "\r\n", "\x0b", "\x1c", "\x85", " ", "a", " ", "é"], k=rng.randrange(1, 12))) for _ in range(300))]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", T.raw_lines(F.col("t")).alias("x"))
    assert all(r["x"] == (None if r["t"] is None else r["t"].splitlines()) for r in rows.collect())
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
