"""The split join of frequent keys is a left join; a lone conversation takes the next other answer."""

import pytest

from corpusloom.llm import chat_format, common
from corpusloom.sources import tables


@pytest.mark.parametrize("small", [True, False])
def test_attach_is_a_left_join(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(common, "broadcast_if_small", lambda df: df)
        monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(60)] + [(i, "bare") for i in range(60, 70)]
    table = [("hot", 1), *[(f"k{i}", i) for i in range(0, 60, 2)]]
    r = tables.written(spark.createDataFrame(rows, "i long, k string"), "r")
    t = tables.written(spark.createDataFrame(table, "k string, x long"), "t")
    got = sorted((x["i"], x["k"], x["x"]) for x in common.attach(r, t, "k").collect())
    assert got == sorted((i, k, dict(table).get(k)) for i, k in rows)


def test_a_neighbour_with_the_same_answer_is_passed_over(spark):
    rows = []
    for c, answer in enumerate(["same", "same", "same", "other", None]):
        rows += [(c, 0, "user", f"question {c}")] + ([(c, 1, "assistant", answer)] if answer else [])
    got = {r["chosen_id"]: r for r in chat_format.pair_up(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {c: r["rejected_id"] for c, r in got.items()} == {0: 3, 1: 3, 2: 3, 3: 0, 4: None}
    assert [t["text"] for t in got[1]["rejected"]] == ["question 1", "other"]
