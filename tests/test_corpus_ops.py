"""Indexes, seals, rankings, quotas, samples, cards and line-wise texts against plain Python."""

import hashlib
import hmac
import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import nested
from corpusloom.functions.profile import LATIN, ZH_DRAMA
from corpusloom.operators import annotation, dedup, degrade, digest, exam, judging, leakindex, linewise, nearindex, ranking, seal

PRINTS = "id long, simhash string"


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def families(seed, n=120):
    rng = random.Random(seed)
    heads = [rng.getrandbits(64) for _ in range(12)]
    return [(i, f"{flipped(rng.choice(heads), rng.sample(range(64), rng.randint(0, 4))):016x}") for i in range(n)]


def scan(rows):
    """id to the first kept document within three bits, reading in order."""
    kept, out = [], {}
    for i, s in rows:
        first = next((k for k, t in kept if (int(s, 16) ^ int(t, 16)).bit_count() <= 3), None)
        out[i] = first
        if first is None:
            kept.append((i, s))
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_near_pairs_are_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(nearindex, "HOT", hot)
    rows = families(1, 80)
    first = {}
    for i, s in rows:
        first.setdefault(s, i)
    want = {(min(a, b), max(a, b), d) for s, a in first.items() for t, b in first.items() if s < t and (d := (int(s, 16) ^ int(t, 16)).bit_count()) <= 3}
    got = [tuple(r) for r in nearindex.pairs(spark.createDataFrame(rows, PRINTS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_grow_with_the_documents(spark):
    rng = random.Random(3)
    rows = [(i, f"{rng.getrandbits(64):016x}") for i in range(20_000)]
    counts = []
    for n in (2_000, 20_000):
        k = nearindex.keyed(spark.createDataFrame(rows[:n], PRINTS))
        pairs = k.groupBy("k").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
        counts.append(pairs / n)
    assert max(counts) < 0.2  # unrelated fingerprints hardly ever meet; four bands of 16 bits would give 0.6 at 20,000, growing with n


def test_index_admits_as_the_scan_does_and_reads_its_own_bands(spark, tmp_path):
    rows = families(2, 150)
    index = nearindex.NearIndex(spark, str(tmp_path / "index"), bands=256)
    got = {}
    for seq, (a, b) in enumerate([(0, 90), (90, 93), (93, 150)]):
        batch = spark.createDataFrame(rows[a:b], PRINTS)
        if seq == 1:
            touched = index.bands_of(batch)
            assert 0 < len(touched) <= 3 * 35 < 256
            read = index.stored(touched, seq)
            files = {r["f"].split("band=")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
            assert files and files <= {str(t) for t in touched}
        for _ in range(2 if seq == 1 else 1):  # a batch that runs again changes nothing
            out = {r["id"]: r["duplicate_of"] for r in index.admit(batch, seq).collect()}
        got |= out
    assert got == scan(rows)


def test_incremental_removal_drops_nobody_for_a_dropped_document(spark):
    a, b, c = 0, flipped(0, [1, 2, 3]), flipped(0, [1, 2, 3, 4, 5, 6])
    stored = spark.createDataFrame([(1, f"{a:016x}")], PRINTS)
    new = spark.createDataFrame([(2, f"{b:016x}"), (3, f"{c:016x}"), (4, f"{c:016x}")], PRINTS)
    assert {r["id"]: r["duplicate_of"] for r in dedup.without_known(new, stored).collect()} == {2: 1, 3: None, 4: 3}


def test_rolling_hash_tells_windows_apart():
    text = "abcabc" * 40 + "日本語" * 30
    h = dedup.rolling(text)
    by = {}
    for i in range(len(text) - 49):
        by.setdefault(text[i : i + 50], set()).add(int(h[i]))
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)
    assert len(dedup.rolling("short")) == len(dedup.rolling(None)) == 0


def test_window_hits_keep_rows_of_one_id_apart(spark, monkeypatch):
    clean, leaked = "x" * 10 + "quite another text that nobody has ever written before, at all", "before " + "the benchmark item that must never be seen in training data " * 2
    docs = spark.createDataFrame([(1, clean), (1, leaked), (None, leaked), (2, None), (3, "")], "doc_id long, text string")
    index = dedup.window_index(spark.createDataFrame([("the benchmark item that must never be seen in training data " * 2,)], "text string"))
    for most in (10, 0):
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
        got = sorted((str(r["doc_id"]), r["hits"] > 0) for r in dedup.window_hits(docs, index, every=True).collect())
        assert got == [("1", False), ("1", True), ("2", False), ("3", False), ("None", True)]


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, mtime long, text string")


def test_a_changed_file_renews_its_own_part(spark, tmp_path):
    rows = [(f"a/{i}.txt", 100, 1, f"file {i} says " + f"words of number {i} " * 8) for i in range(12)] + [("a/none.txt", 0, 1, ""), ("a/null.txt", 0, 1, None)]
    index = leakindex.LeakIndex(spark, str(tmp_path / "leaks"), LATIN, parts=64)
    assert {r["change"] for r in index.refresh(files_of(spark, rows)).collect()} == {"added"}
    stamps = lambda: {p: max(os.stat(os.path.join(d, f)).st_mtime_ns for f in fs) for d, _, fs in os.walk(tmp_path / "leaks") for p in [d.rsplit("part=")[-1]] if "part=" in d and fs}
    before = stamps()
    rows[3] = ("a/3.txt", 101, 2, "a new text altogether, in which nothing of the old one is left to be found")
    gone = rows.pop(5)
    changes = {r["path"]: (r["change"], str(r["part"])) for r in index.refresh(files_of(spark, rows)).collect()}
    assert {p: c for p, (c, _) in changes.items()} == {"a/3.txt": "changed", gone[0]: "removed"}
    after = stamps()
    assert {p for p in before if before[p] != after[p]} == {part for _, part in changes.values()}
    fresh = leakindex.LeakIndex(spark, str(tmp_path / "again"), LATIN, parts=3)
    fresh.refresh(files_of(spark, rows))
    assert {r["w"] for r in index.windows().collect()} == {r["w"] for r in fresh.windows().collect()}
    assert index.refresh(files_of(spark, rows)).collect() == []


def test_windows_need_a_letter_of_the_script(spark):
    rows = spark.createDataFrame([("a", "1234567890" * 12), ("b", "短"), ("c", "1" * 60 + "字" + "1" * 60)], "path string, text string")
    got = {}
    for r in leakindex.file_windows(rows, ZH_DRAMA).collect():
        got.setdefault(r["path"], []).append(r["w"])
    assert set(got) == {"b", "c"} and got["b"] == ["短"] and all("字" in w for w in got["c"])


def test_verdicts_exempt_fixtures_suffixes_and_short_texts(spark, tmp_path):
    body = "sentence that was lifted from the corpus word by word, with nothing changed in it"
    index = leakindex.LeakIndex(spark, str(tmp_path / "v"), LATIN, parts=4)
    index.refresh(files_of(spark, [("c.txt", 1, 1, body)]))
    rows = [("w/a.md", "x " + body), ("w/a.png", body), ("tests/fixtures/a.md", body), ("w/short.md", body[:49]), ("w/clean.md", body.upper()), ("w/null.md", None), ("noext", body)]
    got = {r["path"]: (r["exempt"], r["leaked"]) for r in leakindex.verdicts(spark.createDataFrame(rows, "path string, text string"), index).collect()}
    assert got == {"w/a.md": (False, True), "w/a.png": (True, False), "tests/fixtures/a.md": (True, False), "w/short.md": (True, False), "w/clean.md": (False, False), "w/null.md": (True, False), "noext": (True, False)}


def test_seal(spark):
    rows = [(f"d/{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(40)] + [("ünïcode", "0" * 64)]
    frame = lambda r: spark.createDataFrame(r, "path string, sha256 string")
    for key in (b"k", b"key " * 40):
        lock = seal.seal(frame(rows), key, 8).first()
        assert lock["mac"] == hmac.new(key, lock["digest"].encode(), hashlib.sha256).hexdigest()
        assert seal.seal(frame(rows[::-1]).repartition(5), key, 8).first() == lock
    check = lambda now, locked, key: tuple(seal.verify(frame(now), frame(locked), lock["mac"], key, 8).first())
    assert check(rows, rows, key) == (True, 0, True)
    tampered = [(rows[0][0], "f" * 64), *rows[1:]]
    assert check(tampered, rows, key) == (True, 1, False)
    assert check([*rows, ("new", "a" * 64)], rows, key) == (True, 1, False)
    assert check(rows, rows, b"another key") == (False, 0, False)
    assert check(tampered, tampered, key) == (False, 0, False)  # the lock itself was changed
    assert check(tampered, tampered, None) == (True, 0, True)  # without a key only the manifests are compared


def plain_fit(games, items):
    s = np.zeros(len(items))
    for _ in range(200):
        g, h = np.zeros(len(s)), np.zeros((len(s), len(s)))
        for a, b, w in games:
            p = 1 / (1 + np.exp(s[b] - s[a]))
            g[a] += w - p
            g[b] -= w - p
            h[a, a] += p * (1 - p)
            h[b, b] += p * (1 - p)
            h[a, b] -= p * (1 - p)
            h[b, a] -= p * (1 - p)
        p = 1 / (1 + np.exp(-s))
        g += ranking.PRIOR * (0.5 - p)
        h += np.diag(ranking.PRIOR * p * (1 - p))
        s += np.linalg.solve(h, g)
    return s


def test_strengths_are_the_likeliest(spark):
    rng = random.Random(4)
    true, games = [0.0, 0.5, 1.0, -1.0, 2.0], []
    for _ in range(200):
        a, b = rng.sample(range(5), 2)
        games.append((a, b, rng.choice([0.5, 1.0 if rng.random() < 1 / (1 + np.exp(true[b] - true[a])) else 0.0])))
    rows = [("g", *x) for x in games] + [("g", 1, 1, 1.0), ("g", 1, 2, None), ("h", 7, 8, 1.0)]
    frame = spark.createDataFrame(rows, "g string, a int, b int, share double")
    got = {(r["g"], r["item"]): r["strength"] for r in ranking.strengths(frame, "g", "a", "b", "share").collect()}
    want = plain_fit(games, range(5))
    assert all(abs(got["g", i] - want[i]) < 1e-5 for i in range(5))
    assert abs(got["h", 7] + got["h", 8]) < 1e-5 < got["h", 7]
    best = {r["g"]: r["item"] for r in ranking.select_best(frame, "g", "a", "b", "share").collect()}
    assert best == {"g": int(want.argmax()), "h": 7}


def test_pivot_pairs_are_linear(spark):
    items = spark.createDataFrame([("g", i) for i in range(30)] * 2, "g string, i int")
    got = [tuple(r) for r in ranking.pivot_pairs(items, "g", "i", 2).collect()]
    pivots = sorted(range(30), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:2]
    assert sorted(got) == sorted(("g", i, p) for i in range(30) for p in pivots if i != p)


def test_quota_refuses_what_comes_late(spark):
    base = datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(i, base + timedelta(seconds=rng.randint(0, 5) if i % 3 else rng.randint(0, 2_000_000))) for i in range(300)] + [(900, None)]
    got = {r["id"]: (r["round"], r["place"], r["admitted"]) for r in exam.admitted(spark.createDataFrame(rows, "id long, ts timestamp"), "id", quota=25).collect()}
    seen, want = {}, {900: (None, None, False)}
    for i, ts in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        week = ts.strftime("%G-W%V")
        seen[week] = seen.get(week, 0) + 1
        want[i] = (week, seen[week], seen[week] <= 25)
    assert got == want


def test_a_missing_letter_abstains(spark):
    votes = spark.createDataFrame([("x", 1, "o", 0, "A"), ("x", 1, "o", 0, None), ("x", 1, "o", 1, ""), ("x", 1, "o", 1, "B")], "axis string, pair_id int, op_id string, direction int, letter string")
    m = exam.axis_metrics(votes).first()
    assert (m["sensitivity"], m["position_bias"]) == (0.0, 0.0)
    assert tuple(exam.abstentions(votes).first()) == ("x", 4, 2)


def test_an_exam_without_axes_is_not_passed(spark):
    frame = lambda rows: spark.createDataFrame(rows, "axis string, pass boolean")
    assert tuple(exam.overall(frame([])).first()) == (0, 0, False)
    assert tuple(exam.overall(frame([("a", True), ("b", True)])).first()) == (2, 2, True)
    assert tuple(exam.overall(frame([("a", True), ("b", False)])).first()) == (2, 1, False)


@pytest.mark.parametrize(("sizes", "n"), [({"a": 50, "b": 30, "c": 1}, 20), ({"a": 5, "b": 3, "c": 1}, 9), ({"a": 5, "b": 3}, 50), ({"a": 2, "b": 9, "c": 9, "d": 1}, 3), ({None: 7, "a": 3, "b": 90}, 10)])
def test_apportioned_sample_is_exact(spark, sizes, n):
    rows = [(k, f"{k}-{i}") for k, m in sizes.items() for i in range(m)]
    got = exam.stratified_exact(spark.createDataFrame(rows, "s string, id string"), ["s"], "id", n).collect()
    assert len(got) == len({r["id"] for r in got}) == min(n, len(rows))
    count = {k: sum(r["s"] == k for r in got) for k in sizes}
    if n >= len(sizes):
        assert min(count.values()) >= 1
        fair = {k: 1 + (min(n, len(rows)) - len(sizes)) * (m - 1) / max(1, len(rows) - len(sizes)) for k, m in sizes.items()}
        assert all(abs(count[k] - fair[k]) < 1 for k in sizes)
    for k in sizes:
        mine = sorted((i for s, i in rows if s == k), key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))
        assert {r["id"] for r in got if r["s"] == k} == set(mine[: count[k]])


CARD = "unit int, seen int, tension int, hook_type string, cliffhanger string, conflict_type string, info_gap string, scene_turn boolean, stakes string, reversals string, summary string"


def test_majority_card(spark):
    cards = [
        (1, 1, 4, "Threat", "reveal", None, "", True, "s1", "r1", "t1"), (1, 2, None, "promise", "reveal", "self", "", True, "s2", "r2", "t2"),
        (1, 3, 2, "promise ", "danger", "person", "", False, "s3", "r3", "t3"), (1, 4, 2, "threat", "danger", "person", "", None, "s4", "r4", "t4"), (2, 9, None, None, None, None, None, None, None, None, "only"),
    ]
    got = {r["unit"]: tuple(r)[1:] for r in annotation.majority_card(spark.createDataFrame(cards, CARD), "unit", "seen").collect()}
    # tensions 0 2 2 4: the upper median is 2, first seen in card 3; threat and promise are equal, threat came first.
    assert got[1] == (4, 2, "threat", "reveal", "person", "", "true", "s3", "r3", "t3")
    assert got[2] == (1, 0, "", "", "", "", "", None, None, "only")


def test_card_agreement(spark):
    one = [(1, 0, 3, "Threat", "a", "b", "c", True, None, None, None), (2, 0, 3, "x", "a", "b", "c", True, None, None, None), (3, 0, None, "x", "a", "b", "c", True, None, None, None)]
    two = [(1, 0, 4, "threat", "a", "b", "c", True, None, None, None), (2, 0, 5, "x", "a", "B", None, False, None, None, None), (3, 0, 1, "x", "a", "b", "c", True, None, None, None)]
    got = tuple(annotation.card_agreement(spark.createDataFrame(one, CARD), spark.createDataFrame(two, CARD), "unit").first())
    assert got == (3, round(2 / 3, 4), round((6 + 3) / 12, 4), False)
    assert tuple(annotation.card_agreement(spark.createDataFrame([], CARD), spark.createDataFrame([], CARD), "unit").first()) == (0, 0.0, 0.0, False)
    a, b = (spark.createDataFrame(r, "unit int, g string") for r in ([(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "x"), (3, "x")]))
    assert tuple(annotation.genre_agreement(a, b, "unit", "g").first()) == (2, 0.5, False)


def test_craft_rates(spark):
    cards = [(1, i, 3, ["threat", "Promise", "none", None][i], ["reveal", "danger", "x", None][i], ["person", "person", "person", "self"][i], ["none", "who", None, "what"][i], [True, False, None, True][i], None, None, None) for i in range(4)]
    got = annotation.craft_score(spark.createDataFrame(cards, CARD)).first().asDict()
    rates = {"hook_attack": 0.5, "conflict_person": 0.75, "info_gap": 0.75, "cliffhanger_rd": 0.5, "scene_turn": 0.5}
    assert {k: got[k] for k in rates} == rates
    assert got["score"] == round(sum(min(1, rates[k] / a) * w for k, (a, w) in annotation.MIXED.items()), 4)
    assert annotation.craft_score(spark.createDataFrame([], CARD)).collect() == []


@pytest.mark.parametrize(("mark", "counts"), [("?", True), ("!", True), ("？", False), ("！", False), ("?」", True), ("。", False)])
def test_a_cliffhanger_ends_in_a_plain_mark(spark, mark, counts):
    original = "他走了。" * 20 + "谁在那里" + mark
    row = spark.createDataFrame([(original, "他走了。" * 20)], "o string, d string")
    got = row.select(degrade.fits_rewriter(F.col("o"))["D03_flatten_cliffhanger"].alias("p"), degrade.verified(F.lit("D03_flatten_cliffhanger"), F.col("o"), F.col("d")).alias("v"), degrade.verified(F.lit("D03_flatten_cliffhanger"), F.col("o"), F.col("o")).alias("same")).first()
    assert tuple(got) == (counts, counts, False)


def test_line_wise_texts(spark):
    text = "甲:走吧啊!\n【回收】线索\n旁白啊\n乙:好呢。？ \n丙：好呢"
    row = spark.createDataFrame([(text,)], "t string").select(linewise.setup_cut(F.col("t")).alias("cut"), linewise.formalized(F.col("t")).alias("flat"), linewise.setup_cut(F.lit("nothing\n")).alias("same")).first()
    assert row["cut"] == "甲:走吧啊!\n旁白啊\n乙:好呢。？ \n丙：好呢" and row["same"] == "nothing\n"
    assert row["flat"] == "甲:走!\n【回收】线索\n旁白啊\n乙:好。？ \n丙：好呢"


@pytest.mark.parametrize("seed", range(4))
def test_deletion_keeps_to_its_budget(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))) + rng.choice(["品牌", ""]) for _ in range(25)]
    text = "\n".join(lines)
    most, gone, kept = len("".join(text.split())) * 0.3, 0, []
    for s in text.splitlines():
        n = len("".join(s.split()))
        if "品牌" in s and gone + n <= most:
            gone += n
        else:
            kept.append(s)
    got = spark.createDataFrame([(text,), (None,), ("",), ("品牌" * 5,)], "t string").select(linewise.deleted_within_budget(F.col("t"), linewise.is_brand).alias("x")).collect()
    assert [r["x"] for r in got] == ["\n".join(kept) if gone else text, None, "", "品牌" * 5]


def test_digest(spark):
    rows = [(["b", "a", "b"], ["h"], None, 3), (["a", None], [], ["r"], 0), (None, ["h"], ["r"], 8)]
    frame = spark.createDataFrame(rows, "beats array<string>, hooks array<string>, reversals array<string>, n_episodes int")
    assert {tuple(r) for r in digest.pattern_digest(frame).collect()} == {("beats", "a", 2, 1), ("beats", "b", 2, 2), ("hooks", "h", 2, 1), ("reversals", "r", 2, 1)}
    assert {tuple(r)[:2] for r in digest.pattern_digest(frame, {"beats": 1, "hooks": 1}).collect()} == {("beats", "a"), ("hooks", "h")}
    assert tuple(digest.digest_head(frame, F.col("n_episodes")).first()) == (3, 5.5)
    assert tuple(digest.digest_head(frame.limit(0), F.col("n_episodes")).first()) == (0, None)


def test_nested_works(spark):
    works = [
        {"lines": [{"text": " second ", "order": 2}, {"text": "first"}, {"text": "  ", "order": 1}, {"text": "also first", "order": 0}], "episodes": [{"scenes": [{"lines": ["no"]}]}]},
        {"lines": [], "episodes": [{"scenes": [{"lines": ["a", ""]}, {"beats": ["b"]}, {"lines": [], "beats": ["never"]}]}, {}, {"scenes": [{"lines": [" c "]}]}]},
        {}, None,
    ]
    rows = spark.createDataFrame([(json.dumps(w) if w is not None else None,) for w in works] + [("not json",)], "j string")
    assert [r["t"] for r in rows.select(nested.work_text(F.col("j")).alias("t")).collect()] == ["first\nalso first\nsecond", "a\nb\n c ", "", "", ""]


def test_outcomes_and_scores_with_null_and_repeated_ids(spark, tmp_path):
    from corpusloom.plans import catalogue, corpus_queries, judging_queries  # noqa: F401

    rows = [(1, "en", "src1", "The first text. " * 40), (1, "en", "src1", "Another text! " * 40), (None, "de", "src2", "Ein Text. " * 40), (2, "de", "src2", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["deterministic_score"](spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]
    assert catalogue.QUERIES["ab_winrate"](spark, str(tmp_path)).first()["n_pairs"] == 3
    assert judging.LEAST_PAIRS == 6
