"""Fingerprints, lexicon, degradation, pairs, exams, readers and intake."""

import hashlib
import random
import zipfile

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import LATIN, ZH_DRAMA
from corpusloom.operators import dedup, degrade, exam, lexicon, pairs
from corpusloom.plans import catalogue, corpus_queries  # noqa: F401 - adds to the first
from corpusloom.sources import readers
from corpusloom.streaming import ingest

DRAMA = "第1集\n场景:家\n阿明:你好呀!\n他三天后在北京城。\n【钩子】门开了,有人来\n小红:咱走吧啊。\n\n场景:街\n他今年20岁。买3盒。\n【回收】钥匙\n第2集\n场景:山\n阿明:为啥?\n【悬念】灯灭了"


def _greedy(prints):
    kept, out = [], {}
    for i, h in sorted(prints):
        near = next((k for k, g in kept if bin(int(h, 16) ^ int(g, 16)).count("1") <= 3), None)
        out[i] = near
        if near is None:
            kept.append((i, h))
    return out


def test_keep_first_is_the_sequential_scan(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            h ^= 1 << rng.randrange(64)
        prints.append((i, f"{h:016x}"))
    df = spark.createDataFrame(prints, "id long, simhash string")
    assert {r["id"]: r["duplicate_of"] for r in dedup.keep_first(df).collect()} == _greedy(prints)
    old, new = df.where("id < 60"), df.where("id >= 60")
    kept = spark.createDataFrame([p for p in prints if p[0] < 60 and _greedy(prints)[p[0]] is None], "id long, simhash string")
    assert old.count() == 60
    assert {r["id"]: r["duplicate_of"] for r in dedup.without_known(new, kept).collect()} == {i: v for i, v in _greedy(prints).items() if i >= 60}


def test_window_hits_both_ways(spark, monkeypatch):
    item = "".join(chr(97 + i * 7 % 26) for i in range(120))
    docs = spark.createDataFrame([(1, "zz " + item + " zz"), (2, "short"), (3, None), (4, "y" * 80)], "doc_id long, text string")
    index = dedup.window_index(spark.createDataFrame([(1, item), (2, "tiny")], "item_id long, text string"))
    small = sorted(map(tuple, dedup.window_hits(docs, index).collect()))
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    assert small == sorted(map(tuple, dedup.window_hits(docs, index).collect())) and [r[0] for r in small] == [1]


def test_every_operator_is_deterministic_and_leaves_most(spark):
    for op in degrade.DETERMINISTIC:
        for s in (0.0, 0.5, 1.0):
            a, b = (degrade.REGISTRY[op].fn(DRAMA, s, 7) for _ in range(2))
            assert a == b
            if op != "D14_setup_cut":
                assert degrade.solid(a) >= 0.7 * degrade.solid(DRAMA)
    assert len(degrade.REGISTRY) == 17 and len(degrade.DETERMINISTIC) == 12


def test_planted_defects_are_verified(spark):
    docs = spark.createDataFrame([(1, DRAMA), (2, None), (3, "")], "doc_id long, text string")
    rows = degrade.degraded(docs, severities=(1.0,))
    got = {r["op_id"]: r["ok"] for r in rows.select("op_id", degrade.verified(F.col("op_id"), F.col("original"), F.col("degraded")).alias("ok")).collect()}
    assert {"D05_inject_slop", "D08_inject_contradiction", "D12_info_stuffing", "D14_setup_cut", "D15_producibility_break", "D16_formalize_tone", "D17_decolloquialize", "D02_remove_hook"} <= {k for k, v in got.items() if v}
    assert set(got) == set(degrade.DETERMINISTIC)


def test_contradiction_stands_behind_its_fact():
    lines = degrade.REGISTRY["D08_inject_contradiction"].fn("甲\n他20岁\n乙", 1.0, 1).split("\n")
    assert lines == ["甲", "他20岁", "(他今年40岁。)", "乙"]
    assert degrade.REGISTRY["D08_inject_contradiction"].fn("甲\n乙", 1.0, 1) == "甲\n乙"


def test_excerpt(spark):
    long = "这是一个足够长的叙述句子" * 5
    rows = spark.createDataFrame([(1, "剧名:某\n类型:古装\n" + DRAMA + "\n" + long), (2, "短"), (3, f"{long}\n{long}"), (4, None)], "id long, text string")
    got = {r["id"]: r["e"] for r in rows.select("id", pairs.excerpt(F.col("text")).alias("e")).collect()}
    assert got[1].startswith("场景:家") and "剧名" not in got[1] and "【钩子】" not in got[1]
    assert got[2] is None and got[3].count("\n") == 1 and got[4] is None


def test_pairs_and_violations(spark):
    docs = spark.createDataFrame([(1, DRAMA), (2, DRAMA + "\n完")], "doc_id long, text string")
    made = pairs.from_degraded(degrade.degraded(docs, severities=(0.5, 1.0)), "corpus_degraded").cache()
    assert pairs.violations(made).count() == 0 and pairs.leaks(made).count() == 0
    assert made.count() == made.select("pair_id").distinct().count()
    assert {r["violation"] for r in pairs.violations(made.withColumn("axis", F.lit("x")).withColumn("b_text", F.col("a_text"))).collect()} == {"axis", "same_text"}


def test_exam_of_a_perfect_and_a_biased_judge(spark):
    def run(letter):
        rows = [("ax", i, "D08_inject_contradiction", d, letter(d)) for i in range(100) for d in (0, 1)]
        return exam.axis_metrics(spark.createDataFrame(rows, "axis string, pair_id long, op_id string, direction int, letter string")).first()

    good, biased = run(lambda d: "AB"[d]), run(lambda d: "A")
    assert good["pass"] and good["sensitivity"] == 1.0 and good["position_bias"] == 0.0
    assert not biased["pass"] and biased["position_bias"] == 1.0 and biased["pair_flip_rate"] == 1.0


def test_bootstrap_is_that_of_pythons_random(spark):
    x = [1.0] * 7 + [0.0] * 3
    got = exam.bootstrap(spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "g string, i int, score double"), "g", "i", resamples=500).first()
    chance = random.Random(7)
    means = sorted(sum(chance.choice(x) for _ in x) / 10 for _ in range(500))
    assert (got["ci_lo"], got["ci_hi"]) == (means[12], means[486])


def test_bootstrap_query_resamples_every_outcome(spark, tmp_path):
    """Ids from 300 on, most beyond 400; 10,000 resamples by Python's own choice."""
    spark.range(300, 560).selectExpr("id AS doc_id", "if(id % 2 = 0, 'en', 'de') AS lang", "'x' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    h = lambda d, s, m: int(hashlib.md5(f"{d}{s}".encode()).hexdigest()[:6], 16) % m
    want = {}
    for lang, first in (("en", 300), ("de", 301)):
        pairs_ = [(h(d, "x", 10), h(d, "y", 11)) for d in range(first, 560, 2) if d % 50]
        x = [0.5 if a == b else float(b > a) for a, b in pairs_]
        chance = random.Random(7)
        means = sorted(sum(chance.choice(x) for _ in x) / len(x) for _ in range(10_000))
        want[lang] = (means[250], means[9749])
    assert {r["lang"]: (r["ci_lo"], r["ci_hi"]) for r in catalogue.bootstrap_ci(spark, str(tmp_path)).collect()} == want


def test_every_stratum_and_genre_is_kept(spark):
    rows = spark.range(100_200).select("id", F.col("id").alias("host"))
    assert exam.stratified(rows, ["host"], "id", 10).count() == 100_200
    cards = spark.range(10_050).select(F.col("id").alias("genre"), F.lit(1.0).alias("r"))
    assert exam.attainment(cards, cards, {"r": F.col("r")}, {"r": 1.0}).count() == 10_050


def test_lexicon_keeps_seeds_and_finds_phrases(spark):
    texts = [("our", "齿轮转动 命运低语 " * 9)] * 3 + [("drama", "门口等待 天台对峙 " * 9)] * 4 + [("novel", "山河远阔 " * 9)] * 3
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, g string, text string")
    got = {r["phrase"]: r for r in lexicon.mine(lexicon.frequencies(docs, ZH_DRAMA, F.col("g")), ZH_DRAMA).collect()}
    assert got["命运低语"]["source"] == "our_vs_drama" and got["天台对峙"]["source"] == "drama_vs_novel"
    assert sum(r["source"] == "seed" for r in got.values()) == 12 and all(r["pmi"] is None for r in got.values() if r["source"] == "seed")


def test_readers(spark, tmp_path):
    body = "<w:document><w:p><w:r><w:t>甲</w:t></w:r><w:r><w:t>乙</w:t></w:r></w:p><w:p></w:p><w:p ><w:t>丙</w:t></w:p></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.txt").write_bytes("汉字文本".encode("gbk"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.doc").write_bytes(b"\x00\x01" * 20 + "这是一段足够长的正文内容啊".encode("utf-16-le") + b"\x01\x00" * 20)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == "甲乙\n丙" and got["b.txt"] == "汉字文本" and got["c.docx"] is None and got["d.bin"] is None
    assert "足够长的正文" in got["e.doc"]
    m = readers.manifest(spark, str(tmp_path)).cache()
    (tmp_path / "b.txt").write_bytes(b"changed")
    (tmp_path / "f.txt").write_bytes(b"new")
    assert m.count() == 5


def test_manifest_counts_crlf_as_lf(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\r\ny")
    (tmp_path / "b").write_bytes(b"x\ny")
    a, b = (r["sha256"] for r in readers.manifest(spark, str(tmp_path)).collect())
    assert a == b
    diff = dedup.manifest_difference(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string"), spark.createDataFrame([("a", "3"), ("c", "2")], "path string, sha256 string"))
    assert {tuple(r) for r in diff.collect()} == {("a", "changed"), ("b", "removed"), ("c", "added")}


def test_stream_takes_each_document_once(spark, tmp_path):
    words = [" ".join(f"w{i}{chr(97 + (i * k) % 26)}ord" for i in range(80)) for k in (3, 5)]
    store, inbox = str(tmp_path / "store"), str(tmp_path / "in")
    for batch in ([(1, words[0]), (2, words[0])], [(3, words[1]), (4, words[0]), (5, "x")]):
        spark.createDataFrame(batch, "doc_id long, text string").write.mode("append").parquet(inbox)
        ingest.stream_in(spark, inbox, store, str(tmp_path / "cp"), LATIN).awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(store).collect()} == {1, 3}


def test_keys_of_fingerprints_are_not_sent_through_the_driver(spark):
    """A small file of fingerprints has 35 times as many keys; Spark would broadcast them by the size of the file."""
    from pyspark.sql import functions as F

    from corpusloom.operators import dedup, nearindex
    from corpusloom.sources.tables import written

    prints = written(spark.range(2000).select("id", F.lower(F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("simhash")), "prints")
    stored = written(nearindex.keyed(prints).withColumn("seq", F.lit(0).cast("long")), "stored")
    for found in (dedup.near_pairs(prints), nearindex.near_stored(prints, nearindex.keyed(prints)), nearindex.near_stored(prints, stored)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_a_document_dropped_before_all_its_neighbours_are_settled_names_the_first_kept(spark):
    """3 is near 1 (kept) and near 2, which is still open in the round that drops 3, the last round."""
    rows = [(1, "0000000000000000"), (2, "0000000000000007"), (3, "0000000000000003")]
    got = dedup.keep_first(spark.createDataFrame(rows, "id long, simhash string")).collect()
    assert sorted((r["id"], r["duplicate_of"]) for r in got) == [(1, None), (2, 1), (3, 1)]


def test_a_run_is_the_number_of_edges_below(spark):
    """Found by eight comparisons and not by one with each of 255 edges, which took most of the time of bands."""
    from bisect import bisect_left

    from corpusloom.operators import cards

    rng = random.Random(5)
    edges = sorted(rng.choice([rng.random(), rng.randrange(9) / 8]) for _ in range(cards.RUNS - 1))
    values = [*edges[::7], -1.0, 2.0, *(rng.random() for _ in range(50))]
    rows = spark.createDataFrame([(v, e) for e in (edges, [0.5] * (cards.RUNS - 1), edges[:3]) for v in values], "v double, e array<double>")
    got = rows.withColumn("run", cards.run_of(F.col("v"), F.col("e"))).collect()
    assert [r["run"] for r in got] == [bisect_left(r["e"], r["v"]) for r in got]


def test_pairs_invalid_is_its_sql_on_odd_texts(spark, tmp_path):
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).upper() != chr(c) or chr(c) in T.UNCASED or chr(c).lower() != chr(c))]
    texts = [None, "", " \n\t", "A!!", "a!!", "ŉ!!", "ﬁ x", "STRAßE", *letters]
    rows = [(i, t, ("es", "en", None)[i % 3], ("src3", "src1", None)[i % 4 % 3]) for i, t in enumerate(texts)] + [(None, "B", "en", "src1"), (-7, None, "en", "src1"), (-3, None, "es", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["pairs_invalid"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.SQL["pairs_invalid"]).fetchall()) and [r[0] for r in got] == ["axis", "label", "same_text"]
    assert {r["violation"] for r in pairs.violations(spark.createDataFrame([("p", None)], "pair_id string, a_text string").selectExpr("pair_id", "'l0_fact' axis", "a_text", "'x' b_text", "'a_win' label", "named_struct('kind', 'corpus_vs_gen', 'op_id', '') construction", "'val' split")).collect()} == {"empty_text", "same_text", "pair_id"}


def _sums(text):
    z = "".join(text.split())
    hashes = [int.from_bytes(hashlib.md5(z[i : i + 3].encode()).digest()[:8], "big") for i in range(max(len(z) - 2, 1))]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_fingerprints_have_all_grams_of_a_text(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "ab", "a b c", *("".join(rng.choices("abcdeé中𝒳 \n", k=k)) for k in (50, 3000, 20_000, 40_000))]
    assert [dedup.simhash_hex(t) for t in texts] == list(map(_sums, texts))
    monkeypatch.setattr(dedup, "AT_ONCE", 1000)
    assert [dedup.simhash_hex(t) for t in texts] == list(map(_sums, texts))


def _skipped_by_fours(spark, path):
    """Documents of which 2 and 3 differ in every fourth letter of 40,000; 5 and 6 have the fingerprint of 4, 7 and 8 that of nothing."""
    rng = random.Random(6)
    long = rng.choices("abcdefgh", k=40_000)
    other = [rng.choice("stuvwxyz") if i % 4 == 3 else c for i, c in enumerate(long)]
    short = "".join(rng.choices("abcdefgh", k=400))
    rows = [(2, "".join(long)), (3, "".join(other)), (4, short), (5, short), (6, short[:200] + " " + short[200:]), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def _both(spark, con, path, name):
    got = catalogue.QUERIES[name](spark, str(path)).select(*(c[0] for c in con.execute(catalogue.SQL[name]).description))
    return sorted(map(tuple, got.collect())), sorted(con.execute(catalogue.SQL[name]).fetchall())


def test_dedup_keep_looks_at_whole_texts(spark, tmp_path):
    got, want = _both(spark, _skipped_by_fours(spark, tmp_path), tmp_path, "dedup_keep")
    assert got == want == [(2, None), (3, None), (4, None), (5, 4), (6, 4), (7, None), (8, 7)]


def test_dedup_two_batches_looks_at_whole_texts(spark, tmp_path):
    got, want = _both(spark, _skipped_by_fours(spark, tmp_path), tmp_path, "dedup_two_batches")
    assert got == want == [(2, 0, None), (3, 1, None), (4, 0, None), (5, 1, 4), (6, 0, 4), (7, 1, 8), (8, 0, None)]


def test_near_dup_pairs_has_every_document_of_a_fingerprint(spark, tmp_path):
    got, want = _both(spark, _skipped_by_fours(spark, tmp_path), tmp_path, "near_dup_pairs")
    assert got == want == [(4, 5, 0), (4, 6, 0), (7, 8, 0)]
