"""Excerpts, replies, judging, upkeep and readers against plain Python."""

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.operators import dedup, excerpts, judging, upkeep
from corpusloom.plans import judging_queries
from corpusloom.sources import readers


def _one(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r[0] for r in rows.orderBy("id").select(column(F.col("text"))).collect()]


def test_json_is_salvaged_by_depth(spark):
    texts = ['x {"a":1} and {b}', '{"a": {"b": "c"}}}', "no", '```json\n[1, {"a": 2}]\n``` {x}', '{"a": {', "", None]
    assert _one(spark, texts, replies.salvaged_json) == ['{"a":1}', '{"a": {"b": "c"}}', "no", '[1, {"a": 2}]', '{"a": {', "", None]


def test_json_is_accepted_as_a_whole(spark):
    good = ['{"a": 1}', " [1, 2]", '{"a": "so…… yes"}', "[]"]
    bad = ['{"a": 1}}', '{"a": 1}] x', "1", '{"a": {...}}', '{"a": "Line[] of JSON..."}', '["a", ...]', '{"a": 1}, {"b": 2}', '{"a": 1}, "b": {}', None, ""]
    assert _one(spark, good + bad, replies.accepted_json) == [True] * len(good) + [False] * len(bad)


def test_card_arrays(spark):
    texts = ['so: [{"a": 1}, {"b": 2}] done', '[{"a": 1}, 3]', '[{"a": 1}]', "none", '[{"a": 1}, {]']
    got = _one(spark, texts, lambda c: replies.cards(c, 2))
    assert [g and [json.loads(x) for x in g] for g in got] == [[{"a": 1}, {"b": 2}], [{"a": 1}], None, None, None]


def test_paragraphs_are_packed(spark):
    r = random.Random(2)
    texts = ["\n".join(r.choice(["# head", "", " ", "w" * r.randrange(1, 300)]) for _ in range(r.randrange(0, 30))) for _ in range(40)]

    def plain(text):
        out, held = [], ""
        for p in (p.strip() for p in text.split("\n") if p.strip() and not p.startswith("#")):
            held += p + "\n"
            if len(held) >= 700:
                out, held = [*out, held.strip()], ""
        return [*out, held.strip()] if len(held) >= 350 else out

    assert _one(spark, texts, excerpts.paragraph_packs) == [plain(t) for t in texts]


def test_scenes_and_what_is_cut_from_them(spark):
    talk = "\n".join(["甲：" + "好" * 300, "[旁白：x]", "△动作：y", "# z：", "no"])
    script = "# t\n### 场 1\n" + talk + "\n### 场 2\n清野茶\n" + "长" * 1000
    assert [s[:7] for s in _one(spark, [script], excerpts.scenes)[0]] == ["### 场 1", "### 场 2"]
    assert _one(spark, [script], excerpts.dialogues) == [["甲：" + "好" * 300]]
    (cut,) = _one(spark, [script], lambda c: excerpts.brand_scenes(c, "清野"))[0]
    assert len(cut) == 900 and cut.startswith("### 场 2")
    assert _one(spark, ["x" * 7000], lambda c: F.length(replies.limited(c, "annotation"))) == [6000]


def test_units_by_the_better_scheme_and_their_spread(spark):
    long = "w" * 250
    text = f"cover\n第1集 a\n{long}\n第2集\nshort\n第一章\n{long}\n第二章\n {long} \n第三章 c\n{long}"
    schemes = [r"^第[0-9]+集.*$", r"^第[一二三]+章.*$"]
    got = _one(spark, [text, "none", None], lambda c: F.transform(excerpts.units(c, schemes), lambda u: F.concat_ws("|", u["title"], F.length(u["body"]))))
    assert got[0] == ["第一章|250", "第二章|250", "第三章 c|250"] and got[1] == [] and not got[2]
    for n in (3, 15, 16, 40):
        want = list(range(n))
        if n > 15:
            want = [*want[:9], *want[n // 2 : n // 2 + 3], *want[-3:]]
        assert spark.range(1).select(excerpts.spread(F.sequence(F.lit(0), F.lit(n - 1)), 15)).first()[0] == want


def test_scores(spark):
    votes = spark.createDataFrame([("x", 1, 0, "B"), ("x", 1, 0, ""), ("x", 1, 1, "A"), ("x", 2, 0, "A"), ("y", 1, 1, None)], "axis string, pair int, direction int, letter string")
    got = {r["axis"]: (r["n_pairs"], r["score"], r["winrate"], r["enough"]) for r in judging.artefact_scores(votes).collect()}
    assert got == {"x": (2, 0.5, 0.5, False), "y": (1, 0.25, 0.0, False)}
    ks = spark.createDataFrame([(1, True, "A"), (1, False, "B"), (1, True, "B"), (1, False, "")], "pair_id int, first_is_a boolean, letter string")
    assert [tuple(r) for r in judging.sample_votes(ks).collect()] == [(1, 4, 0.5, 0.5)]
    pairs = spark.createDataFrame([("corpus_vs_gen", True), ("d", True), ("d", False), ("d", None), (None, True)], "kind string, verified boolean")
    assert tuple(judging.exam_counts(pairs).first()) == (1, 2, 2) and judging.examinable(pairs).count() == 2
    rows = spark.createDataFrame([(1, 0.5, 3.0, 0.0), (2, 2.0, 0.0, 40.0), (3, 1.2, 9.0, 5.0)], "id int, a double, b double, slop double")
    band = spark.createDataFrame([("a", 0.4, 0.8), ("b", 1.0, 5.0)], "metric string, p25 double, p75 double")
    z = {1: 0.0, 2: (1.0 + 3 / 4) / 2, 3: (1.0 + 1.0) / 2}
    slop = {1: 0.0, 2: 1.0, 3: 0.25}
    assert {r["id"]: r["score"] for r in judging.penalty_score(rows, band, ["a", "b"], "slop").collect()} == {i: round(max(0.0, 1 - 0.7 * z[i] - 0.3 * slop[i]), 4) for i in z}
    out = spark.createDataFrame([("c", 2.0, 1.0), ("c", 1.0, 1.0), ("c", 0.0, 1.0), ("c", 3.0, 1.0)], "candidate string, ours double, theirs double")
    assert tuple(judging.smoke_groups(out).first()) == ("c", 4, 2, 1, 1, 0.625)
    with pytest.raises(ValueError):
        judging.anchored("corpus", 49)
    with pytest.raises(ValueError):
        judging.anchored("placeholder", 500)
    judging.anchored("corpus", 50)


def test_briefs_by_plain_checksums(spark):
    got = {r["brief_id"]: tuple(r)[1:] for r in judging_queries.brief_draws(spark, "/root/testdata/sf0.001").collect()}
    draw = lambda i, what: zlib.crc32(f"7|{i}|{what}".encode()) % (1 << 31)

    def plain(i):
        u = draw(i, "bucket") / (1 << 31)
        lo, hi = (10, 24) if u < 0.25 else (25, 60) if u < 0.75 else (61, 90)
        g = draw(i, "genre") / (1 << 31) * 4
        return lo + draw(i, "episodes") % (hi - lo + 1), "revenge" if g < 2 else "healing" if g < 3 else "mystery", ["tea house", "office", "harbour"][draw(i, "anchor") % 3], 1 + draw(i, "mentions") % 3

    assert got == {i: plain(i) for i in got} and len({x[0] for x in got.values()}) > 30


def test_upkeep(spark, tmp_path):
    fresh = spark.createDataFrame([("a", "n1", 5), ("b", "n2", 6)], "name string, script_id string, chars int")
    old = spark.createDataFrame([("a", "o1", "love")], "name string, script_id string, claimed_genre string")
    assert {tuple(r) for r in upkeep.restat(fresh, old).collect()} == {("a", "o1", 5, "love"), ("b", "n2", 6, None)}
    for run, meta, text in (("r1", '{"ir_path": "out.txt"}', "one"), ("r2", "{broken", "two"), ("r3", '{"ir_path": ""}', "x"), ("r4", '{"ir_path": "out.txt"}', "  "), ("r5", '{"ir_path": "out.txt"}', "five"), ("r6", '{"ir_path": "out.txt"}', "six")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "meta.json").write_text(meta)
        (tmp_path / run / "out.txt").write_text(text)
    assert [r["text"] for r in upkeep.artefacts(spark, str(tmp_path), 2).collect()] == ["one", "five"]
    mined = spark.createDataFrame([(" b ", 0), ("a", 1), ("  ", 2), ("c", 3), ("b", 4)], "phrase string, rank int")
    assert [r["phrase"] for r in upkeep.merged_lexicon(["z", "a"], mined).orderBy("place").collect()] == ["z", "a", "b", "c"]
    paths = spark.createDataFrame([("sealed/x",), ("sealed/.gitkeep",), ("src/sealed/x",)], "path string")
    assert [r[0] for r in upkeep.forbidden_paths(paths, ["sealed/", "data/"]).collect()] == ["sealed/x"]
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "round int, ts string")
    readers.append_ledger(rows, str(tmp_path / "ledger"))
    readers.append_ledger(rows.limit(0), str(tmp_path / "ledger"))
    assert [r["round"] for r in upkeep.ledger(spark, str(tmp_path / "ledger")).collect()] == [1, 2]


def _docx(xml, cut=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    data = bytearray(out.getvalue())
    if cut:
        data[60:80] = b"\xff" * 20
    return bytes(data)


def test_readers_give_nothing_for_nothing_found():
    body = "<w:p><w:r><w:t>a</w:t><w:t xml:space='preserve'> b</w:t></w:r></w:p><w:p></w:p><w:p><w:t>c</w:t></w:p>"
    assert readers.docx_text(_docx(body)) == "a b\nc" and readers.docx_text(_docx("<w:p></w:p>")) is None
    assert readers.docx_text(_docx("x" * 500 + body, cut=1)) is None and readers.docx_text(b"no zip") is None
    wide = "\x01" + "这是一个足够长的句子,真的。" + "\x02ab"
    assert readers.doc_text(wide.encode("utf-16-le")) == "这是一个足够长的句子,真的。" and readers.doc_text(b"\x00" * 500) is None
    assert readers.decoded_wide("中文".encode("gb18030")) == "中文" and readers.decoded_best("中文".encode()) == "中文"
    assert "a" in readers.docx_flat(_docx("<w:p><w:t>a &amp; b</w:t></w:p>"))


def test_small_sinks_refuse_large_frames(spark):
    assert readers.markdown(spark.range(2)).splitlines()[2:] == ["| 0 |", "| 1 |"] and "- {id: 1}" in readers.yaml_text(spark.range(2), "x")
    for sink in (lambda: readers.markdown(spark.range(3), 2), lambda: readers.yaml_text(spark.range(3), "x", 2)):
        with pytest.raises(ValueError):
            sink()


def test_window_hits_are_the_same_with_a_small_and_a_large_index(spark, monkeypatch):
    r = random.Random(1)
    base = "".join(r.choice("abcdef") for _ in range(200))
    docs = spark.createDataFrame([(1, "x" + base[:90]), (1, base[20:130] + "y"), (2, "none"), (3, None), (4, base)], "doc_id long, text string")
    index = dedup.window_index(spark.createDataFrame([(base,)], "text string"))
    small = sorted(map(tuple, dedup.window_hits(docs, index).collect()))
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, dedup.window_hits(docs, index).collect())) == small and len(small) == 3
