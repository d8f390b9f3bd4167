"""The dealt operators: edge cases and brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, chat_format, decontamination, gru_lm, language_id, minhash, packing, q01_url, sharding, suffix_dedup, url_filter
from corpusloom.llm.common import prepare
from corpusloom.llm.q07_packing import tokenizer_path

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "dun", "vos") for b in ("ra", "ne", "stil", "po", "gru", "z")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, very long, ties, near copies, repeated rows, clashing extra columns."""
    prepare(spark)
    a, b = prose(200, 1), prose(200, 2)
    near = " ".join("x" if i == 100 else w for i, w in enumerate(a.split()))
    rows = [(1, a), (2, near), (3, b), (4, a.upper() + "!"), (5, None), (6, ""), (7, "!!! ..."), (8, prose(20_000, 3)), (9, b), (9, b), (None, prose(60, 4)), (10, "kara"), (11, "kara"), (12, prose(80, 5) + " " + a)]
    return spark.createDataFrame([(i, t, "en", 7, 1.5, "q") for i, t in rows], "doc_id long, text string, lang string, shard int, score double, key string")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# --- 1 ---------------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTPS://M.Example.ORG/es/a", "https://a.com/fr/x", "http://com/de/", "http://x.org", "http://x.org?a=1", "http://example.org/en/12", "http://a.net/p?utm_source=feed", "http://m.a.net/es/" + "y" * 50_000, "x://h://b/de/q#top"]


def test_url_verdicts_both_ways_and_without_index(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")], "page_id long, url string, host string")
    prepare(spark)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    fast = sorted(map(str, url_filter.judge(pages, q01_url.SITES, q01_url.PATTERNS).select(*cols).collect()))
    join = sorted(map(str, url_filter.judge_by_join(pages, q01_url.SITES, q01_url.PATTERNS).select(*cols).collect()))
    assert fast == join and len(fast) == len(URLS) + 1
    got = {r["page_id"]: r for r in url_filter.judge(pages, q01_url.SITES, q01_url.PATTERNS).collect()}
    assert got[4]["rule"] == "example.org/es/" and got[4]["verdict"] == "block" and got[4]["host"] == "m.example.org"
    assert got[5]["rule"] == "com/fr/" and got[6]["rule"] == "com/de/" and got[7]["rule"] is None and got[9]["rule"] == "example.org/en/1"
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "block" and (got[1]["host"], got[1]["path"]) == ("", "")


def test_url_index_finds_what_all_rules_find():
    index = url_filter.RuleIndex([], q01_url.PATTERNS)
    for u in filter(None, URLS):
        all_ = [p for p in q01_url.PATTERNS if __import__("re").search(p.regex, url_filter.lowered(u))]
        want = min(all_, key=lambda p: (not p.allows, p.text), default=None)
        assert index.pattern(u) == want


def test_thousands_of_url_rules_by_index_by_join_and_one_by_one(spark):
    prepare(spark)
    r = random.Random(12)
    word = lambda: r.choice(["ads", "track", "cdn", "img", "news", "shop", "É"]) + str(r.randrange(60))
    forms = [lambda: f"||{word()}.example^", lambda: f"/{word()}/*{word()}|", lambda: f"@@||{word()}.example/{word()}^", lambda: f"*{word()}*", lambda: f"?{word()}="]
    rules = [url_filter.PatternRule(r.choice(forms)()) for _ in range(1500)] + [url_filter.PatternRule("||É9.example^")]
    urls = [f"https://{word()}.{word()}.example/{word()}/{word()}?{word()}=1" for _ in range(60)] + ["http://É9.example/", "http://x/" + "y" * 20_000, None, None]
    index = url_filter.RuleIndex([], rules)
    plain = [(__import__("re").compile(p.regex, __import__("re").DOTALL), p) for p in dict.fromkeys(rules)]
    want = {}
    for u in urls:
        low = url_filter.lowered(u or "")
        hit = min((p for x, p in plain if u and x.search(low)), key=lambda p: (not p.allows, p.text), default=None)
        want[u] = hit and hit.text
        assert u is None or index.pattern(u) == hit
    assert sum(v is not None for v in want.values()) > 20 and want["http://É9.example/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for way in (url_filter.judge, url_filter.judge_by_join):
        assert {r["url"]: r["pattern"] for r in way(pages, [], rules).collect()} == want
        assert way(pages, [], rules).count() == len(urls) and way(pages.where("false"), [], rules).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_decontamination_is_exact_containment(spark, docs):
    a = prose(200, 1).split()
    items = [(1, " ".join(a[10:40])), (2, " ".join(a[10:40]).upper()), (3, " ".join(a[50:70] + ["new"] * 10)), (4, None), (5, ""), (6, "kara"), (7, prose(30, 99)), (8, " ".join(a[100:130]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")

    def cut(t, k):
        w = [x for x in __import__("re").split(r"[^\w]+", (t or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, min(len(w), 5)

    want = set()
    for r in docs.collect():
        for i, t in items:
            k = cut(t, 5)[1]
            if k:
                s = cut(t, k)[0]
                if len(s & cut(r["text"], k)[0]) >= 0.8 * len(s):
                    want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench).collect()}
    assert got == want
    assert decontamination.find(docs, empty(spark, bench.schema)).count() == 0
    assert decontamination.find(empty(spark, docs.schema), bench).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_ann_against_brute_force(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    x = [rng.normal(size=8).tolist() for _ in range(400)]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[3]) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, x[1]), (0, x[0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.search(df, lambda v: v % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = dict((i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(c is not None and c == c for c in v) and any(v))
    hits = []
    for q in [i for i in good if i % 20 == 0]:
        near = sorted(((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q))[:5]
        assert len(got[q]) == 5
        hits.append(len({i for _, i in near} & {i for i, _ in got[q]}) / 5)
    assert np.mean(hits) >= 0.9 and set(got) == {i for i in good if i % 20 == 0}
    # Equal vectors: the smaller ids come first and the query isn't its own neighbour.
    assert [i for i, _ in got[1000]][:4] == [3, 1001, 1002, 1003] or got[1000][0][1] >= got[1000][-1][1]
    assert ann.search(empty(spark, df.schema), lambda v: v % 20 == 0).count() == 0


def test_ann_recall_where_pruning_is_at_work(spark):
    """20,000 vectors in clusters, 312 lists of which few are read, against brute force."""
    prepare(spark)
    r = np.random.default_rng(6)
    x = r.normal(size=(500, 24))[r.integers(0, 500, 20_000)] * 2 + r.normal(size=(20_000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in ann.search(df, lambda v: v % 50 == 0).collect():
        got[row["query_id"]].add(row["vec_id"])
    s = x[::50] @ x.T
    s[np.arange(400), np.arange(0, 20_000, 50)] = -np.inf
    near = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[50 * q] & set(n.tolist())) / 20 for q, n in enumerate(near)]) >= 0.93 and len(got) == 400


def test_ann_calibration_reads_as_many_lists_as_neighbours_need():
    r = np.random.default_rng(4)
    x, q = ann.lifted(r.normal(size=(4000, 8)), 6.0), ann.asked(r.normal(size=(40, 8)))
    graph = ann.CentroidGraph(ann.balanced_centroids(x, 100))
    near = np.argsort(-(q @ x.T), axis=1)[:, :10]
    of = np.repeat(np.arange(40), 10)
    for cover in (0.8, 0.97, 1.0):
        most, ratio = graph.calibrated(q, x[near.ravel()], of, cover)
        lists, held = graph.probes(q, most, ratio), graph.copies(x[near.ravel()])
        assert np.mean([bool(set(lists[i].tolist()) & set(h.tolist())) for i, h in zip(of, held, strict=True)]) >= cover
        assert all(len(i) <= most for i in lists)
    least, _ = graph.calibrated(q, x[near.ravel()], of, 0.5)
    assert least < most <= 100


def test_block_keeps_ties():
    q, v = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[3.0, 0], [2, 1], [2, 5], [2, 5], [1, 9]])
    i, j, s = ann.best_of_block(q, v, 2)
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == {(0, 0, 3.0), (0, 1, 2.0), (0, 2, 2.0), (0, 3, 2.0), (1, 4, 9.0), (1, 2, 5.0), (1, 3, 5.0)}


# --- 4 ---------------------------------------------------------------------------------------------------------------


def _render(turns):
    return "".join(f"<|{r}|>\n{t.replace('<|', '<​|')}<|end|>\n" for r, t in turns)


def test_preferences(spark):
    p = [("user", "hi"), ("assistant", "a"), ("user", "more")]
    cases = [(1, p + [("assistant", "good")], p + [("assistant", "bad"), ("user", "eh")]), (2, p, p), (3, p[:1], p), (4, [("assistant", "x <|end|>")], [("assistant", "y")]), (5, p + [("assistant", "z")], None)]
    df = spark.createDataFrame([(i, a, b, "z") for i, a, b in cases], "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r["id"]: r for r in chat_format.format_preferences(df).collect()}
    for i, a, b in cases:
        n = got[i]["n_prompt"]
        if b is not None:
            want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)) - 1)
            assert n == want
        assert got[i]["prompt"] == _render(a[:n])
        for name, side in (("chosen", a), ("rejected", b)):
            if side is None:
                assert got[i][f"{name}_completion"] is None
                continue
            assert got[i][f"{name}_completion"] == _render(side[n:])
            whole = got[i]["prompt"] + got[i][f"{name}_completion"]
            learnt = [whole[m["start"] : m["end"]] for m in got[i][f"{name}_mask"]]
            assert learnt == [t.replace("<|", "<​|") + "<|end|>\n" for r, t in side[n:] if r == "assistant"]


def test_pairing_uses_each_conversation_once(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t == 0 and c < 30 else f"{c}-{t}") for c in range(40) for t in range(4)]
    rows += [(None, 0, "user", "alone"), (50, 0, None, None), (50, 0, None, None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chosen int")
    got = chat_format.pair_up(turns, salts=4).collect()
    whole = {r["conv_id"]: r["turns"] for r in chat_format.conversations(turns).collect()}
    real = [r for r in got if r["rejected"] is not None and r["rejected"] == whole[r["rejected_id"]]]
    used = [r["chosen_id"] for r in got] + [r["rejected_id"] for r in real]
    assert Counter(used) == Counter([*range(40), None, 50]) and len(real) == 15
    for r in got:
        assert r["chosen"] == whole[r["chosen_id"]]
        if r["rejected"] is not None and r not in real:  # the neighbour's answer in place of the last one
            assert r["rejected"][:-1] == r["chosen"][:3] and r["rejected"][-1]["role"] == "assistant" and r["rejected"][-1] != r["chosen"][3]
    assert sum(r["rejected"] is None for r in got) <= 4
    assert chat_format.format_preferences(chat_format.pair_up(turns)).where("rejected_completion IS NOT NULL").where("n_prompt = 0").count() == 0
    assert chat_format.pair_up(empty(spark, turns.schema)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_lm_scores(spark, docs):
    docs = docs.withColumn("train", F.expr("doc_id < 9 OR doc_id IS NULL"))
    training = docs.where("train")
    counts, model = gru_lm.gather(training.select("text"))
    encoded = gru_lm.encode(docs.select("doc_id", "text", "score", "train"), model)
    gru_lm.fit(encoded.where("train"), model)
    got = gru_lm.score(encoded, counts, model).collect()
    toks = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for r in training.collect() for w in toks(r["text"]))
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], len(toks(r["text"])), sum(c[w] > 0 for w in toks(r["text"])), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(r["text"])), 6)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    none = docs.where("false").select("text")
    counts, model = gru_lm.gather(none)
    encoded = gru_lm.encode(docs.select("doc_id", "text"), model)
    gru_lm.fit(encoded.where("false"), model)
    assert gru_lm.score(encoded, counts, model).where("train_tokens = 0").count() == docs.count()
    assert gru_lm.score(gru_lm.encode(docs.where("false"), model), counts, model).count() == 0


def test_lm_gain_does_not_depend_on_partitions_and_every_document_is_trained_on(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    gains, real = [], gru_lm.Model.train
    for parts, quantum in ((1, 1 << 20), (40, 1 << 20), (40, 1 << 13)):
        counts, model = gru_lm.gather(docs.select("text"))
        encoded = gru_lm.encode(docs.repartition(parts), model)
        gru_lm.fit(encoded, model, quantum)
        r = gru_lm.score(encoded, counts, model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        gains.append((r["s"] - r["b"]) / r["n"])
    assert min(gains[:2]) > 0.1 and abs(gains[1] / gains[0] - 1) < 0.2 and gains[2] > 0.02, gains  # many trainers of few tokens each learn less
    # A pass learns from each token once, whatever the lengths and lanes.
    r = np.random.default_rng(3)
    flat = [np.append(r.integers(0, model.words, k), model.end).astype("<u2") for k in (0, 3, 2000, 511, 512, 40, 0)]
    squares = {k: np.full_like(v, 0.1) for k, v in model.p.items()}
    assert [real(model, iter(flat), squares, lanes) for lanes in (1, 3, 16)] == [sum(map(len, flat))] * 3
    assert [x.tolist() for x in (ids[warm:] for _, ids, warm in gru_lm.segments(iter(flat)))] == [f[a : a + gru_lm.SEGMENT].tolist() for f in flat for a in range(0, len(f), gru_lm.SEGMENT)]


def test_lm_tokens_of_long_texts_are_cut_piece_by_piece(monkeypatch):
    from corpusloom.llm import textbytes

    text = " ".join(["ab", "c" * 50, "déf\t", "x"] * 60) + "  "
    whole = [x.tolist() for _, b, w, t in gru_lm.tokens(pa.array([text, None, "a b"])) for x in (b, w, t)]
    real = textbytes.pieces
    for most in (1, 7, 64):
        monkeypatch.setattr(gru_lm, "pieces", lambda x, apart, most=most: real(x, apart, most))
        assert [x.tolist() for _, b, w, t in gru_lm.tokens(pa.array([text, None, "a b"])) for x in (b, w, t)] == whole
    assert len(whole[1]) == len(text.split()) + 1 + 1 + 3


def test_lm_is_normalised_and_its_gradient_is_right():
    known = [(int(gru_lm.END), 0, 30), *[(i * 7919, i % 3, 40 - i) for i in range(1, 30)]]
    m = gru_lm.Model(known, 900, 40, {t: (5, 3) for t in range(gru_lm.TAILS)})
    s = np.random.default_rng(0).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    ids = np.arange(m.words + gru_lm.TAILS)
    logp, _ = m.output(np.repeat(s, len(ids), 0), ids)
    assert abs(np.exp(logp).sum() - 1) < 1e-4
    grad = {k: np.zeros_like(v) for k, v in m.p.items()}
    y = np.array([3])
    _, ds = m.output(s, y, grad)
    for k in range(3):
        e = np.zeros_like(s)
        e[0, k] = 1e-2
        slope = (m.output(s + e, y)[0][0] - m.output(s - e, y)[0][0]) / 2e-2
        assert abs(slope - ds[0, k]) < 1e-2
    others = [i for i in range(5) if i != m.end][:3]
    long = np.append(np.tile(others, 500), m.end)
    one = lambda ids, lanes=4: dict(m.score(iter([(0, ids)]), lanes))[0]
    before = one(long)
    squares = {k: np.full_like(v, 0.1) for k, v in m.p.items()}
    for _ in range(5):
        m.train(iter([long[:800], long[800:]]), squares, 2)  # by SEGMENT, side by side
    assert one(long) > before + 100
    # Side by side or alone, with windows crossed or not, a document's score is the same.
    lengths, r = np.array([5, 90, 1, 33, 1, 64]), np.random.default_rng(1)
    parts = [np.append(r.integers(0, m.words, k - 1), m.end) for k in lengths]
    parts = [np.append(p[:-1][p[:-1] != m.end], m.end) for p in parts]
    for lanes in (1, 3, 16):
        got = dict(m.score(enumerate(parts), lanes))
        assert np.allclose([got[i] for i in range(len(parts))], [one(p, 1) for p in parts], atol=1e-3)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_language(spark):
    prepare(spark)
    alphabet = {"en": "the and of with", "de": "der und die mit", "fr": "le et la avec", "es": "el y los con"}
    rows = [(i, " ".join(random.Random(i).choices(alphabet[s].split(), k=30)), s) for i, s in enumerate(list(alphabet) * 40)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows] + [(900, None, "en", 0.0), (901, "", "en", 0.0), (902, "12 !!", "de", 0.0), (903, "le et la", None, 0.0), (904, "the of " * 30_000, "en", 0.0)], "doc_id long, text string, lang string, score double")
    model = language_id.fit(df.where("doc_id < 100"))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert np.mean([got[i]["lang_pred"] == s for i, _, s in rows[100:]]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "fr", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == 0
    assert set(model.pairs) == {("de", "en"), ("es", "fr")} and model.families == ["germanic", "romance"]
    assert language_id.fit(df.where("false")) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_language_sample_survives_repeated_ids_and_texts(spark):
    """One doc_id for a whole language, or one text in very many rows, doesn't take it out of the sample."""
    prepare(spark)
    rows = [(1, " ".join(random.Random(i).choices("the and of with".split(), k=20)), "en") for i in range(800)] + [(i, " ".join(random.Random(i).choices("der und die mit".split(), k=20)), "de") for i in range(300)]
    rows += [(2, "le et la avec", "fr")] * 3000 + [(3, None, "fr")] * 100
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == {"germanic": ["de", "en"], "romance": ["fr"]}
    ask = spark.createDataFrame([(1, "of the with and the"), (2, "und die mit der"), (3, "avec le la")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(ask, model).collect()} == {1: "en", 2: "de", 3: "fr"}


def test_language_votes_against_all_pairs_one_by_one():
    r = np.random.default_rng(8)
    names, centre = ["da", "de", "en", "nl", "es", "fr", "it", "xx"], r.random((8, 4096)) ** 8
    x = np.sqrt(centre[np.repeat(np.arange(8), 20)] * r.random((160, 4096))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.Model.fit(x, list(np.repeat(names, 20)))
    ask = r.random((60, 4096)).astype(np.float32)
    ask = np.concatenate([x, ask / np.linalg.norm(ask, axis=1, keepdims=True)])
    got, score = model.predict(ask)
    for row, lang, p in zip(ask, got, score, strict=True):
        family = model.families[int(np.argmax(row @ model.family_w + model.family_b))]
        votes, margin = Counter(), Counter()
        for a in model.languages[family]:
            votes[a], margin[a] = 0, 0.0
        for (a, b), (w, bias, _) in model.pairs.items():
            if a in votes:
                d = float(row @ w + bias)
                votes[a if d >= 0 else b] += 1
                margin[a] += d
                margin[b] -= d
        assert lang == min(votes, key=lambda s: (-votes[s], -round(margin[s], 4), s)) and 0 <= p <= 1


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for r in docs.dropDuplicates(["doc_id", "text"]).collect():
        ids = np.array([*one.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [p for p in by[r["doc_id"]] if p["doc_tokens"] == len(ids)]
        assert sum(p["length"] for p in mine) == len(ids) * (2 if r["doc_id"] == 9 else 1)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]]) for p in mine)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack_documents(empty(spark, docs.schema), tokenizer_path()).count() == 0


def test_packing_takes_the_lowest_cost_sequence_with_room():
    """By a plain scan over all sequences; a document is cut only when none has room for it."""
    r = random.Random(5)
    for n, size in [*((r.randrange(1, 40), 64) for _ in range(40)), (1500, 2048)]:
        lengths = [min(int(r.lognormvariate(5, 1)) + 1, size - 1) if size > 64 else r.randrange(1, size) for _ in range(n)]
        total = sum(lengths)
        rooms, left = [size] * (total // size), total % size
        rooms += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        used, load, want, late = [0] * len(rooms), [0.0] * len(rooms), set(), set()
        for d in sorted(range(n), key=lambda d: (-lengths[d], d)):
            fit = [(load[s], s) for s in range(len(rooms)) if rooms[s] - used[s] >= lengths[d]]
            if not fit:
                late.add(d)
                continue
            s = min(fit)[1]
            want.add((d, 0, lengths[d], s, used[s]))
            used[s] += lengths[d]
            load[s] += packing.cost(lengths[d])
        got = packing.pack(lengths, size)
        assert {p for p in got if p[0] not in late} == want
        assert sum(p[2] for p in got) == total


def test_word_tokenizer_is_encode():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path())
    texts = ["Don't it's WE'LL  he'd x y.", "İstanbul Straße ǅ ﬁ é Å, a.b ...,", "<|endoftext|> hi", "a<|endoftext|>b <|ENDOFTEXT|> c", "日本語 テスト１２３ 12.5%", "a​b 👍🏽", "", "\x00a\x1cb\n,c", "ΑΣ ΣΑΣ.", "End.\nNext, one. two.", "ÀÉ, ÿ. µ."]
    tok = packing.WordTokenizer(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in tok(texts)] == [one.encode(t, add_special_tokens=False).ids for t in texts]


# --- 8 ---------------------------------------------------------------------------------------------------------------


def _repeats(texts, n):
    body = [(t or "").encode() for t in texts]
    seen = Counter(b[o : o + n] for b in body for o in range(len(b) - n + 1))
    out = []
    for b in body:
        gone = np.zeros(len(b), bool)
        for o in range(len(b) - n + 1):
            if seen[b[o : o + n]] > 1:
                gone[o : o + n] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [None, 1])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    prepare(spark)
    r = random.Random(5)
    if most:
        monkeypatch.setattr(suffix_dedup, "MOST_STRINGS", most)
    s = [prose(150, 100 + i) for i in range(4)]
    texts = [s[0] + s[1], s[2] + s[1][:401] + "q", "é" * 30 + s[1][3:500] + s[3], s[0], s[0], None, "", "ab" * 900, "xab" * 40 + "ab" * 700, s[1][:399], s[3][:-1], s[3] + "é" + s[3]]
    texts += [prose(30, 200 + i) + s[2][100:700] + prose(r.randrange(5, 30), 300 + i) for i in range(12)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == _repeats(texts, 400)
    assert suffix_dedup.remove_repeats(empty(spark, df.schema)).count() == 0


def test_columnwise_construction_by_itself():
    r = random.Random(1)
    for _ in range(20):
        pool = ["".join(r.choice("ab") for _ in range(60)) for _ in range(3)]
        left = np.array([r.randrange(0, 12) for _ in range(9)])
        texts = [(r.choice(pool)[20 - k : 20] + r.choice(pool)[20 : 20 + r.randrange(15, 30)]).encode() for k in left.tolist()]
        n = np.array([max(0, len(t) - 12 + 1) for t in texts])
        got = suffix_dedup.repeated_windows(texts, left, n, 12)
        seen = Counter((o - k, t[o : o + 12]) for t, k in zip(texts, left.tolist(), strict=True) for o in range(len(t) - 11))
        for t, k, flags in zip(texts, left.tolist(), got, strict=True):
            assert flags.tolist() == [seen[o - k, t[o : o + 12]] > 1 for o in range(len(t) - 11)]


# --- 9 ---------------------------------------------------------------------------------------------------------------


def _brute_jp(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in a if i in b)


def test_strings_of_equal_hashes_are_compared_by_their_bytes():
    rng = np.random.default_rng(5)
    x, y, z = (rng.integers(97, 123, 30).astype(np.uint8).tobytes() for _ in range(3))
    rows = [(1, 7, 19, 0, False, x), (1, 7, 19, 0, True, x), (2, 8, 19, 0, False, y), (2, 8, 19, 0, True, z)]
    got = suffix_dedup._construct(pd.DataFrame(rows, columns=["value", "h", "n", "left", "second", "body"]), 12)
    assert [(r.value, r.h, r.spans.tolist()) for r in got.itertuples()] == [(1, 7, [0, 30])]


def test_probability_jaccard_and_its_estimate():
    a, b = {i: 1 + i % 3 for i in range(60)}, {i: 1 + i % 2 for i in range(12, 70)}
    arrays = lambda d, t: (minhash.mixed(np.array(sorted(d), np.uint64) + np.uint64(1000 * t)), np.array([d[k] for k in sorted(d)]))
    sort = lambda h, w: (h[np.argsort(h)], w[np.argsort(h)])
    exact = minhash.similarity(*sort(*arrays(a, 0)), *sort(*arrays(b, 0)))
    assert abs(exact - _brute_jp(a, b)) < 1e-9
    same = [(minhash.signature(np.repeat(*arrays(a, t))) == minhash.signature(np.repeat(*arrays(b, t)))).mean() for t in range(40)]
    assert abs(np.mean(same) - exact) < 0.03


def test_near_duplicate_classes(spark, docs, monkeypatch):
    base = prose(300, 77).split()
    copies = [(100 + i, " ".join("zz%d" % i if k in (3 * i, 150 + 2 * i) else w for k, w in enumerate(base))) for i in range(30)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = more.collect()
    sets = []
    for r in rows:
        for _, borders, h, _ in minhash.shingles(pa.array([r["text"]], pa.string())):
            sets.append(minhash.weighted(h[borders[0] : borders[1]]))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and minhash.similarity(*sets[i], *sets[j]) >= 0.8 - 1e-12:
                label = [label[j] if x == label[i] else x for x in label]
    want = Counter(frozenset(Counter(rows[i]["doc_id"] for i in range(len(rows)) if label[i] == k).items()) for k in set(label) if len(sets[label.index(k)][0]))
    for block in (None, 8):
        if block:
            monkeypatch.setattr(minhash, "BLOCK", block)
        got = defaultdict(Counter)
        for r in minhash.near_duplicates(more).where("class_id IS NOT NULL").collect():
            got[r["class_id"]][r["doc_id"]] += 1
        assert Counter(frozenset(c.items()) for c in got.values()) == want
    assert minhash.near_duplicates(more).count() == len(rows)
    assert minhash.near_duplicates(empty(spark, docs.schema)).count() == 0


def test_near_copies_that_only_their_original_connects(spark, monkeypatch):
    """Copies are 0.82 like the original and 0.66 like each other: a crowded bucket must compare all its blocks."""
    prepare(spark)
    base, r = prose(300, 78).split(), random.Random(79)
    rows = [(0, " ".join(base))]
    for i in range(1, 201):
        at = set(r.sample(range(8, 290, 6), 6))
        rows.append((i, " ".join(f"y{i}x{k}" if k in at else w for k, w in enumerate(base))))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HUBS", 1)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({x["class_id"] for x in got}) == 1


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 2)
    got = sharding.shard(docs, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, place = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        place[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in place.values())
    assert sharding.shard(empty(spark, docs.schema), 4).count() == 0


def test_one_large_group_leaves_no_shard_empty(spark):
    rows = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.lit("same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    size = {r["shard"]: r["n"] for r in sharding.shard(rows, 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    rest = sorted(size.values())[:-1]
    assert len(size) == 24 and max(size.values()) == 12_000 and rest[-1] - rest[0] < 8 * 17
    same = spark.createDataFrame([(None, "")] * 300 + [(1, "x")], "doc_id long, text string")
    slots = sorted((r["shard"], r["slot"]) for r in sharding.shard(same, 2).collect())
    assert slots == [(slots[0][0], i) for i in range(300)] + [(slots[-1][0], 0)] or slots == [(slots[0][0], 0)] + [(slots[-1][0], i) for i in range(300)]


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        sizes, cap = [r.randrange(0, 60) for _ in range(r.randrange(1, 60))], r.randrange(30, 90)
        where, bins = sharding.best_fit_decreasing(sizes, cap)
        room: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):  # the rule by a plain scan
            fit = [(c, b) for b, c in enumerate(room) if c >= sizes[i] and c > 0]
            if sizes[i] > cap:
                room.append(0)
                continue
            b = min(fit)[1] if fit else len(room)
            if b == len(room):
                room.append(cap)
            room[b] -= sizes[i]
            assert where[i] == b
        assert bins == len(room)
    sizes = [r.randrange(1, 1000) for _ in range(2000)]
    where = sharding.least_capacity(sizes, 24)
    load = np.bincount(where, weights=sizes, minlength=24)
    assert load.max() / load.mean() < 1.01 and load.min() / load.mean() > 0.97
