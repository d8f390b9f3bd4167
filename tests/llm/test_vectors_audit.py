"""The exact searches and the filter audit against brute force, with odd inputs."""

import math
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from corpusloom.llm import filter_audit, hard_negatives, norm_buckets, vectors
from corpusloom.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(rows, scale):
    """{(id, label, vector)} of the rows that take part."""
    out = set()
    for i, e, label in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        out.add((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in e)))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, every, k, scale=64):
    known = {(i, v) for i, _, v in whole(rows, scale)}
    out = set()
    for q, v in known:
        if q % every == 0:
            best = sorted((-dot(v, w), i) for i, w in known if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def brute_hard(rows, every, scale=256):
    known = {r for r in whole(rows, scale) if r[1] is not None}
    out = set()
    for a, label, v in known:
        if a % every:
            continue
        same = sorted((-dot(v, w), i) for i, m, w in known if m == label and i != a)[:5]
        other = sorted((-dot(v, w), i) for i, m, w in known if m != label)
        for s, p in same:
            hit = [(n, i) for n, i in other if 80 * -s <= 100 * -n <= 100 * -s][:5]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(hit)}
    return out


def table(seed, n=260, dim=6):
    """Clusters, a frequent vector, vectors of very different lengths, and everything that takes no part."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            e = [0.5] * dim
        else:
            e = ((centre[i % 5] + 0.3 * rng.normal(size=dim)) * float(rng.choice([0.01, 1, 1, 40]))).tolist()
        rows.append((i, e, int(i % 4)))
    rows += rows[:7]
    rows += [(1000, [0.0] * dim, 1), (1020, None, 1), (1040, [1.0, None] + [0.0] * (dim - 2), 2), (1060, [float("nan")] + [0.0] * (dim - 1), 3), (1080, [float("inf")] * dim, 1), (1100, [1.0], 0), (1120, [1.0] * dim, None), (None, [1.0] * dim, 1)]
    rows += [(1200 + i, [-0.25] * dim, 1) for i in range(4)] + [(1300, [1.0] * dim, 77)]
    return rows


def equal_length(rows):
    return [r for r in rows if r[1] is None or len(r[1]) != 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_brute_force(spark, seed):
    prepare(spark)
    rows = table(seed)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS i", "vec_id AS q", "embedding AS v", "1 AS `group`")
    got = {tuple(r) for r in norm_buckets.top_k(docs, lambda v: v % 20 == 0, 7).collect()}
    assert got == brute_top(equal_length(rows), 20, 7)


def test_top_k_over_many_blocks(spark, monkeypatch):
    prepare(spark)
    for name, value in (("BLOCK_ROWS", 40), ("BLOCK_QUERIES", 5), ("SEED_NUMBERS", 30)):
        monkeypatch.setattr(norm_buckets, name, value)
    rows = table(3)
    got = {tuple(r) for r in norm_buckets.top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 20 == 0).collect()}
    assert got == brute_top(equal_length(rows), 20, 20)


def test_top_k_takes_every_way_and_loses_nothing():
    rng = np.random.default_rng(5)
    v = np.floor(64 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 8))) * np.exp(0.05 * rng.normal(size=(6000, 1)))).astype(np.int64)
    q = v[::30]
    n2, q2 = (v.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    low = np.arange(len(v))[::-1].copy()
    best, taken = norm_buckets.retrieve(v, n2, low, q, q2, np.full(len(q), np.iinfo(np.int64).min), 9, run=400)
    assert all(n > 0 for n in taken.values())
    s = q @ v.T
    for i in range(len(q)):
        order = np.lexsort((low, -s[i]))[:9]
        assert best.row[i].tolist() == order.tolist() and best.score[i].tolist() == s[i, order].tolist()


def test_large_numbers_are_exact(spark):
    prepare(spark)
    big = float(1 << 21)
    rows = [(i, [big + i, big - i, 1.0 + i], 0) for i in range(30)] + [(40, [1e30, 0.0, 0.0], 0), (60, [3e7 * 2, 0.0, 0.0], 0)]
    got = {tuple(r) for r in norm_buckets.top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 20 == 0, 5).collect()}
    assert got == brute_top([r for r in rows if r[0] not in (40, 60)], 20, 5)  # 2**62 is reached


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_brute_force(spark, seed):
    prepare(spark)
    rows = table(seed)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS i", "vec_id AS q", "embedding AS v", "1 AS `group`", "1 AS score")
    got = [tuple(r) for r in hard_negatives.mine(docs, lambda v: v % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hard(equal_length(rows), 10)


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    prepare(spark)
    for name, value in (("BLOCK_ROWS", 30), ("BLOCK_ANCHORS", 4), ("GROUPS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = table(4)
    got = {tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), lambda v: v % 10 == 0).collect()}
    assert got == brute_hard(equal_length(rows), 10)


def test_ball_tree_prunes_by_both_bounds_and_by_label():
    rng = np.random.default_rng(6)
    v = np.floor(256 * (rng.normal(size=(8, 5))[rng.integers(0, 8, 4000)] + 0.05 * rng.normal(size=(4000, 5)))).astype(np.int64)
    label = rng.integers(0, 3, 4000)
    low = rng.permutation(4000)
    q, of = v[::200], label[::200]
    s = q @ v.T
    top = np.sort(s, 1)[:, -40]
    windows = (np.stack([top * 8 // 10, top // 2], 1), np.stack([top, top * 6 // 10], 1))
    best, seen = hard_negatives.search(v, label, low, q, of, windows, False, 4, leaf=20)
    assert seen["left"] > 0 and seen["met"] < seen["nodes"]
    for a in range(len(q)):
        for w in range(2):
            ok = np.flatnonzero((label != of[a]) & (s[a] >= windows[0][a, w]) & (s[a] <= windows[1][a, w]))
            want = ok[np.lexsort((low[ok], -s[a, ok]))][:4]
            assert [r for r in best.row[2 * a + w].tolist() if r >= 0] == want.tolist()


def test_empty_tables_give_no_rows(spark):
    prepare(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert norm_buckets.top_k(none, lambda v: v % 20 == 0).collect() == []
    assert hard_negatives.mine(none, lambda v: v % 10 == 0).collect() == []
    alone = spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)
    assert norm_buckets.top_k(alone, lambda v: v % 20 == 0).collect() == []
    assert hard_negatives.mine(alone, lambda v: v % 10 == 0).collect() == []
    assert norm_buckets.top_k(alone, lambda v: v % 7 == 0).collect() == []
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_a_class_keeps_its_smallest_ids(spark):
    rows = spark.createDataFrame([(i % 50, [1, 2]) for i in range(200)] + [(7, [3, 4])], "vec_id long, v array<int>")
    got = {tuple(r["v"]): r["ids"] for r in vectors.classes(rows, ["v"], 4).collect()}
    assert got == {(1, 2): [0, 1, 2, 3], (3, 4): [7]}


# --- Filter audit ------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        ids[t or ""].append(i)
    rows = []
    for i, t, p in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t),
            i is not None and any(j is not None and j < i for j in ids[t]),
        ), strict=True) if bad)
        rows.append((p or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], defaultdict(int)
        for o in map("".join, permutations("ABCDE")):
            left = mine
            for s, f in enumerate(o):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, o, s + 1] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for o, s in [(o, s) for p, o, s in out if p == part]:
            out[part, o, s].append(total[o[s - 1]])
    return out


def test_filter_audit_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 3)
    clean = " ".join(f"word{i}" for i in range(230))
    texts = [clean, clean + " $", "a " * 300, "SHOUT " * 250, None, "", "x" * 5000 + " é　\x0by", "One two|three", clean.upper(), " \t\r\n"]
    docs = [(i, texts[i % len(texts)], ["s1", "s2", None, "", "s1"][i % 5]) for i in range(45)]
    docs += [(3, texts[3], "s1"), (None, clean, "s2"), (None, clean, None), (-1, "only here", "s3"), (90, "\U0001d400 " * 201, "s3")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 45, 2)] + [(2, 1, None), (2, None, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "text AS k", "doc_id AS part", "1 AS n", "1 AS first", "true AS A")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * 4
    have = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}
    assert have == brute_audit(docs, labels)
