"""The pipeline against a brute-force version of its stages."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import minhash
from tests.llm.test_ops import prose


def _cut(body: bytes, gone: np.ndarray) -> str:
    """The text without the removed bytes, whole characters only."""
    inner = [(b & 0xC0) == 0x80 for b in body]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
    keep = np.ones(len(body), bool)
    for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while p < q and inner[p]:
            p += 1
        while p < q < len(body) and inner[q]:
            q -= 1
        keep[p:q] = False
    return bytes(np.frombuffer(body, np.uint8)[keep]).decode()


def _brute(rows, items):
    """{doc_id: text} that is left before packing."""
    docs = {d: t for d, t in rows if t and re.search(r"[^\W\d_]", t)}
    sets = {d: [minhash.weighted(h[b[0] : b[1]]) for _, b, h, _ in minhash.shingles(pa.array([t]))][0] for d, t in docs.items()}
    label = {d: d for d in docs}
    for a in docs:
        for b in docs:
            if a < b and minhash.similarity(*sets[a], *sets[b]) >= 0.8 - 1e-12:
                label = {d: label[a] if x == label[b] else x for d, x in label.items()}
    groups = defaultdict(list)
    for d, x in label.items():
        groups[x].append(d)
    docs = {min(g): docs[min(g)] for g in groups.values()}
    seen, n = defaultdict(int), corpus_pipeline.REPEAT
    for t in docs.values():
        b = t.encode()
        for o in range(len(b) - n + 1):
            seen[b[o : o + n]] += 1
    for d, t in list(docs.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for o in range(len(b) - n + 1):
            if seen[b[o : o + n]] > 1:
                gone[o : o + n] = True
        docs[d] = _cut(b, gone)
    words = lambda t: re.findall(r"\w+", t.lower())
    runs = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    hit = lambda t: any(len(runs(x) & runs(t)) >= 0.8 * len(runs(x)) for x in items)
    return {d: t for d, t in docs.items() if t and not hit(t)}


def test_pipeline(spark, tmp_path):
    shared, item, base = prose(120, 1), prose(30, 2), prose(200, 3)
    rows = [(i, prose(60 + i, 10 + i)) for i in range(12)]
    rows += [(20 + i, prose(40, 40 + i) + " é" + shared + "é " + prose(40, 60 + i)) for i in range(4)]
    rows += [(30 + i, prose(50, 80 + i) + " " + item.upper() + " " + prose(50, 90 + i)) for i in range(3)]
    rows += [(40 + i, " ".join("zz" if k == 7 * i else w for k, w in enumerate(base.split()))) for i in range(4)] + [(50, base), (51, base)]
    rows += [(60, None), (61, ""), (62, "12 + 3"), (63, "été")]
    docs = spark.createDataFrame([(d, t, "en" if d % 2 else "fr", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(25, 999))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        assert at.columns == docs.columns
    want = _brute(rows, [item, prose(25, 999)])
    assert {r["doc_id"]: r["text"] for r in at.collect()} == want and at.where(F.col("n_chars") != F.length("text")).count() == 0
    assert {40, 20, 0} <= set(want) and not {30, 50, 60, 62} & set(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    got = {r["doc_id"]: (r["n"], r["t"]) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert set(got) == set(want) and all(n == t for n, t in got.values())
    # Empty input, and repeated rows with null ids, go through.
    one = spark.createDataFrame([(None, "le chat " * 9, "fr", "s", 72)] * 2, docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.near_duplicates(spark, one, "").count() == 1
