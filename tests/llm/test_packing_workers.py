"""One worker's tasks share a tokenizer, and what it remembers changes no piece."""

import numpy as np

from corpusloom.llm import packing
from corpusloom.llm.q07_packing import tokenizer_path

TEXTS = ["Die Katze, die auf dem Dach sass. Sie schlief.", "La réunion, demain? Oui. " * 30, "", "<|endoftext|> and <S> marks", "日本語 and ＦＵＬＬ width", "word. word, word! " * 200]


def test_second_task_of_a_worker_gives_equal_rows(spark):
    path = tokenizer_path()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    rows = lambda: sorted(tuple(r)[:5] for r in packing.pack_documents(docs.coalesce(1), path).collect())
    assert rows() == rows()
    spread = sorted(tuple(r)[:1] + (r["doc_tokens"],) for r in packing.pack_documents(docs.repartition(4), path).select("doc_id", "doc_tokens").distinct().collect())
    assert spread == sorted({(r[0], r[4]) for r in rows()})


def test_memory_is_shared_bounded_and_harmless(monkeypatch):
    path = tokenizer_path()
    assert packing.opened(path) is packing.opened(path)
    plain = packing.WordTokenizer(path)
    want = [plain._one.encode(t, add_special_tokens=False).ids for t in TEXTS]
    monkeypatch.setattr(packing, "WORDS", 8)
    small = packing.WordTokenizer(path)
    for _ in range(3):
        assert [x.tolist() for x in small(TEXTS)] == want
        assert len(small._known) <= 8
    assert np.concatenate(packing.opened(path)(TEXTS)).tolist() == [i for w in want for i in w]
