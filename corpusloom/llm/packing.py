"""Cost-balanced packing of token sequences.

A document of n tokens costs `LINEAR * n + QUADRATIC * n * n`: the part of a transformer that is linear in
tokens and its attention, which stays within a document. Documents of a group, the longest first, go to
the sequence of the lowest cost so far that has room for the whole document. The group opens just as
many sequences as its tokens fill, so late documents may find no room that is wide enough; those are cut
and laid into what room is left, the lowest cost first. Documents longer than a sequence give full
sequences and a rest. What is left at the end fills sequences of a power of two, which need no padding.

Groups are runs of documents of one input partition up to `GROUP_TOKENS`, so nothing is shuffled and a
task holds one group at a time; a document is never split over groups. sequence_id is the partition in
the high bits and a count in the low ones, the same when a lost task runs again on its partition.

Tokenising remembers the ids of words already seen: the vocabulary joins nothing across white space, so
the ids of a text are those of its words in order (`WordTokenizer`, tested for equality with encode()).

Nulls: a null text is empty and has only its end token. An empty table gives no rows. Of documents of equal
length the earlier one of the partition goes first, of sequences of equal cost the one with the lower
number. Repeated rows are packed each. Columns of docs other than the two named aren't read, whatever
their names. A very long text is one row; its pieces are full sequences and a rest.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.common import frugal

LENGTH = 2048
END_ID = 1
#: A group of documents is packed when it has so many tokens.
GROUP_TOKENS = 1 << 20
#: Cost of a token, and of a pair of tokens; equal at 4096 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Most words whose ids a worker remembers, some 50 MB; beyond that it forgets the later half.
WORDS = 250_000
#: Documents that are tokenised together.
ROWS = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


#: A stop or comma between a letter and white space is a token of its own.
_STOP = re.compile(r"(?<=[a-z\xe0-\xf6\xf8-\xff])([.,])(?=[ \n])")


def _plain(text: str) -> str:
    """text with fewer distinct words and the same ids: lower case, and stops set apart, in Latin-1 texts.

    There lower() maps single letters to single letters, as the tokenizer's own lower-casing does.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return _STOP.sub(r" \1", text.lower())


#: Tokenizers of this worker process by path, with the words that they know: a worker takes one task after the other.
_OPEN: dict[str, WordTokenizer] = {}


def opened(path: str) -> WordTokenizer:
    """The worker's tokenizer for a path. What it remembers (at most `WORDS` words) changes no ids, only what they cost."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


class WordTokenizer:
    """ids of whole texts under a tokenizers file whose pre-tokenizer never joins over white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._one = Tokenizer.from_file(path)
        # A text that may hold a special token, in whatever case, is left to the tokenizer as a whole.
        special = [t.content for t in self._one.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE)
        self._mark = max(set.intersection(*map(set, special)), key=lambda c: (not c.isalnum(), c), default="") if special else ""
        # The same merges for lower-case words that are already set apart by spaces.
        self._light = Tokenizer.from_file(path)
        self._light.normalizer = normalizers.Sequence([])
        self._light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._one.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        apart = [i for i, t in enumerate(texts) if self._mark in t and self._special.search(t)]
        if apart:
            known = {i: np.array(self._one.encode(texts[i], add_special_tokens=False).ids, "<u4") for i in apart}
            rest = iter(self._words([t for i, t in enumerate(texts) if i not in known]))
            return [known[i] if i in known else next(rest) for i in range(len(texts))]
        return self._words(texts)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_plain(t).replace("\n", " ").split(" ") for t in texts]
        flat = [w for words in cut for w in words]
        found = list(map(self._known.get, flat))
        if None in found:
            absent = [i for i, x in enumerate(found) if x is None]
            new = self._learn(list(dict.fromkeys(flat[i] for i in absent)))
            for i in absent:
                found[i] = new[flat[i]]
            self._known |= new
            if len(self._known) > WORDS:  # common words come early: they stay
                self._known = dict(islice(self._known.items(), WORDS // 2))
        out, at = [], 0
        for words in cut:
            out.append(np.frombuffer(b"".join(found[at : at + len(words)]), "<u4"))
            at += len(words)
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """ids of each word. Those of plain shape are encoded by one call over all, and cut at the ids that end words."""
        plain: dict[str, int] = {}
        shown: list[str] = []
        out: dict[str, bytes] = {}
        for w in words:
            if w and max(w) <= "\xff":  # so that normalising keeps letters letters
                if w.isalpha():
                    plain[w] = 1
                    shown.append(w.lower())
                    continue
                if w[-1] in ".,;:!?|" and w[:-1].isalpha():
                    plain[w] = 2
                    shown.append(f"{w[:-1].lower()} {w[-1]}")
                    continue
            out[w] = np.array(self._one.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if plain:
            ids = np.array(self._light.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[ids])[np.cumsum(list(plain.values())) - 1] + 1
            edges = [0, *ends.tolist()]
            out |= {w: ids[a:b].tobytes() for w, a, b in zip(plain, edges[:-1], edges[1:], strict=True)}
        return out


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); lengths are of whole documents."""
    pieces, sequences = [], 0
    rest: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths):
        full = n // size
        for k in range(full):
            pieces.append((d, k * size, size, sequences, 0))
            sequences += 1
        if n % size:
            rest.append((n % size, d, full * size))
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rest)
    rooms = [size] * (total // size)
    left = total % size
    power = 1 << max(0, size.bit_length() - 1)
    while left:  # 1500 is 1024 + 256 + 128 + ...: no padding
        while power > left:
            power >>= 1
        rooms.append(power)
        left -= power
    base, used = sequences, [0] * len(rooms)
    # Lengths only fall, so the heap holds just the sequences with room for the document at hand: one that
    # has less waits under its room until a document is short enough.
    heap = [(0.0, s) for s in range(len(rooms)) if rooms[s] == size]
    load = [0.0] * len(rooms)
    waiting: list[tuple[int, int]] = [(-rooms[s], s) for s in range(len(rooms)) if rooms[s] < size]
    heapq.heapify(waiting)
    late = []
    for n, d, start in rest:
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(heap, (load[s], s))
        if not heap:
            late.append((n, d, start))
            continue
        place = heap[0][1]
        pieces.append((d, start, n, base + place, used[place]))
        used[place] += n
        load[place] += cost(n)
        if rooms[place] - used[place] >= n:
            heapq.heapreplace(heap, (load[place], place))
            continue
        heapq.heappop(heap)
        if used[place] < rooms[place]:
            heapq.heappush(waiting, (used[place] - rooms[place], place))
    for _, s in waiting:
        heapq.heappush(heap, (load[s], s))
    for n, d, start in late:  # cut into what room is left
        while n:
            _, s = heapq.heappop(heap)
            part = min(n, rooms[s] - used[s])
            pieces.append((d, start, part, base + s, used[s]))
            used[s] += part
            load[s] += cost(part)
            start, n = start + part, n - part
            if used[s] < rooms[s]:
                heapq.heappush(heap, (load[s], s))
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = LENGTH) -> DataFrame:
    """One row for each piece (SCHEMA). ids are those of the text and then END_ID."""
    from pyspark.sql import functions as F

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, done = opened(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held, end = 0, np.array([END_ID], "<u4")
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, len(x), ROWS)):
            for key, found in zip(b.column(0).to_pylist(), tokenizer([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids.append(np.append(found, end))
                keys.append(key)
                held += len(ids[-1])
                if held >= GROUP_TOKENS:
                    out, used = laid(keys, ids, (part << 40) + done, size)
                    yield out
                    done, held, ids, keys = done + used, 0, [], []
        if ids:
            yield laid(keys, ids, (part << 40) + done, size)[0]

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, SCHEMA)


def laid(keys: list[int | None], ids: list[np.ndarray], first: int, size: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a group as a batch, and how many sequences it took."""
    pieces = pack([len(x) for x in ids], size)
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    crc = [zlib.crc32(ids[d][s : s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
    count = int(sequence.max()) + 1
    tokens, load = np.zeros(count, np.int64), np.zeros(count)
    np.add.at(tokens, sequence, length)
    np.add.at(load, sequence, LINEAR * length + QUADRATIC * length.astype(float) ** 2)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([len(ids[d]) for d in doc.tolist()], pa.int64()), pa.array(sequence + first), pa.array(offset), pa.array(tokens[sequence]), pa.array(load[sequence])]
    return pa.RecordBatch.from_arrays(columns, names=names), count
