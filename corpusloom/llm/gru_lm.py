"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

Vocabulary. Counts of all tokens of all training documents are gathered exactly (by 64-bit hash). The
`WORDS` most frequent are modelled one by one; they are cut into `CLASSES` classes of equal mass in the
order of frequency. All other tokens, unseen ones included, belong to one of `TAILS` tail classes by their
last two bytes. The output softmax is factored: P(class | state), then within a frequent class
P(word | class, state), and within a tail class the smoothed count (c + 0.5) / (N_t + 0.5 (V_t + 1)).
So a document's probability is that of all its tokens, and one sum over documents of any length.

Encoding. Documents are cut into tokens once more and written as model ids of two bytes a token, with the
sums of counts and the hashes of tokens that aren't among the `KNOWN` most frequent. Training and
scoring read these tables and never the texts. Tokens outside `KNOWN` meet the table of counts in a join
by hash, and their sums return by row.

Model. A gated recurrent unit; its input rows are looked up by word or tail class; the state is zero at
the start of a document and is carried across windows. Documents run through `lanes` side by side: a
lane that ends a document takes the next one, so lanes stay full whatever the lengths are.

Training. Truncated backpropagation over windows of `WINDOW` tokens with the state carried on. Each
training document is seen once: it is dealt, by a hash of its row, to one of the rounds and to one of its
trainers. Rounds and trainers follow from the number of tokens alone (`QUANTUM` tokens for a trainer in
a round, `MOST_ROUNDS` rounds, then more trainers), not from the partitions of the input; the models of
a round are averaged by tokens, chunk by chunk. A document of over `SEGMENT` tokens is trained in
segments, each of which reads the `WARM` tokens before it for its state. Beyond `MOST_TRAINERS` trainers
each sees more tokens: documents stream through it, so its memory doesn't grow. Biases begin at the
counts, so that an untrained model is a unigram model.

Nulls: a null text is empty and has only its end token. Repeated rows, and rows with one doc_id, are
trained on and scored each. Without training documents, N and V are 0 and only the smoothing is left. An
empty table gives no rows. Ties of counts go to the smaller hash. Columns of docs that are named as one of
the new ones are replaced; all others stay. A very long text is cut into tokens piece by piece.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import written
from corpusloom.llm.textbytes import LOWER, blocks, pieces, prefix_hashes, span_hashes, text_bytes, word_spans

WORDS, CLASSES, TAILS, KNOWN = 2048, 32, 24, 131_072
HIDDEN, WINDOW, RATE = 16, 32, 0.08
#: Documents side by side: usually, and at least, where few tokens would make fewer than UPDATES windows.
LANES, LEAST_LANES, UPDATES = 384, 16, 400
#: Tokens of a trainer in a round, most rounds, and most trainers, beyond which each sees more tokens.
QUANTUM, MOST_ROUNDS, MOST_TRAINERS = 1 << 20, 16, 1024
#: Tokens of a segment of a long document while training, and tokens before it that are read for its state.
SEGMENT, WARM = 512, 32
END = np.int64(0x656E64)  # the end token's stand-in for a hash
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Tokens that a scoring task looks ahead.
AHEAD = 1 << 21
CHUNK = 4096
#: Rows whose outputs are worked on at a time, so that they stay in a cache.
ROWS = 4096


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, borders, hashes, tail classes) for runs of whole texts; each text's tokens and its end token."""
    body, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        whole = body[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        hashes, tails, first = [], [], np.zeros(b - a + 1, np.int64)
        for p, q in pieces(whole, SPACE):
            x = LOWER[whole[p:q]]
            starts, ends, before_text = word_spans(~SPACE[x], np.clip(at - p, 0, len(x)))
            first += before_text
            w = span_hashes(prefix_hashes(x), starts, ends).view(np.int64)
            w[w == END] += 1
            last = x[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
            before = np.where(ends - starts > 1, x[np.maximum(ends - 2, 0)].astype(np.int64), 0) if len(ends) else last
            hashes.append(w)
            tails.append((before * 31 + last) % TAILS)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        borders = first + np.arange(b - a + 1)
        out, tail = np.full(borders[-1], END), np.zeros(borders[-1], np.int64)
        inner = np.ones(len(out), bool)
        inner[borders[1:] - 1] = False
        out[inner], tail[inner] = words, np.concatenate(tails) if tails else words
        yield a, borders, out, tail


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, t, n: partial counts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def squeeze() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, t, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at, of = np.unique(w, return_index=True, return_inverse=True)
        return keys, t[at], np.bincount(of, weights=n).astype(np.int64)

    def batch(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], names=["w", "t", "n"])

    size = 0
    for b in batches:
        for _, _, w, t in tokens(b.column(0)):
            keys, at, n = np.unique(w, return_index=True, return_counts=True)
            held.append((keys, t[at], n.astype(np.int64)))
            size += len(keys)
            if size > 2_000_000:
                rows = squeeze()
                held, size = [rows], len(rows[0])
                if size > 1_000_000:
                    yield batch(rows)
                    held, size = [], 0
    if held:
        yield batch(squeeze())


class Model:
    """Vocabulary, counts and parameters."""

    def __init__(self, known: list[tuple[int, int, int]], n: int, v: int, tails: dict[int, tuple[int, int]]):
        """known: (hash, tail class, count), most frequent first, the end token among the first WORDS."""
        w = np.array([k[0] for k in known], np.int64)
        c = np.array([k[2] for k in known], np.float64)
        words = min(WORDS, len(known))
        self.n, self.v, self.words = n, v, words
        # Classes of equal mass in the order of frequency.
        mass = np.cumsum(c[:words]) / max(1.0, c[:words].sum())
        cut = np.minimum((mass * CLASSES - 1e-9).astype(int), CLASSES - 1)
        self.class_of = np.unique(cut, return_inverse=True)[1]
        self.classes = int(self.class_of[-1]) + 1
        self.class_at = np.concatenate([self.class_of, self.classes + np.arange(TAILS)]).astype(np.int16)
        self.first = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        # An open table of the known hashes: a slot holds the place of one of them, or none.
        self.w, self.count, self.bits = w, c, max(4, (4 * len(w) - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(w)), self.home(w)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.tail_norm = np.array([tails.get(t, (0, 0))[0] + 0.5 * (tails.get(t, (0, 0))[1] + 1) for t in range(TAILS)])
        self.end = int(np.flatnonzero(w == END)[0])
        rng = np.random.default_rng(5)
        h, k = HIDDEN, self.classes + TAILS
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        class_mass = np.concatenate([np.bincount(self.class_of, weights=c[:words] + 0.5, minlength=self.classes), [tails.get(t, (0, 0))[0] + 0.5 for t in range(TAILS)]])
        self.p = {"x": small(words + TAILS, 3 * h), "u": small(h, 3 * h), "c": small(h, k), "cb": np.log(class_mass / class_mass.sum()).astype(np.float32), "w": small(words, h), "wb": np.log(c[:words] + 0.5).astype(np.float32)}

    def ids(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model ids, counts or -1 where the token isn't among the known)."""
        at, left = self.home(w), np.arange(len(w))
        place = np.full(len(w), -1, np.int64)
        while len(left):
            found = self.slot[at]
            hit = (found >= 0) & (self.w[found] == w[left])
            place[left[hit]] = found[hit]
            more = (found >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        ids = np.where((place >= 0) & (place < self.words), place, self.words + t)
        return ids, np.where(place >= 0, self.count[place], -1.0)

    def home(self, w: np.ndarray) -> np.ndarray:
        return ((w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, x: np.ndarray, h: np.ndarray, keep: tuple | None = None):
        """One step of the unit for input ids x; the state is zero after an end token."""
        n = HIDDEN
        h = h * (x != self.end)[:, None]
        a = self.p["x"][x]
        g = h @ self.p["u"]
        zr = 1.0 / (1.0 + np.exp(-(a[:, : 2 * n] + g[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        gn = g[:, 2 * n :]
        m = np.tanh(a[:, 2 * n :] + r * gn)
        new = m + z * (h - m)
        return new if keep is None else (new, (h, z, r, gn, m))

    def output(self, s: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """log P of each target's class and word within it (natural logarithm); with grad, also d/ds."""
        k = self.class_at[y]
        logp, ds = np.empty(len(y)), None if grad is None else np.empty_like(s)
        ones = np.ones(self.classes + TAILS, np.float32)
        for a in range(0, len(y), ROWS):
            part = s[a : a + ROWS]
            lines, of = np.arange(len(part)), k[a : a + ROWS]
            e = part @ self.p["c"]
            e += self.p["cb"]
            own = e[lines, of]
            if e.max(initial=0.0) > 60.0:  # far from what training makes, but exp must not overflow
                top = e.max(1)
                e -= top[:, None]
                own = own - top
            pe = np.exp(e, out=e)
            total = pe @ ones
            logp[a : a + ROWS] = own - np.log(total)
            if grad is not None:
                pe *= (-1.0 / total)[:, None]
                pe[lines, of] += 1.0
                grad["c"] += part.T @ pe
                grad["cb"] += pe.sum(0)
                ds[a : a + ROWS] = pe @ self.p["c"].T
        order = np.argsort(k, kind="stable")
        edges = np.searchsorted(k[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            rows = order[edges[c] : edges[c + 1]]
            lo, hi = self.first[c], self.first[c + 1]
            if not len(rows) or hi - lo == 1:
                continue
            q = s[rows]
            o = q @ self.p["w"][lo:hi].T
            o += self.p["wb"][lo:hi]
            at, mine = np.arange(len(rows)), y[rows] - lo
            if o.max() > 60.0:
                o -= o.max(1, keepdims=True)
            hit = o[at, mine]
            po = np.exp(o, out=o)
            t = po @ np.ones(hi - lo, np.float32)
            logp[rows] += hit - np.log(t)
            if grad is not None:
                po *= (-1.0 / t)[:, None]
                po[at, mine] += 1.0
                grad["w"][lo:hi] += po.T @ q
                grad["wb"][lo:hi] += po.sum(0)
                ds[rows] += po @ self.p["w"][lo:hi]
        return logp, ds

    def train(self, docs: Iterator[np.ndarray], squares: dict[str, np.ndarray], lanes: int) -> int:
        """One pass over documents' ids, each closed by the end token; the number of tokens learnt from."""
        n, seen = HIDDEN, 0
        h = np.zeros((lanes, n), np.float32)
        for live, x, y, on, _ in windows(segments(docs), lanes, self.end):
            h, states, kept = h[live], [], []
            for t in range(len(x)):
                h, k = self.step(x[t], h, ())
                states.append(h)
                kept.append(k)
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            learnt = on.ravel() == LEARNT
            ds = np.zeros((len(learnt), n), np.float32)
            ds[learnt] = self.output(np.concatenate(states)[learnt], y.ravel()[learnt], grad)[1]
            ds = ds.reshape(len(x), len(live), n)
            back, da = np.zeros_like(h), np.empty((len(x), len(live), 3 * n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h0, z, r, gn, m = kept[t]
                d = ds[t] + back
                dm = d * (1 - z) * (1 - m * m)
                dg = np.concatenate([d * (h0 - m) * z * (1 - z), dm * gn * r * (1 - r), dm * r], 1)
                da[t, :, : 2 * n], da[t, :, 2 * n :] = dg[:, : 2 * n], dm
                grad["u"] += h0.T @ dg
                back = (d * z + dg @ self.p["u"].T) * (x[t] != self.end)[:, None]
            flat = x.ravel().astype(np.uint16)
            order = np.argsort(flat, kind="stable")
            rows, at = np.unique(flat[order], return_index=True)
            grad["x"][rows] = np.add.reduceat(da.reshape(-1, 3 * n)[order], at, axis=0)
            for k, g in grad.items():
                g /= lanes
                np.clip(g, -5, 5, out=g)
                squares[k] += g * g
                self.p[k] += RATE * g / np.sqrt(squares[k] + 1e-6)
            seen += int(learnt.sum())
        return seen

    def score(self, docs: Iterator[tuple[object, np.ndarray]], lanes: int = LANES) -> Iterator[tuple[object, float]]:
        """(tag, the model's log10 probability of its classes and frequent words) of each document, as they end."""
        h, sums = np.zeros((lanes, HIDDEN), np.float32), {}
        tags: dict[int, object] = {}

        def numbered() -> Iterator[tuple[int, np.ndarray, int]]:
            for i, (tag, ids) in enumerate(longest_first(docs)):
                tags[i] = tag
                yield i, ids, 0

        for live, x, y, on, owner in windows(numbered(), lanes, self.end):
            h, states = h[live], []
            for t in range(len(x)):
                h = self.step(x[t], h)
                states.append(h)
            here = on.ravel() == LEARNT
            logp, _ = self.output(np.concatenate(states)[here], y.ravel()[here])
            own, of = np.unique(owner.ravel()[here], return_inverse=True)
            ended = set(owner[(y == self.end) & (on == LEARNT)].tolist())
            for i, s in zip(own.tolist(), np.bincount(of, weights=logp).tolist(), strict=True):
                s += sums.pop(i, 0.0)
                if i in ended:
                    yield tags.pop(i), s / LN10
                else:
                    sums[i] = s


#: Kinds of places in a window: nothing there, read for the state only, learnt from or scored.
EMPTY, READ, LEARNT = 0, 1, 2
LN10 = float(np.log(10.0))


def longest_first(docs: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[object, np.ndarray]]:
    """Runs of documents of AHEAD tokens, the longest of each run first, so that no long one is left alone at the end."""
    held, size = [], 0
    for d in docs:
        held.append(d)
        size += len(d[1])
        if size >= AHEAD:
            yield from sorted(held, key=lambda d: -len(d[1]))
            held, size = [], 0
    yield from sorted(held, key=lambda d: -len(d[1]))


def segments(docs: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(0, ids, how many of them are only read): long documents in pieces that overlap by WARM tokens."""
    for ids in docs:
        for a in range(0, len(ids), SEGMENT):
            warm = min(a, WARM)
            yield 0, ids[a - warm : a + SEGMENT], warm


def windows(docs: Iterator[tuple[int, np.ndarray, int]], lanes: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(live lanes, inputs, targets, kind of each place, owner of each place): WINDOW rows, a column for each live lane.

    live are places in the columns of the window before. The input at the start of a document is the end token.
    """
    now: list[tuple[int, np.ndarray, int, int] | None] = [None] * lanes  # owner, ids, only read, position
    while True:
        x, y = np.full((lanes, WINDOW), end), np.full((lanes, WINDOW), end)
        on, owner = np.zeros((lanes, WINDOW), np.int8), np.full((lanes, WINDOW), -1)
        live = []
        for i in range(lanes):
            t = 0
            while t < WINDOW:
                if now[i] is None:
                    new = next(docs, None)
                    if new is None:
                        break
                    now[i] = (*new, 0)
                who, ids, warm, at = now[i]
                n = min(WINDOW - t, len(ids) - at)
                y[i, t : t + n] = ids[at : at + n]
                if at:
                    x[i, t] = ids[at - 1]
                x[i, t + 1 : t + n] = ids[at : at + n - 1]
                on[i, t : t + n] = LEARNT
                if at < warm:
                    on[i, t : t + min(n, warm - at)] = READ
                owner[i, t : t + n] = who
                now[i] = (who, ids, warm, at + n) if at + n < len(ids) else None
                t += n
            if t:
                live.append(i)
        if not live:
            return
        if len(live) < lanes:
            now = [now[i] for i in live]
            lanes = len(live)
        at = np.array(live)
        yield at, np.ascontiguousarray(x[at].T), np.ascontiguousarray(y[at].T), np.ascontiguousarray(on[at].T), np.ascontiguousarray(owner[at].T)


def gather(training: DataFrame) -> tuple[DataFrame, Model]:
    """(w, c: counts of all training tokens; the untrained model). training has the column text."""
    counts = training.mapInArrow(count_tokens, "w long, t int, n long").groupBy("w").agg(F.sum("n").alias("c"), F.min("t").alias("t"))
    counts = written(counts, "counts")
    top = [(r["w"], r["t"], r["c"]) for r in counts.orderBy(F.desc("c"), "w").limit(KNOWN).collect()]
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = next((k for k in top if k[0] == END), (int(END), 0, 0))
    top = [end, *[k for k in top if k[0] != END]]
    top[1:] = sorted(top[1:], key=lambda k: (-k[2], k[0]))
    place = next((i for i, k in enumerate(top[1:WORDS], 1) if k[2] <= end[2]), min(WORDS, len(top)))
    top.insert(place - 1, top.pop(0))
    frequent = [k[0] for k in top[:WORDS]]
    tails = {t: [0, 0] for t in range(TAILS)}
    for r in counts.groupBy("t").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # TAILS rows
        tails[r["t"]] = [r["c"], r["v"]]
    seen = {k[0]: k for k in top}
    for w in frequent:
        if seen[w][2]:
            tails[seen[w][1]][0] -= seen[w][2]
            tails[seen[w][1]][1] -= 1
    return counts.select("w", "c"), Model(top, int(n), int(v), {t: (a, b) for t, (a, b) in tails.items()})


def encode(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """A table of docs' other columns, model ids and what is known of each row's counts."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in {*new, text} and not c.startswith("__")]
    norm = model.n + 0.5 * (model.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for a, borders, w, t in tokens(b.column(len(kept))):
                n, first = len(borders) - 1, borders[:-1]
                lengths = np.diff(borders)
                ids, c = model.ids(w, t)
                rare, tail = c < 0, ids >= model.words
                log_c = np.log10(np.where(rare, 1.0, c + 0.5))
                add = lambda v: np.add.reduceat(v, first)  # noqa: B023, E731
                base = add(log_c) - lengths * np.log10(norm)
                # Of tail tokens the count is added here, or by the join; their norms are known.
                own = add(np.where(tail, log_c - np.log10(model.tail_norm)[np.where(tail, ids - model.words, 0)], 0.0))
                left = add(rare.astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.array(w[rare]))
                packed = ids.astype("<u2").tobytes()
                parts = pa.array([packed[2 * p : 2 * q] for p, q in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)], pa.binary())
                made = [pa.array(row + np.arange(n)), pa.array(lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(base), pa.array(own), lists, parts]
                row += n
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, n) for i in range(len(kept))), *made], names=[*kept, *ENCODED])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    extra = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ENCODED.items()))
    return written(source.mapInArrow(run, StructType([*source.schema.fields[:-1], *extra.fields])), "encoded")


#: Columns of an encoded table.
ENCODED = {"__row": "long", "n_tokens": "long", "__known": "long", "__base": "double", "__own": "double", "__rare": "array<bigint>", "__ids": "binary"}


def fit(encoded: DataFrame, model: Model, quantum: int = QUANTUM) -> None:
    """Rounds of local training and averaging over rows of an encoded table."""
    total = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rounds = int(max(1, min(MOST_ROUNDS, total // quantum)))
    trainers = int(max(1, min(MOST_TRAINERS, -(-total // (rounds * quantum)))))
    lanes = int(max(LEAST_LANES, min(LANES, total // (WINDOW * UPDATES))))
    shapes = {k: v.shape for k, v in model.p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, i) for b in batches for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            own = copy.copy(model)
            own.p = {k: v.copy() for k, v in model.p.items()}
            squares = {k: np.full(s, 0.1, np.float32) for k, s in shapes.items()}
            seen = own.train((np.frombuffer(i, "<u2") for _, i in mine), squares, lanes)
            flat = np.concatenate([own.p[k].ravel() for k in shapes])
            parts = [flat[i : i + CHUNK].astype(np.float32).tobytes() for i in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "seen", "data"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most MOST_TRAINERS rows of one chunk."""
        x = np.stack([np.frombuffer(d, np.float32) for d in pdf["data"]])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [np.average(x, axis=0, weights=pdf["seen"]).astype(np.float32).tobytes()]})

    deal = F.pmod(F.xxhash64(F.col("__row"), F.lit(1)), F.lit(rounds))
    for r in range(rounds):
        part = encoded.where(deal == r).select(F.pmod(F.xxhash64(F.col("__row"), F.lit(2)), F.lit(trainers)).cast("int").alias("trainer"), "__ids", "__row")
        part = part.repartition(3 * trainers, "trainer").sortWithinPartitions("trainer", F.xxhash64(F.col("__row"), F.lit(3))).select("trainer", "__ids")
        got = sorted(part.mapInArrow(run, "chunk int, seen long, data binary").groupBy("chunk").applyInPandas(mean, "chunk int, data binary").collect(), key=lambda x: x["chunk"])
        if not got:
            continue
        flat, at = np.frombuffer(b"".join(bytes(x["data"]) for x in got), np.float32), 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            model.p[k] = flat[at : at + size].reshape(shape).copy()
            at += size


def score(encoded: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The other columns of an encoded table with n_tokens, n_known, train_tokens, base_score and score."""
    kept = [c for c in encoded.columns if c not in ENCODED]
    names = ["__row", "n_tokens", "__known", "__base", "__own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows leave when their documents end; a lane each waits."""
        last = len(kept) + len(names)

        def docs() -> Iterator[tuple[tuple[pa.RecordBatch, int], np.ndarray]]:
            for b in batches:
                for a in range(0, len(b), 64):
                    part = b.slice(a, 64)
                    rows = part.drop_columns(part.schema.names[last]).to_pylist()
                    for row, ids in zip(rows, part.column(last).to_pylist(), strict=True):
                        yield row, np.frombuffer(ids, "<u2")

        def batch(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=arrow)

        arrow = None
        stream = iter(batches)
        head = next(stream, None)
        if head is None:
            return
        batches = chain([head], stream)
        arrow = pa.schema([head.schema.field(i) for i in range(last)])
        done: list[dict] = []
        for row, s in model.score(docs()):
            done.append(row | {"__own": row["__own"] + s})
            if len(done) == 4096:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    source = encoded.select(*[F.col(f"`{c}`") for c in kept], *names, "__ids")
    done = source.mapInArrow(run, StructType(source.schema.fields[:-1]))
    pairs = encoded.select("__row", F.explode("__rare").alias("w")).join(counts.hint("shuffle_hash"), "w", "left")
    c = F.coalesce("c", F.lit(0))
    sums = pairs.groupBy("__row").agg(F.sum(F.log10(c + 0.5)).alias("s"), F.sum((c > 0).cast("long")).alias("k")).withColumnRenamed("__row", "r")
    out = done.join(sums, F.col("__row") == F.col("r"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        *[F.col(f"`{x}`") for x in kept], "n_tokens", (F.col("__known") + zero("k")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("s", F.lit(0.0))).alias("base_score"), (F.col("__own") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
