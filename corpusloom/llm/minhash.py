"""Near-duplicate detection by ProbMinHash, banding and exact verification.

Documents are weighted sets of word shingles (five lower-cased words; a document of fewer words is one
shingle), the weight being the count. ProbMinHash gives each of `REGISTERS` registers the shingle whose
Poisson process, of a rate equal to its weight, is the first to arrive there; two documents agree in a
register with their probability Jaccard similarity. Arrivals are drawn from the shingle's hash, and only
those before a horizon are made; the horizon doubles until every register is filled, which is the same
result as without it.

Texts with the same words are one class from the start. One signature for each such class is cut into
`BANDS` bands of `ROWS` registers; at similarity 0.8 a pair is missed with probability
(1 - 0.8**ROWS)**BANDS, 3e-6. A bucket of equal bands is searched in blocks of
at most `BLOCK` members. Within a block every pair that isn't connected yet, that has no earlier block in
common and whose signatures may reach the threshold is verified by the exact similarity of the whole
shingle sets, the most alike first; a block returns no more links than connect it, so a group of g near
copies gives g - 1 links and not g * g pairs. A bucket of several blocks shares `HUBS` members between
them, which connects most of a crowded bucket cheaply. What these links leave apart is searched in full:
the members of a bucket outside its largest class so far meet all members of the bucket, in a grid of
blocks by blocks, so that every pair of a bucket is either connected or compared.

Verified links make classes by connected components: labels spread by the least neighbour and jump, each round a written table.

Texts with the same words are told by 128 bits over all their shingles in order. Sets of shingles keep 32
bits of a shingle's hash: of two texts of n and m shingles about n * m / 2**32 shingles look common by chance,
a ten-thousandth of the texts at a million words each, and the similarity is exact but for that.

Words are runs of letters, marks, digits and underscores, lower-cased; a script without spaces makes one word
of each run. Nulls: a null, empty or wordless text has no shingles and is a class of its own for each document.
Rows that repeat are copies. doc_id may be null or repeated; the class is named by the least key of its
members, `class_id`, so ties don't matter. An empty table gives no rows. Columns of docs other than the named
ones aren't read, whatever their names. A very long text is cut into words piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import attach, broadcast_if_small, drop_written, frugal, written
from corpusloom.llm.textbytes import LOWER, blocks, mixed, pieces, prefix_hashes, span_hashes, text_bytes, word_spans

WIDTH = 5
THRESHOLD = 0.8
REGISTERS, BANDS, ROWS = 96, 24, 4
#: Members of a bucket that are searched together; first members that all blocks of a bucket share.
BLOCK, HUBS = 4096, 16
#: Least share of equal registers at which a pair is verified; 0.8 less about 4.4 standard deviations.
LIKELY = 0.62
IS_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
#: What stands between words; ASCII is told apart by IS_WORD.
APART = r"[^\p{L}\p{M}\p{N}_\x00-\x7f]+"
SEED = np.uint64(0xD1B54A32D192ED03)


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, borders, shingle hashes, word counts) for runs of whole texts; row i owns hashes[borders[i]:borders[i + 1]]."""
    body, offsets = text_bytes(column)
    if len(body) and body.max() >= 128:
        body, offsets = text_bytes(pc.replace_substring_regex(pc.utf8_lower(column), APART, " "))
    for a, b in blocks(offsets):
        whole = body[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        parts, first = [], np.zeros(b - a + 1, np.int64)
        for p, q in pieces(whole, ~IS_WORD):
            x = LOWER[whole[p:q]]
            starts, ends, before = word_spans(IS_WORD[x], np.clip(at - p, 0, len(x)))
            first += before
            parts.append(span_hashes(prefix_hashes(x), starts, ends))
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        counts = np.diff(first)
        # A text of n words has n - 4 shingles, or one of all its words if it has fewer than five.
        number = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
        borders = np.concatenate([[0], np.cumsum(number)])
        doc = np.repeat(np.arange(b - a), number)
        begin = np.arange(borders[-1]) - borders[:-1][doc] + first[:-1][doc]
        size = np.minimum(counts, WIDTH)[doc]
        h = np.full(len(begin), SEED) + size.astype(np.uint64)
        for k in range(WIDTH):
            use = k < size
            w = np.zeros(len(begin), np.uint64)
            w[use] = words[begin[use] + k]
            h = np.where(use, mixed(h * np.uint64(0x9FB21C651E98DF25) + w), h)
        yield a, borders, h, counts


def signatures(borders: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row of winning shingle hashes for each document; 0 throughout for one without shingles.

    The processes of all documents of the run are advanced together; a document whose registers aren't all
    filled at its horizon is done again with twice the horizon.
    """
    n = len(borders) - 1
    doc = np.repeat(np.arange(n), np.diff(borders))
    order = np.argsort(mixed(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h))).astype(float)
    doc, h = doc[at], h[at]
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = REGISTERS * (np.log(REGISTERS) + 3.0) / np.maximum(total, 1.0)
    out = np.zeros((n, REGISTERS), np.uint64)
    todo = total > 0
    while todo.any():
        index = np.flatnonzero(todo[doc])
        state, time = h[index], np.zeros(len(index))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(index):
            state = mixed(state + SEED)
            u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            # Most first arrivals lie beyond the horizon: -log(u) >= 1 - u tells without a logarithm.
            on = 1.0 - u <= (horizon[doc[index]] - time) * weight[index]
            index, state, time, u = index[on], state[on], time[on], u[on]
            time = time - np.log(u) / weight[index]
            on = time <= horizon[doc[index]]
            index, state, time = index[on], state[on], time[on]
            register = (mixed(state ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(REGISTERS)).astype(np.int64)
            found.append((index, time, doc[index] * REGISTERS + register))
        index, time, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.full(n * REGISTERS, np.inf)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        filled = np.isfinite(best).reshape(n, REGISTERS).all(1)
        out.ravel()[cell[won]] = h[index[won]]
        todo &= ~filled
        horizon = np.where(todo, horizon * 2, horizon)
    return out


def signature(h: np.ndarray) -> np.ndarray:
    return signatures(np.array([0, len(h)]), h)[0]


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (h sorted and distinct)."""
    both = np.intersect1d(ha, hb, assume_unique=True)
    if not len(both):
        return 0.0
    ia, ib = np.searchsorted(ha, both), np.searchsorted(hb, both)
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    # For shared i: 1 / sum_j max(x_j / x_i, y_j / y_i); elements on one side only add to that side's sum.
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    above = np.cumsum(x[::-1])[::-1]  # j with x_j / y_j not below that of i count by x
    below = np.cumsum(y) - y
    return float((1.0 / ((above + only_a) / x + (below + only_b) / y)).sum())


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, count = np.unique(h, return_counts=True)
    return keys, count


@frugal
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for b in batches:
        for a, borders, h, counts in shingles(b.column(1)):
            n = len(borders) - 1
            ordinal = (np.arange(len(h)) - np.repeat(borders[:-1], np.diff(borders))).astype(np.uint64)
            parts = mixed(h + ordinal * np.uint64(0xC2B2AE3D27D4EB4F))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(parts, dtype=np.uint64)])
            key = mixed(sums[borders[1:]] - sums[borders[:-1]] + counts.astype(np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(parts ^ SEED), dtype=np.uint64)])
            packed = np.stack([key, sums[borders[1:]] - sums[borders[:-1]]], 1).tobytes()
            keys = [packed[16 * i : 16 * i + 16] for i in range(n)]
            keep = np.zeros(n, bool)
            for i, k in enumerate(keys):  # a copy in this task: its signature is already made
                keep[i] = borders[i] < borders[i + 1] and k not in seen
                if len(seen) < 500_000:
                    seen.add(k)
            rows = np.flatnonzero(keep)
            size = np.diff(borders)
            made = signatures(np.concatenate([[0], np.cumsum(size[rows])]), h[np.repeat(keep, size)])
            sigs: list[bytes | None] = [None] * n
            sets: list[bytes | None] = [None] * n
            for i, row in zip(rows.tolist(), made, strict=True):
                sigs[i] = row.astype(np.uint32).tobytes()
                sets[i] = np.sort(h[borders[i] : borders[i + 1]].astype(np.uint32)).tobytes()
            empty = np.diff(borders) == 0
            kept = [c.slice(a, n) for i, c in enumerate(b.columns) if i != 1]
            names = [c for i, c in enumerate(b.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.binary(), mask=empty), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary()), pa.array(counts, pa.int64())], names=[*names, "class_key", "sig", "shingles", "n_words"])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return weighted(np.frombuffer(data, np.uint32))


def _search(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """a, b, similarity: verified links of a block, as many as it takes to connect it.

    Every pair that isn't connected yet, that has no earlier block in common and that may reach the
    threshold by its signatures is verified exactly.
    """
    pdf = pdf.sort_values("class_key", kind="stable").drop_duplicates("class_key")
    band, g = int(pdf["band"].iloc[0]), len(pdf)
    keys, guest = pdf["class_key"].to_numpy(), pdf["guest"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(g, REGISTERS)
    cells = np.zeros((g, BANDS), np.int64)
    for i, m in enumerate(pdf["cells"]):
        for k, v in m.items() if isinstance(m, dict) else m:
            cells[i, k] = v
    sets: list[tuple[np.ndarray, np.ndarray] | None] = [None] * g
    packed = pdf["shingles"].to_list()
    label = np.arange(g)
    rows = []
    for i in range(1, g):
        other = np.flatnonzero(label[:i] != label[i])
        if band and len(other):
            met = ((cells[other, :band] == cells[i, :band]) & (cells[i, :band] != 0)).any(1)
            other = other[~met | guest[other] | guest[i]]
        same = (sig[other] == sig[i]).mean(1)
        for j in other[np.argsort(-same, kind="stable")[: int((same >= LIKELY).sum())]].tolist():
            if label[j] == label[i]:
                continue
            for k in (i, j):
                if sets[k] is None:
                    sets[k] = _unpacked(packed[k])
            s = similarity(*sets[j], *sets[i])
            if s >= threshold - 1e-12:
                rows.append((keys[j], keys[i], s))
                label[label == label[j]] = label[i]
    return pd.DataFrame(rows, columns=["a", "b", "similarity"]).astype({"similarity": "float64"})


def _cross(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """a, b, similarity: verified links of a cell of the grid, between its outer members and all its others.

    Left out are pairs of one class by the links so far, and pairs that share the bucket of an earlier band.
    """
    pdf = pdf.sort_values(["outer", "class_key"], kind="stable").reset_index(drop=True)
    band, g = int(pdf["band"].iloc[0]), len(pdf)
    inner = int((~pdf["outer"]).sum())
    keys = pdf["class_key"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(g, REGISTERS)
    cells = np.zeros((g, BANDS), np.int64)
    for i, m in enumerate(pdf["cells"]):
        for k, v in m.items() if isinstance(m, dict) else m:
            cells[i, k] = v
    sets: list[tuple[np.ndarray, np.ndarray] | None] = [None] * g
    packed = pdf["shingles"].to_list()
    label = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
    rows = []
    for i in range(inner, g):
        other = np.flatnonzero(label[:inner] != label[i])
        if band and len(other):
            met = ((cells[other, :band] == cells[i, :band]) & (cells[i, :band] != 0)).any(1)
            other = other[~met]
        same = (sig[other] == sig[i]).mean(1)
        for j in other[np.argsort(-same, kind="stable")[: int((same >= LIKELY).sum())]].tolist():
            if label[j] == label[i]:
                continue
            for k in (i, j):
                if sets[k] is None:
                    sets[k] = _unpacked(packed[k])
            s = similarity(*sets[j], *sets[i])
            if s >= threshold - 1e-12:
                rows.append((keys[j], keys[i], s))
                label[label == label[j]] = label[i]
    return pd.DataFrame(rows, columns=["a", "b", "similarity"]).astype({"similarity": "float64"})


@frugal
def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.array([similarity(*_unpacked(x), *_unpacked(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
        keep = pa.array(s >= threshold - 1e-12, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(s, pa.float64()).filter(keep)], names=["a", "b", "similarity"])


def links(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity: verified links between class keys that connect each class of near duplicates.

    signed is the table of _signed.
    """
    spark = signed.sparkSession
    once = signed.where("sig IS NOT NULL")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("sig"), i * (ROWS * 4) + 1, F.lit(ROWS * 4))).alias("h")))
    cells = once.select("class_key", F.explode(bands).alias("x")).select("class_key", F.col("x.band").alias("band"), F.col("x.h").alias("h")).distinct()
    sizes = cells.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("class_key").alias("low"), F.max("class_key").alias("high")).where("n > 1")
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "buckets")
    # Most buckets are pairs, and a pair met in many bands is verified once.
    pairs = sizes.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    block = F.pmod(F.xxhash64("class_key", "band"), F.col("blocks")).cast("int")
    busy = cells.join(sizes.where("n > 2").select("band", "h", "blocks"), ["band", "h"]).select("band", "h", "blocks", block.alias("block"), "class_key")
    busy = written(busy, "busy")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class_key")).unionByName(busy.select("class_key")).distinct()
    sets = written(once.join(needed, "class_key", "left_semi").select("class_key", "sig", "shingles").dropDuplicates(["class_key"]), "sets")
    of = busy.groupBy("class_key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.xxhash64("band", "h", "block")))).alias("cells"))
    # Some members of a bucket of several blocks, those of least key by hash, are guests in all its blocks.
    few = busy.where("blocks > 1").groupBy("band", "h", "blocks", F.pmod(F.xxhash64("class_key"), F.lit(HUBS)).alias("s")).agg(F.min("class_key").alias("class_key"))
    guests = few.select("band", "h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class_key", F.lit(True).alias("guest"))
    members = busy.select("band", "h", "block", "class_key", F.lit(False).alias("guest")).unionByName(guests)
    dealt = members.join(sets.join(of, "class_key"), "class_key").select("band", "h", "block", "guest", "class_key", "cells", "sig", "shingles")
    found = dealt.groupBy("band", "h", "block").applyInPandas(_searcher(threshold), LINK)
    left = sets.select(F.col("class_key").alias("a"), F.col("shingles").alias("sa"))
    right = spark.read.schema(sets.schema).parquet(sets._corpusloom_path).select(F.col("class_key").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    out = written(both.mapInArrow(lambda it: _verified(it, threshold), LINK).unionByName(found), "links")
    if sizes.where("blocks > 1").limit(1).count():
        first = out
        out = written(first.unionByName(_between(first, busy, sets, threshold)), "links")
        drop_written(first)
    for t in (sets, busy, sizes):
        drop_written(t)
    return out


LINK = "a binary, b binary, similarity double"


def _searcher(threshold: float, search=_search):
    return lambda pdf: search(pdf, threshold)


def _between(first: DataFrame, busy: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between members of buckets of several blocks that the first links leave apart."""
    roots = components(first)
    crowded = busy.where("blocks > 1").join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
    crowded = written(crowded.withColumn("root", F.coalesce("root", "class_key")), "crowded")
    # Of two members of different classes one at least is outside the largest class.
    per = crowded.groupBy("band", "h", "root").agg(F.count("*").alias("c"))
    per = per.groupBy("band", "h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("top"), F.sum("c").alias("n")).where("top < n")
    apart = broadcast_if_small(written(per.select("band", "h", "main", F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int").alias("parts")), "apart"))
    rows = crowded.join(apart, ["band", "h"])
    part = F.pmod(F.xxhash64("class_key", "band"), F.col("parts")).cast("int")
    all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    inner = rows.select("band", "h", "block", all_("parts").alias("part"), "class_key", "root", F.lit(False).alias("outer"))
    outer = rows.where("root <> main").select("band", "h", all_("blocks").alias("block"), part.alias("part"), "class_key", "root", F.lit(True).alias("outer"))
    of = busy.groupBy("class_key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.xxhash64("band", "h")))).alias("cells"))
    dealt = inner.unionByName(outer).join(sets.join(of, "class_key"), "class_key")
    dealt = dealt.select("band", "h", "block", "part", "outer", "class_key", "root", "cells", "sig", "shingles")
    return dealt.groupBy("band", "h", "block", "part").applyInPandas(_searcher(threshold, _cross), LINK)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        spark = edges.sparkSession
        again = spark.read.schema(label.schema).parquet(label._corpusloom_path)
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("root", "m").alias("low"), F.col("root").alias("old"))
        # Jump: the root's own new label, as far as it is known.
        jump = step.join(again.select(F.col("node").alias("low"), F.col("root").alias("up")), "low", "left")
        new = written(jump.select("node", F.least("low", F.coalesce("up", "low")).alias("root"), "old"), "labels")
        changed = new.where("root <> old").limit(1).count()
        drop_written(label)
        label = new
        if not changed:
            drop_written(both)
            return label.select("node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_key, class_id, n_words and the carried columns: one row for each row of docs.

    class_key is the same for texts with the same words, class_id for texts connected by links; both are
    null for wordless texts.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in carried])
    schema = StructType([rows.schema["doc_id"], *rows.schema.fields[2:], *_schema("class_key binary, sig binary, shingles binary, n_words long")])
    signed = written(rows.mapInArrow(_signed, schema), "signed")
    roots = components(links(signed, threshold)).withColumnRenamed("node", "class_key")
    return attach(signed, roots, "class_key").select("doc_id", *carried, "class_key", F.coalesce("root", "class_key").alias("class_id"), "n_words")


def _schema(text: str) -> list:
    return StructType.fromDDL(text).fields
