"""Removal of long repeated substrings, by column-wise construction over aligned strings.

Every `length`-byte string that starts at two places of the collection is repeated; all bytes covered by a
repeated string are removed, in every place. Texts are UTF-8 bytes and strings never cross texts.

1. Anchors. In each window of `length` bytes the least hash of a `GRAM`-byte gram (the last of equal ones)
   is its anchor. Equal windows have equal anchors at equal offsets. Runs of windows with the same anchor
   form a string; it is filed under the anchor's hash. There are about two anchors to `length` bytes.
2. Anchors that occur once are dropped. Strings of equal hashes are collapsed to two of their places, the least
   and the greatest; a string with one place is taken once.
3. Column-wise construction. Those strings are laid out in columns by their distance from the anchor and
   worked on from the last column to the first: each round puts one symbol in front of every string's
   suffix, a stable sort by that symbol turns the order of the suffixes into the new one (the symbols in
   the old order are that column of the collection's transform), and the common prefixes of neighbours are
   one more than the least between their old places, or nothing where the symbols differ. A suffix with
   a common prefix of `length` with a neighbour starts a repeated window. The columns of a bucket lie one
   after another in memory, some MB, and are read once in sequence: no file outside the shared folder.
4. The repeated windows go back to all places of their strings, are merged into spans for each text, and
   are cut out.

The construction compares suffixes that start at the same column only, as equal windows are aligned by
their anchors: it is the column-wise method of the collection transform in its positional form. Over
whole texts, with as many rounds as the longest text has bytes, it would read and write the collection's
transform in each of them.

A task gets about `BUCKET` strings, all of an anchor together. An anchor with more than `MOST_STRINGS` of them
is split by windows instead: each window's hash is counted, with partial aggregation. Texts that occur
twice as a whole are handled by their hash and are worked on once.

Identity: a whole text is told by 128 bits. Whether windows of different texts are equal is settled by the
construction, over the bytes of one or two places of each string; its further places are told by the hash of the
anchor and that of all its bytes (64 bits each). A single window of a crowded anchor is told by the anchor, its
place and 64 bits.

Nulls and empty texts have no bytes. Texts shorter than `length` lose nothing. Repeated rows are copies, and
all of them are removed, as both start somewhere else too; there are no ties to settle. An empty table gives
no rows. Columns of docs other than the two that are named aren't read, whatever their names. A very long
text is anchored in runs of 2**21 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, drop_written, frugal, give_back, text_key, written
from corpusloom.llm.textbytes import blocks, prefix_hashes, span_hashes, text_bytes

LENGTH, GRAM = 400, 32
BUCKET = 4096
#: Strings of one anchor that one task lays out in columns.
MOST_STRINGS = 50_000
_POSITION_BITS = 21
SEGMENTS = "array<struct<value:bigint,start:int,n:int,left:int,h:bigint>>"


def anchors(x: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, anchor position of each window) of one run of bytes of at most 2**21 bytes."""
    n = len(x)
    h = prefix_hashes(x)
    at = np.arange(n - gram + 1)
    grams = span_hashes(h, at, at + gram)
    w = length - gram + 1
    low = np.uint64((1 << _POSITION_BITS) - 1)
    v = (grams & ~low) | (low - at.astype(np.uint64))
    m = len(v) - w + 1
    pad = -len(v) % w
    rows = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    return grams, (low - (least & low)).astype(np.int64)


def strings(x: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(value, start, n, left, h) of the strings of one text: each window belongs to exactly one."""
    parts, step = [], (1 << _POSITION_BITS) - length
    for base in range(0, max(len(x) - length + 1, 0), step):
        y = x[base : base + step + length - 1]
        grams, at = anchors(y, length, gram)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(first, len(at)))
        h = span_hashes(prefix_hashes(y), first, first + n + length - 1)
        # n and the anchor's place in the string belong to its identity.
        h = h ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((at[first] - first).astype(np.uint64) << np.uint64(40))
        parts.append((grams[at[first]].view(np.int64), first + base, n, at[first] - first, h.view(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


@frugal
def _described(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, key, n_bytes, segs: segs are the strings of a text, null for a copy in the same task."""
    seen: set[bytes] = set()
    for b in batches:
        body, offsets = text_bytes(b.column(2))
        keys = b.column(1).to_pylist()
        for a, z in blocks(offsets):
            cols, sizes, mask = [], [], []
            for i in range(a, z):
                known = keys[i] in seen
                if len(seen) < 500_000:
                    seen.add(keys[i])
                found = strings(np.zeros(0, np.uint8) if known else body[offsets[i] : offsets[i + 1]], length)
                cols.append(found)
                sizes.append(len(found[0]))
                mask.append(known)
            value, start, n, left, h = (np.concatenate(c) for c in zip(*cols, strict=True))
            struct = pa.StructArray.from_arrays([pa.array(value), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(h)], names=["value", "start", "n", "left", "h"])
            segs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct, mask=pa.array(mask))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(np.diff(offsets[a : z + 1])), segs], names=["doc_id", "key", "n_bytes", "segs"])


def range_minima(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(d[a:b]) for each pair a < b."""
    span = b - a
    level = np.zeros(len(a), np.int64)
    level[span > 1] = np.floor(np.log2(span[span > 1])).astype(np.int64)
    out = np.empty(len(a), d.dtype)
    for k in range(int(level.max(initial=0)) + 1):
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(d[a[on]], d[b[on] - (1 << k)])
        if len(d) > 1 << k:
            d = np.minimum(d[: len(d) - (1 << k)], d[1 << k :])
    return out


def repeated_windows(texts: list[bytes], left: np.ndarray, n: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For strings aligned at their anchors (at offset left), which of their n windows are in two of them."""
    m, before = len(texts), int(left.max(initial=0))
    size = np.array([len(t) for t in texts])
    first = before - left
    width = int((first + size).max(initial=0))
    ends = np.cumsum(n)
    begin, found = ends - n, np.zeros(int(n.sum()), bool)
    if not m:
        return []
    table = np.zeros((m, width), np.uint8)
    for i, t in enumerate(texts):
        table[i, first[i] : first[i] + len(t)] = np.frombuffer(t, np.uint8)
    columns = np.ascontiguousarray(table[:, ::-1].T)  # column after column, the last first, and read once in that order
    del table
    order, common = np.arange(m), np.zeros(m, np.int32)
    for column, symbol in zip(range(width - 1, -1, -1), columns, strict=True):
        inside = (column >= first) & (column < first + size)
        code = np.where(inside, symbol.astype(np.uint16), np.uint16(256))[order]  # this round's column of the transform
        place = np.argsort(code, kind="stable")
        code = code[place]
        same = np.flatnonzero((code[1:] == code[:-1]) & (code[1:] != 256))
        new = np.zeros(m, np.int32)
        new[same + 1] = range_minima(common, place[same] + 1, place[same + 1] + 1) + 1
        order, common = order[place], new
        long = np.flatnonzero(common >= length)
        if len(long):
            at = np.concatenate([order[long], order[long - 1]])
            at = at[column - first[at] < n[at]]
            found[begin[at] + column - first[at]] = True
    return np.split(found, ends[:-1])


def _construct(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """value, h, spans: the repeated windows of the strings of a bucket."""
    pdf = pdf.drop_duplicates(["value", "h", "second"]).sort_values(["value", "h", "second"], kind="stable")
    found = repeated_windows(pdf["body"].tolist(), pdf["left"].to_numpy(), pdf["n"].to_numpy(), length)
    rows = []
    for value, h, second, windows in zip(pdf["value"], pdf["h"], pdf["second"], found, strict=True):
        if not second and windows.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.view(np.int8), [0]])))
            rows.append((value, h, np.stack([edge[::2], edge[1::2] + length - 1], 1).ravel().astype(np.int32)))
    del found, pdf
    give_back()
    return pd.DataFrame(rows, columns=["value", "h", "spans"])


@frugal
def _cut_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted strings of texts: text, want array<struct<value, h, start, n, left, second, crowded>>."""
    for b in batches:
        body, offsets = text_bytes(b.column(0))
        want = b.column(1)
        where, flat = want.offsets.to_numpy(), want.values
        row = np.repeat(np.arange(len(b)), np.diff(where))
        flat = flat.slice(int(where[0]), int(where[-1] - where[0]))
        base = offsets[row] + flat.field("start").to_numpy()
        end = base + flat.field("n").to_numpy() + length - 1
        for a in range(0, len(row), 20_000):
            data = body.tobytes() if a == 0 else data
            cut = pa.array([data[p:q] for p, q in zip(base[a : a + 20_000].tolist(), end[a : a + 20_000].tolist(), strict=True)], pa.binary())
            part = flat.slice(a, 20_000)
            yield pa.RecordBatch.from_arrays([part.field(x) for x in ("value", "h", "n", "left", "second")] + [cut], names=["value", "h", "n", "left", "second", "body"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


@frugal
def _removed(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """key, n_removed, n_spans, kept_sha256 and, if asked for, what is left of the text.

    What is left as text keeps whole characters: a span is narrowed to character borders.
    """
    for b in batches:
        body, offsets = text_bytes(b.column(1))
        rows = []
        for i, flat in enumerate(b.column(2).to_pylist()):
            x = body[offsets[i] : offsets[i + 1]]
            runs = merged(np.array(flat, np.int64).reshape(-1, 2))
            kept = b"".join(x[p:q].tobytes() for p, q in zip([0, *runs[:, 1].tolist()], [*runs[:, 0].tolist(), len(x)], strict=True))
            text = None
            if keep_text:
                inner = (x & 0xC0) == 0x80
                whole = np.ones(len(x), bool)
                for p, q in runs.tolist():
                    while p < q and inner[p]:
                        p += 1
                    while p < q < len(x) and inner[q]:
                        q -= 1
                    whole[p:q] = False
                text = x[whole].tobytes().decode("utf-8", "replace")
            rows.append((int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(), text))
        n, k, sha, text = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, n_bytes; changes: key, n_removed, n_spans, kept_sha256, kept): texts not in changes lose nothing."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    source = source.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    rows = written(source.mapInArrow(lambda it: _described(it, length), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, key binary, n_bytes long, segs {SEGMENTS}"), "strings")
    copied = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes")).where((F.col("n") > 1) & (F.col("n_bytes") >= length))
    copied = written(copied.select("key", "n_bytes"), "copied")

    places = rows.where("segs IS NOT NULL").select("key", F.explode("segs").alias("s")).select("key", "s.*")
    spot = F.struct("key", "start")
    by_value = places.groupBy("value").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    shared = written(by_value.where("lo <> hi").select("value"), "anchors")
    common = written(places.join(shared, "value"), "places")
    each = common.groupBy("value", "h").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.max("n").alias("n"), F.max("left").alias("left"))
    each = written(each, "each")
    drop_written(shared)

    # Bytes of the strings under shared anchors, at one or two places each.
    spots = F.when(F.col("lo") != F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    want = each.select("value", "h", "n", "left", F.posexplode(spots).alias("p", "at")).select("value", "h", "n", "left", (F.col("p") == 1).alias("second"), "at.key", "at.start")
    crowds = want.groupBy("value").agg(F.count("*").alias("c")).where(F.col("c") > MOST_STRINGS).select("value", F.lit(True).alias("crowded"))
    crowds = broadcast_if_small(written(crowds, "crowds"))
    want = want.join(crowds, "value", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = want.groupBy("key").agg(F.collect_list(F.struct("value", "h", "start", "n", "left", "second", "crowded")).alias("want"))
    wanted = written(wanted, "wanted")
    few = source.select("key", "text").join(broadcast_if_small(wanted.select("key")), "key", "left_semi")
    few = few.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")  # copies are worked on once
    usual = F.filter("want", lambda w: ~w["crowded"])
    bodies = few.select("text", usual.alias("want")).where("size(want) > 0").mapInArrow(lambda it: _cut_strings(it, length), "value long, h long, n int, left int, second boolean, body binary")
    count = wanted.agg(F.coalesce(F.sum(F.size(usual)), F.lit(0))).first()[0]
    buckets = max(1, -(-count // BUCKET))
    bucket = F.pmod(F.hash("value"), F.lit(buckets)).cast("int")
    parts = bodies.groupBy(bucket.alias("bucket")).applyInPandas(lambda pdf: _construct(pdf, length), "value long, h long, spans array<int>")
    if crowds.limit(1).count():
        all_of = F.array(F.lit(0), (F.col("n") + (length - 1)).cast("int"))
        twice = each.where("lo <> hi").join(crowds, "value", "left_semi").select("value", "h", all_of.alias("spans"))
        parts = parts.unionByName(twice).unionByName(_by_windows(few, length))
    spans = written(parts, "spans")
    placed = common.select("key", "start", "value", "h").join(spans, ["value", "h"]).select("key", F.transform("spans", lambda p: p + F.col("start")).alias("spans"))
    cuts = placed.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cuts = written(cuts.join(copied, "key", "left_anti"), "cuts")
    for table in (common, each, wanted):
        drop_written(table)
    texts = source.select("key", "text").join(broadcast_if_small(cuts.select("key")), "key", "left_semi").join(cuts, "key")
    some = texts.mapInArrow(lambda it: _removed(it, keep_text), "key binary, n_removed long, n_spans long, kept_sha256 string, kept string")
    nothing = hashlib.sha256(b"").hexdigest()
    full = copied.select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.lit("").alias("kept"))
    return rows.select("doc_id", "key", "n_bytes"), written(some.unionByName(full), "changes")


def _by_windows(few: DataFrame, length: int) -> DataFrame:
    """As the construction, for anchors with very many strings: single windows counted by hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut_strings(batches, length):
            for value, h, n, left, _, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = prefix_hashes(np.frombuffer(body, np.uint8))
                at = np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, value)), pa.array(np.full(n, h)), pa.array((at - left).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(span_hashes(p, at, at + length).view(np.int64))], names=["value", "h", "col", "at", "w"])

    crowded = few.select("text", F.filter("want", lambda w: w["crowded"] & ~w["second"]).alias("want")).where("size(want) > 0")
    each = written(crowded.mapInArrow(windows, "value long, h long, col int, at int, w long"), "windows")
    twice = each.groupBy("value", "col", "w").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("value", "col", "w")
    hit = each.join(twice, ["value", "col", "w"]).distinct()
    return hit.groupBy("value", "h").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + length))).alias("spans"))


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text: one row for each row of docs.

    kept_text is what is left, in whole characters; the digest is that of the remaining bytes.
    """
    text = how.get("text", "text")
    _, changes = repeats(docs, keep_text=True, **how)
    own = docs.select(F.col(f"`{how.get('doc_id', 'doc_id')}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    own = own.select("doc_id", text_key(F.col("t")).alias("key"), F.octet_length("t").cast("long").alias("n_bytes"), "t")
    keys, zero = broadcast_if_small(changes.select("key")), F.lit(0).cast("long")
    same = own.join(keys, "key", "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), F.col("t").alias("kept_text"))
    cut = own.join(keys, "key", "left_semi").drop("t").join(changes, "key")
    return same.unionByName(cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("kept_text")))
