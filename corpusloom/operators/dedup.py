"""Fingerprints, near-duplicate removal in reading order, and verbatim containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import nearindex
from corpusloom.sources.tables import BROADCAST_ROWS, broadcast_if_small, drop_written, shuffled, written

#: Most 3-grams that are told apart and summed up at once.
AT_ONCE = 1 << 16
PROBE, STRIDE = 50, 25


@lru_cache(1 << 18)
def _gram(g: str) -> bytes:
    return hashlib.md5(g.encode()).digest()[:8]


def simhash_hex(text: str | None, most: int | None = None) -> str:
    """64 signs of summed hash bits of all 3-grams of the text without white space; of evenly spaced ones, about `most`, if that is given."""
    z = "".join((text or "").split())
    if len(z) < 3:
        return _gram(z).hex()
    c = np.frombuffer(z.encode("utf-32-le"), "<u4").astype(np.uint64)
    step = max(1, (len(z) - 2) // most) if most else 1
    grams = (c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))[::step]
    total = np.zeros(64)
    for a in range(0, len(grams), AT_ONCE):
        _, at, times = np.unique(grams[a : a + AT_ONCE], return_index=True, return_counts=True)
        hashes = b"".join([_gram(z[i : i + 3]) for i in ((at + a) * step).tolist()])
        total += times @ np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    return np.packbits(total * 2 > len(grams)).tobytes().hex()


def with_simhash(docs: DataFrame, text: str = "text", name: str = "simhash", most: int | None = None) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([simhash_hex(t, most) for t in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, name])

    from pyspark.sql.types import StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def hamming(a: Column, b: Column) -> Column:
    """Distance of two 16-digit hexadecimal fingerprints."""
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def near_pairs(prints: DataFrame) -> DataFrame:
    """id_a < id_b, distance <= 3, between the first documents of each fingerprint. prints: id, simhash."""
    return nearindex.pairs(prints)


def near_links(prints: DataFrame) -> DataFrame:
    """id_a, id_b, distance: the near pairs of the first documents of each fingerprint, and at distance 0 each other document behind its first.

    Documents are near if they, or the first ones that they stand behind, are the same or a pair.
    """
    firsts = prints.groupBy("simhash").agg(F.min("id").alias("id_a"))
    behind = prints.select(F.col("id").alias("id_b"), "simhash").join(shuffled(firsts), "simhash").where("id_b != id_a")
    return near_pairs(prints).unionByName(behind.select("id_a", "id_b", F.lit(0).alias("distance")))


def keep_first(prints: DataFrame) -> DataFrame:
    """id, duplicate_of: as if documents were read in the order of id and dropped when near one already kept.

    A fixpoint: who has no earlier near document is kept, who is near a kept one is dropped, and so on. Each
    round is two joins on the near pairs; documents of one fingerprint follow its first.
    """
    first = prints.groupBy("simhash").agg(F.min("id").alias("first"))
    pairs = written(near_pairs(prints), "pairs")
    state = written(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while state.where("kept IS NULL").limit(1).count():
        earlier = pairs.join(shuffled(state.select(F.col("id").alias("id_a"), "kept")), "id_a").groupBy("id_b").agg(F.min(F.when(F.col("kept"), F.col("id_a"))).alias("near"), F.max(F.col("kept").isNull().cast("int")).alias("open"))
        open_ = F.coalesce("open", F.lit(0)) == 1
        new = state.join(earlier, state["id"] == earlier["id_b"], "left").select(
            "id",
            F.when(F.col("kept").isNotNull(), F.col("kept")).when(open_, F.when(F.col("near").isNotNull(), F.lit(False))).otherwise(F.col("near").isNull()).alias("kept"),
        )
        new = written(new, "state")
        drop_written(state)
        state = new
    # A document can be dropped while earlier neighbours are open; the least kept one is known at the end.
    kept = shuffled(state.where("kept").select(F.col("id").alias("id_a")))
    dropped = broadcast_if_small(written(pairs.join(kept, "id_a").groupBy(F.col("id_b").alias("first")).agg(F.min("id_a").alias("of")), "dropped"))
    out = prints.join(shuffled(first), "simhash").join(dropped, "first", "left")
    return out.select("id", F.coalesce("of", F.when(F.col("id") != F.col("first"), F.col("first"))).alias("duplicate_of"))


#: Multiplier of the rolling hash of a window, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(text: str | None, width: int = PROBE) -> np.ndarray:
    """64 bits for the window of `width` characters at each place of a text; equal windows have equal ones."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < width:
        return np.zeros(0, np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * _powers(_BASE, len(c)), dtype=np.uint64)])
    return (upto[width:] - upto[:-width]) * _powers(_BACK, len(c) - width + 1)


def window_index(items: DataFrame, text: str = "text") -> DataFrame:
    """Distinct PROBE-character windows, STRIDE apart; texts shorter than that have none."""
    t = F.col(text)
    starts = F.when(F.length(t) >= PROBE, F.sequence(F.lit(1), F.length(t) - PROBE + 1, F.lit(STRIDE)))
    return items.select(F.explode(F.transform(starts, lambda i: F.substring(t, i, F.lit(PROBE)))).alias("w")).distinct()


def window_hits(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """doc_id, hits: how many windows of a text, one at each character, are in the index (w); a row for each text with hits.

    Windows are told apart by a rolling hash, and those that may be in the index by their text. A small index (counted in
    rows, each of PROBE characters) travels to the tasks; a larger one is joined to the hashes. Rows with one doc_id stay
    apart. every: texts without hits have a row as well, and null and short texts count as such.
    """
    index = written(index.select("w"), "windows")
    small = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if small:
        known = frozenset(r["w"] for r in index.collect())  # at most BROADCAST_ROWS * PROBE characters
        marks = np.unique(np.array([rolling(w)[0] for w in known], np.uint64)) if known else np.zeros(0, np.uint64)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = []
                for t in b.column(1).to_pylist():
                    h = rolling(t)
                    at = np.flatnonzero(marks[np.minimum(np.searchsorted(marks, h), len(marks) - 1)] == h) if len(marks) else ()
                    hits.append(sum(t[i : i + PROBE] in known for i in at))
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.int64())], names=["doc_id", "hits"])
                yield out if every else out.filter(pa.array([h > 0 for h in hits]))

        return rows.mapInArrow(count, f"doc_id {kind}, hits long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(rolling(w)[0]) for w in b.column(0).to_pylist()], pa.uint64()).view(pa.int64())], names=["w", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row += 1
                h = rolling(t).view(np.int64)
                for a in range(0, max(1, len(h)), 65_536):
                    part = h[a : a + 65_536]
                    w = [t[i : i + PROBE] for i in range(a, a + len(part))]
                    lone = [] if len(part) or not every else [None]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * (len(w) or len(lone)), b.schema.field(0).type), pa.array([row] * (len(w) or len(lone)), pa.int64()), pa.array(w or lone, pa.string()), pa.array(part if len(part) else lone, pa.int64())], names=["doc_id", "row", "w", "h"])

    windows = rows.mapInArrow(cut, f"doc_id {kind}, row long, w string, h long")
    marked = index.mapInArrow(hashed, "w string, h long").withColumn("found", F.lit(1))
    met = windows.join(marked, ["h", "w"], "left" if every else "inner")
    return met.groupBy("doc_id", "row").agg(F.count("found").alias("hits")).drop("row")


def manifest_difference(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (added, removed or changed) between two manifests of path and sha256."""
    both = sealed.select("path", F.col("sha256").alias("a")).join(now.select("path", F.col("sha256").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def without_known(prints: DataFrame, stored: DataFrame) -> DataFrame:
    """id, duplicate_of: new documents (id, simhash) against stored ones (id, simhash) and each other; stored ids come first.

    Stored documents are met by key and not paired among themselves; `NearIndex` keeps their keys.
    """
    prints = written(prints.select("id", "simhash"), "batch")
    known = written(nearindex.near_stored(prints, nearindex.keyed(stored)), "known")
    fresh = written(prints.join(broadcast_if_small(known), "id", "left_anti"), "fresh")
    return known.select("id", F.col("of").alias("duplicate_of")).unionByName(keep_first(fresh))
