"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups sorted by size enter the bin with the tightest remaining capacity that still holds them, found in
a balanced tree (a treap) over remaining capacities; a new bin opens where none does. `least_capacity`
finds the smallest capacity at which that needs no more than the wanted number of bins, so that the
shards come out near equal.

At scale no list of all groups exists in one place. A group of more than total/(shards*UNITS) bytes is a
unit of its own; arithmetic leaves at most shards*UNITS of those. All smaller groups fall by hash into
shards*UNITS buckets, and each bucket is a unit: groups stay whole either way. Only these units, a
fixed number, are packed on the driver; documents find their unit by broadcast join on that bounded
table. A group larger than a fair share takes a shard alone, since it may not be divided.

Slots count from 0 without gaps in each shard. Equal rows are counted first; the different ones fall into
buckets of about `SLOT_ROWS` rows of a shard, and a slot is the rows of the buckets before, and of the
rows before in its own: no task sees a whole shard, and equal rows are no group that one task must hold.

Nulls: a null text has no bytes and is one group with the empty text. Null or repeated doc_ids are
rows like any other; equal rows get slots that follow each other. Ties of size go to the unit that is listed
first. An empty table gives no rows. Columns of docs other than the two named aren't read, whatever
their names. Of a very long text only size and hashes are used.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small

#: Units to a shard: at least so many large groups or buckets of small ones make up each shard.
UNITS = 200
#: Rows of a shard to a bucket in which slots are counted.
SLOT_ROWS = 50_000


class Treap:
    """A balanced tree of distinct (remaining, bin) keys: insert, delete, least key at or above."""

    def __init__(self, seed: int = 0):
        self._root = None
        self._random = random.Random(seed)

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = Treap._merge(a[3], b)
            return a
        b[2] = Treap._merge(a, b[2])
        return b

    @staticmethod
    def _split(node, key):
        """(keys < key, keys >= key)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = Treap._split(node[3], key)
            return node, right
        left, node[2] = Treap._split(node[2], key)
        return left, node

    def insert(self, key) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._random.random(), None, None]), right)

    def take_ceiling(self, key):
        """Remove and return the least key >= key, or None."""
        left, right = self._split(self._root, key)
        found = None
        if right is not None:
            first = right
            while first[2] is not None:
                first = first[2]
            found = first[0]
            _, right = self._split(right, (found[0], found[1] + 1))
        self._root = self._merge(left, right)
        return found


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each size, number of bins). A size above the capacity gets a bin of its own."""
    bins, where, tree = 0, [0] * len(sizes), Treap()
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.take_ceiling((sizes[i], -1)) if sizes[i] <= capacity else None
        if at is None:
            at, bins = (capacity, bins), bins + 1
        where[i] = at[1]
        if at[0] > sizes[i]:
            tree.insert((at[0] - sizes[i], at[1]))
    return where, bins


def least_capacity(sizes: Sequence[int], shards: int) -> list[int]:
    """The bin of each size at the least capacity found for which best fit needs at most `shards` bins."""
    if not sizes:
        return []
    # No capacity is below a fair share of what is left when groups above it have a bin each.
    rest, bins_left = sorted(sizes), shards
    while bins_left > 1 and rest[-1] * bins_left > sum(rest):
        rest.pop()
        bins_left -= 1
    low, high = max(1, -(-sum(rest) // bins_left)), max(sum(sizes), 1)
    best = [0] * len(sizes)
    while low <= high:
        mid = (low + high) // 2
        where, bins = best_fit_decreasing(sizes, mid)
        if bins <= shards:
            best, high = where, mid - 1
        else:
            low = mid + 1
    return best


def lightest_first(sizes: Sequence[int], shards: int) -> list[int]:
    """Longest-processing-time assignment, for comparison in tests."""
    heap, where = [(0, b) for b in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, b = heapq.heappop(heap)
        where[i] = b
        heapq.heappush(heap, (load + sizes[i], b))
    return where


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus overhead), text_crc32, shard, slot: one row for each row of docs."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("g1"),
        F.hash(body).alias("g2"),
    )
    units = shards * UNITS
    # Equal texts agree on 128 bits: two hashes, the checksum and the size.
    group = ["g1", "g2", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large_over = total // units
    bucket = F.pmod(F.xxhash64("g1", "g2", "size"), F.lit(units)).cast("int")
    parts = groups.select(
        F.when(F.col("bytes") > large_over, F.struct(*group)).alias("own"),
        F.when(F.col("bytes") <= large_over, bucket).alias("bucket"),
        "bytes",
    )
    listed = parts.groupBy("own", "bucket").agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * units rows
    listed.sort(key=lambda r: (r["bucket"] is None, r["bucket"] or 0, tuple(r["own"] or ())))
    where = least_capacity([int(r["bytes"]) for r in listed], shards)
    spark = docs.sparkSession
    own = [(*r["own"], s) for r, s in zip(listed, where, strict=True) if r["own"] is not None]
    by_bucket = [0] * units
    for r, s in zip(listed, where, strict=True):
        if r["own"] is None:
            by_bucket[r["bucket"]] = s
    placed = rows.withColumn("bucket", bucket)
    small = F.element_at(F.array(*map(F.lit, by_bucket)), F.col("bucket") + 1) if units <= 64 else None
    if small is None:
        table = spark.createDataFrame(list(enumerate(by_bucket)), "bucket int, bucket_shard int")
        placed = placed.join(F.broadcast(table), "bucket")  # units rows
        small = F.col("bucket_shard")
    if own:
        table = spark.createDataFrame(own, "g1 long, g2 int, text_crc32 long, size long, own_shard int")
        placed = placed.join(F.broadcast(table), group, "left")  # at most units rows
        small = F.coalesce("own_shard", small)
    buckets = max(1, -(-n_rows // (shards * SLOT_ROWS)))
    placed = placed.withColumn("shard", small).groupBy("doc_id", "shard", *group).agg(F.count("*").alias("n"))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(buckets)).cast("long"))
    # About rows / SLOT_ROWS rows, with the rows of the buckets before.
    counts = placed.groupBy("shard", "b").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(counts.select("shard", "b", before.alias("start")))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "b").orderBy("doc_id", "size", "text_crc32", "g1", "g2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.withColumn("i", own).join(starts, ["shard", "b"])
    slots = F.explode(F.sequence(F.col("start") + F.col("i"), F.col("start") + F.col("i") + F.col("n") - 1))
    return found.select("doc_id", "size", "text_crc32", "shard", slots.alias("slot"))
