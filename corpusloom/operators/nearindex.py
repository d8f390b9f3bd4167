"""Near fingerprints by selective keys, and an index of them that is kept up from batch to batch.

A 64-bit fingerprint is cut into seven blocks; two fingerprints that differ in three bits at most agree in four blocks
at least. Each choice of four blocks is a table (35 of them), its key the 36 or 37 bits of these blocks: two
unrelated fingerprints meet in a table with a chance of 2**-36, so candidates grow with the documents. A pair is
taken in the first table whose blocks agree, and so just once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import broadcast_if_small, shuffled, written

DISTANCE = 3
#: First bit and width of each block.
BLOCKS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
TABLES = tuple(combinations(range(7), 4))
#: Fingerprints of a key beyond which they are dealt into blocks.
HOT = 1024


def as_long(simhash: Column) -> Column:
    """The 64 bits of 16 hexadecimal digits."""
    half = lambda i: F.conv(F.substring(simhash, i, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _block(x: Column, b: int) -> Column:
    at, width = BLOCKS[b]
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


#: The number of its table begins at this bit of a key; 37 are below it at most.
TABLE_BIT = 40


def keys(x: Column) -> Column:
    """The 35 keys of a fingerprint."""
    out = []
    for t, choice in enumerate(TABLES):
        bits = _block(x, choice[0])
        for b in choice[1:]:
            bits = F.shiftleft(bits, BLOCKS[b][1]).bitwiseOR(_block(x, b))
        out.append(bits.bitwiseOR(F.lit(t << TABLE_BIT).cast("long")))
    return F.array(*out)


def near(a: Column, b: Column, key: Column) -> Column:
    """Whether two fingerprints that share a key are near, and the key's table is the first that they share."""
    x = a.bitwiseXOR(b)
    agree = sum((F.when(_block(x, i) == 0, 1 << i).otherwise(0) for i in range(7)), F.lit(0))
    first = [next((t for t, c in enumerate(TABLES) if all(m >> i & 1 for i in c)), -1) for m in range(128)]
    return (F.bit_count(x) <= DISTANCE) & (F.get(F.array(*map(F.lit, first)), agree) == F.shiftrightunsigned(key, TABLE_BIT))


def keyed(prints: DataFrame) -> DataFrame:
    """id, x, k: a row for each key of prints (id, simhash)."""
    return prints.select("id", as_long(F.col("simhash")).alias("x")).select("id", "x", F.explode(keys(F.col("x"))).alias("k"))


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, id_a, x_a, id_b, x_b: rows (id, x, k) of a and b that share a key. Keys with over HOT rows of b are met in blocks.

    Spark takes a side for as large as the fingerprints that its 35 keys each come from, so the joins are by shuffle.
    """
    left, right = (df.select("k", F.col("id").alias(f"id_{s}"), F.col("x").alias(f"x_{s}")) for df, s in ((a, "a"), (b, "b")))
    sizes = written(right.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("k", F.ceil(F.col("n") / HOT).cast("int").alias("nb")), "hot")
    if sizes.isEmpty():
        return left.join(shuffled(right), "k")
    hot = broadcast_if_small(sizes)
    dealt = lambda df, i: df.join(hot, "k").withColumn(f"part_{i[-1]}", F.pmod(F.xxhash64(i), F.col("nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    met = dealt(left, "id_a").withColumn("part_b", others).drop("nb").join(shuffled(dealt(right, "id_b").withColumn("part_a", others).drop("nb")), ["k", "part_a", "part_b"])
    plain = left.join(hot.select("k"), "k", "left_anti").join(shuffled(right.join(hot.select("k"), "k", "left_anti")), "k")
    return plain.unionByName(met.drop("part_a", "part_b"))


def pairs(prints: DataFrame) -> DataFrame:
    """id_a < id_b, distance: near pairs of the first documents of each fingerprint. prints: id, simhash."""
    first = written(prints.groupBy("simhash").agg(F.min("id").alias("id")), "first")
    again = prints.sparkSession.read.schema(first.schema).parquet(first._corpusloom_path)
    met = candidates(keyed(first), keyed(again)).where("id_a < id_b").where(near(F.col("x_a"), F.col("x_b"), F.col("k")))
    return met.select("id_a", "id_b", F.bit_count(F.col("x_a").bitwiseXOR(F.col("x_b"))).cast("int").alias("distance"))


def near_stored(prints: DataFrame, stored: DataFrame) -> DataFrame:
    """id, of: documents (id, simhash) near a stored one, with the first such (least seq, then id). stored: id, x, k, seq."""
    met = candidates(keyed(prints), stored).where(near(F.col("x_a"), F.col("x_b"), F.col("k")))
    met = met.join(shuffled(stored.select(F.col("id").alias("id_b"), "k", "seq")), ["id_b", "k"]) if "seq" in stored.columns else met.withColumn("seq", F.lit(0).cast("long"))
    return met.groupBy(F.col("id_a").alias("id")).agg(F.min(F.struct("seq", F.col("id_b").alias("of"))).alias("m")).select("id", "m.of")


class NearIndex:
    """Keys of the documents kept so far, as a table partitioned by band and part.

    A band holds the keys of one residue of their hash. A batch reads the bands of its own keys and no others, and adds its
    kept documents as partitions of its own; a batch that runs again replaces what it wrote. merge() puts the parts of many
    batches into one; a key that is in two parts does no harm, so a merge that is cut short loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, bands: int = 256):
        self.spark, self.path, self.bands = spark, path.rstrip("/"), bands

    def _band(self) -> Column:
        return F.pmod(F.xxhash64("k"), F.lit(self.bands)).cast("int").alias("band")

    def bands_of(self, prints: DataFrame) -> list[int]:
        """The bands that a batch touches: at most `bands` numbers."""
        return sorted(r["band"] for r in keyed(prints).select(self._band()).distinct().collect())

    def stored(self, only: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """id, x, k, seq of the bands named, from batches other than `before`; null before the first batch."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        rows = self.spark.read.schema("id long, x long, k long, seq long, band int, part long").parquet(self.path)
        if only is not None:
            rows = rows.where(F.col("band").isin(only))
        return (rows if before is None else rows.where(F.col("seq") != before)).select("id", "x", "k", "seq")

    def admit(self, prints: DataFrame, seq: int) -> DataFrame:
        """id, duplicate_of of a batch (id, simhash), as if its documents were read one after the other behind all stored ones.

        Documents near a stored one are dropped and so keep no other one out; the rest are compared with one another, and
        those that stay are added under seq, the batch's number.
        """
        from corpusloom.operators.dedup import keep_first

        prints = written(prints.select("id", "simhash"), "batch")
        stored = self.stored(self.bands_of(prints), seq)
        known = written(near_stored(prints, stored), "known") if stored is not None else self.spark.createDataFrame([], "id long, of long")
        known = broadcast_if_small(known)
        fresh = written(prints.join(known, "id", "left_anti"), "fresh")
        among = keep_first(fresh).select("id", "duplicate_of")
        out = written(prints.join(known, "id").select("id", F.col("of").alias("duplicate_of")).unionByName(among), "admitted")
        self.add(fresh.join(broadcast_if_small(out.where("duplicate_of IS NOT NULL").select("id")), "id", "left_anti"), seq)
        return out

    def add(self, kept: DataFrame, seq: int) -> None:
        self._put(keyed(kept).select("id", "x", "k", F.lit(seq).cast("long").alias("seq"), self._band(), F.lit(seq).cast("long").alias("part")))

    def _put(self, rows: DataFrame) -> None:
        rows.repartition("band").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band", "part").parquet(self.path)

    def merge(self, upto: int) -> int:
        """Put the parts of all batches up to number `upto` into one part of each band; returns how many folders went.

        Not to run beside a batch that reads the index: the folders of the merged parts are removed at the end.
        """
        if self.stored() is None:
            return 0
        new = -1 - upto  # parts of merges are negative, those of batches are their number
        rows = self.spark.read.schema("id long, x long, k long, seq long, band int, part long").parquet(self.path)
        old = rows.where((F.col("part") <= upto) & (F.col("part") != new))
        again = rows.where(F.col("part") == new)  # of a merge that was cut short
        self._put(written(old.unionByName(again).select("id", "x", "k", "seq", "band").distinct(), "merged").withColumn("part", F.lit(new).cast("long")))
        gone = 0
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/band=*/part=*")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for folder in files.globStatus(where):  # names only: bands times parts
            part = int(folder.getPath().getName().removeprefix("part="))
            if part <= upto and part != new:
                gone += bool(files.delete(folder.getPath(), True))
        return gone
