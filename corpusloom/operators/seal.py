"""Keyed seal of a manifest (path, sha256): a digest in two levels that only the key's holder can make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dedup import manifest_difference

#: Parts of a manifest: each is put in order and digested by itself.
PARTS = 4096
_BLOCK = 64


def keyed_digest(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string as 64 hexadecimal digits."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def canonical(manifest: DataFrame, parts: int = PARTS) -> DataFrame:
    """digest: one row for a manifest, whatever the order of its rows. Paths are told apart byte by byte.

    Paths fall by their SHA-256 into parts; the digest of a part is that of its lines in order, that of the manifest that of the
    digests of all parts in order. So no task holds the manifest, and the last one holds `parts` lines.
    """
    part = F.pmod(F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
    line = F.concat(F.col("path"), F.char(F.lit(0)), F.col("sha256"))
    lines = manifest.groupBy(part.alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("m"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.sha2("m", 256).alias("d")))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["d"])), "\n")
    return lines.agg(F.sha2(joined, 256).alias("digest"))


def seal(manifest: DataFrame, key: bytes, parts: int = PARTS) -> DataFrame:
    """digest, mac: the lock of a manifest."""
    return canonical(manifest, parts).withColumn("mac", keyed_digest(F.col("digest"), key))


def verify(now: DataFrame, locked: DataFrame, mac: str, key: bytes | None, parts: int = PARTS) -> DataFrame:
    """lock_ok, changes, ok: first whether the locked manifest is the sealed one (without a key that isn't asked), then how many paths differ."""
    made = seal(locked, key, parts).select((F.col("mac") == mac).alias("lock_ok")) if key is not None else locked.agg(F.lit(True).alias("lock_ok"))
    changes = manifest_difference(locked, now).agg(F.count("*").alias("changes"))
    return made.crossJoin(changes).withColumn("ok", F.col("lock_ok") & (F.col("changes") == 0))  # one row each
