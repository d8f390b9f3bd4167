"""What the operators of this subpackage share: workers that find the package, tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import broadcast_if_small, drop_written, written

#: Most rows and bytes of an Arrow batch; a longer row is a batch of its own.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

__all__ = ["again", "attach", "broadcast_if_small", "drop_written", "frugal", "give_back", "prepare", "text_key", "written"]


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, and would keep what the task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def frugal(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """work over a task's batches, with freed memory given back at its end."""

    @wraps(work)
    def run(*args):
        try:
            yield from work(*args)
        finally:
            give_back()

    return run


def again(df: DataFrame) -> DataFrame:
    """A table of written() read once more: for a plan that has it on both sides."""
    return df.sparkSession.read.schema(df.schema).parquet(df._corpusloom_path)


#: A key with at least so many rows, and at least this share of all, is looked up by broadcast.
HOT_ROWS, HOT_SHARE = 1000, 0.001


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined with a table that has a key once; both are written tables.

    A table that isn't small is joined by a shuffle, but for its frequent keys: of them there are at most 1 / HOT_SHARE, and they are
    broadcast. Rows without a key aren't shuffled.
    """
    small = broadcast_if_small(table)
    if small is not table:
        return rows.join(small, key, "left")
    at_least = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = again(rows).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= at_least).select(key)
    hot = F.broadcast(written(hot, "hot"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != key]
    frequent = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    others = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table, key, "left")
    keyless = rows.where(F.col(key).isNull()).select(key, *[c for c in rows.columns if c != key], *none)
    return frequent.unionByName(others).unionByName(keyless)


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, and bound what they get at a time."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    for key, most in ARROW_BATCH.items():
        if int(spark.conf.get(key).rstrip("b")) > most:
            spark.conf.set(key, most)
