"""Intermediate tables in the cluster's shared folder, and broadcasts behind a count."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AnsiIntervalType, BooleanType, DatetimeType, NumericType

#: Most rows of a side that is broadcast after it was counted.
BROADCAST_ROWS = 200_000
#: Most bytes of its columns that have no fixed width.
BROADCAST_BYTES = 48 << 20
_LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = _LOCAL
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table that written() made and that no later plan reads."""
    remove(df.sparkSession, df._corpusloom_path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch table; a session that is gone leaves it to the folder's own cleaning."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        return


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side that is joined by shuffle and not sent whole through the driver, however few bytes Spark takes it for.

    Spark guesses from the bytes of files, which are compressed, and takes no account of the rows that an explode adds.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows and bytes, else as it is.

    Rows of fixed width are bounded by their number; of others the written-out width is summed up as well.
    """
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType, DatetimeType, AnsiIntervalType))]
    few = df.limit(most + 1)
    width = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))) if wide else F.lit(0)
    rows, size = few.agg(F.count("*"), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= most_bytes else df
