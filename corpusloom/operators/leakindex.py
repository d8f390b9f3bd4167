"""Leak index by file: windows of corpus files, kept as a table and renewed only where files changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.profile import Profile
from corpusloom.operators.dedup import PROBE, STRIDE, window_hits
from corpusloom.sources.tables import drop_written, written

#: Part of a file's mark: another number renews all of them.
VERSION = 1
#: Suffixes of files that are looked into, and the folder that isn't.
SUFFIXES = (".md", ".yaml", ".yml", ".py", ".txt", ".json", ".jsonl", ".toml")
EXEMPT = "tests/fixtures/"


def file_windows(files: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """path, w: PROBE-character windows, STRIDE apart, that hold a letter of the profile; a shorter text is one window."""
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(t) - PROBE, F.lit(0)) + 1, F.lit(STRIDE))
    cut = files.select("path", F.explode(F.transform(starts, lambda i: F.substring(t, i, F.lit(PROBE)))).alias("w"))
    return cut.where(F.col("w").rlike(f"[{profile.letter}]")).distinct()


class LeakIndex:
    """Windows by file, partitioned by the hash of the path: a changed, new or removed file rewrites its own partition and no other.

    A file counts as unchanged while its path, size and time are those of the index. Of a partition that is written anew the windows
    of unchanged files are carried over, not computed.
    """

    SCHEMA = "path string, mark string, w string, part int"

    def __init__(self, spark: SparkSession, path: str, profile: Profile, parts: int = 1024):
        self.spark, self.path, self.profile, self.parts = spark, path.rstrip("/"), profile, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def refresh(self, files: DataFrame) -> DataFrame:
        """path, change (added, changed, removed), part of what was renewed. files: path, size, mtime, text; all files that there are."""
        mark = F.concat_ws("|", F.lit(VERSION), "size", "mtime")
        now = files.withColumn("mark", mark)
        old = self.rows().where("path IS NOT NULL").select("path", F.col("mark").alias("old")).distinct()
        kind = F.when(F.col("old").isNull(), "added").when(F.col("mark").isNull(), "removed").when(F.col("old") != F.col("mark"), "changed")
        changes = written(now.select("path", "mark").join(old, "path", "full").select("path", kind.alias("change")).where("change IS NOT NULL").withColumn("part", self._part()), "changes")
        touched = changes.select("part").distinct()
        fresh = now.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
        marks = fresh.select("path", "mark")
        # A file without windows still has a row, and so has a partition whose files are gone.
        made = marks.join(file_windows(fresh, self.profile), "path", "left").select("path", "mark", "w").withColumn("part", self._part())
        carried = self.rows().where("path IS NOT NULL").join(touched, "part", "left_semi").join(changes.select("path"), "path", "left_anti").select("path", "mark", "w", "part")
        none = F.lit(None).cast("string")
        new = written(made.unionByName(carried).unionByName(touched.select(none.alias("path"), none.alias("mark"), none.alias("w"), "part")), "renewed")
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        drop_written(new)
        return changes

    def windows(self) -> DataFrame:
        """w: the different windows of full width; a shorter text's window can't be in a longer one of a probe's."""
        return self.rows().where(F.length("w") == PROBE).select("w").distinct()


def verdicts(files: DataFrame, index: LeakIndex, text: str = "text") -> DataFrame:
    """path, hits, exempt, leaked for each file (path, text): whether it holds a window of the index.

    Exempt are other suffixes, the fixtures, and texts shorter than a window; CRLF counts as LF.
    """
    suffix = F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1)
    t = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    exempt = ~suffix.isin(*SUFFIXES) | F.col("path").startswith(EXEMPT) | F.coalesce(F.length(t) < PROBE, F.lit(True))
    rows = files.select(F.struct("path", exempt.alias("exempt")).alias("f"), F.when(~exempt, t).alias("text"))
    hits = window_hits(rows, index.windows(), "f", "text", every=True)
    return hits.select("doc_id.path", "hits", "doc_id.exempt", (F.col("hits") > 0).alias("leaked"))
