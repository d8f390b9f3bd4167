"""What the exact vector searches share: whole-number vectors, classes of equal rows, and blocks of rows met by blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, written

#: A vector's squared length stays below this, so that inner products fit in 64 bits.
MOST_SQUARE = float(1 << 62)
#: Up to here whole numbers are exact in double precision.
EXACT = float(1 << 53)
SALTS = 32


def whole_vectors(rows: DataFrame, scale: int, vec_id: str, embedding: str, *others: str) -> DataFrame:
    """vec_id, others, v array<int>, n2 double (squared length): each component x as floor(scale * x).

    Rows with a null id, a null vector, or a null or non-finite component are left out, as are vectors whose
    squared length reaches 2**62 and those whose dimension isn't the most frequent one (of equally frequent ones the least).
    """
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), *[F.col(f"`{c}`").alias(c) for c in others], F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    dims = base.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 0
    scaled = F.transform("e", lambda x: F.floor(x * float(scale)).try_cast("int"))
    base = base.where(F.size("e") == dim).withColumn("v", scaled).drop("e").where(~F.exists("v", lambda x: x.isNull()))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return base.withColumn("n2", square).where(F.col("n2") < MOST_SQUARE)


def classes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys and ids: for rows that are equal in keys their smallest different ids, `most` of them, ascending.

    In two steps, so that the rows of a frequent vector don't meet in one task.
    """
    first = Window.partitionBy(*keys, "salt").orderBy("vec_id")
    second = Window.partitionBy(*keys).orderBy("vec_id")
    ids = rows.select(*keys, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    ids = ids.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= most).dropDuplicates([*keys, "salt", "vec_id"])
    ids = ids.withColumn("r", F.row_number().over(second)).where(F.col("r") <= most)
    return ids.groupBy(*keys).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def exact(*lengths: np.ndarray) -> type:
    """The number type in which all inner products of vectors up to these lengths are exact: by Cauchy and Schwarz they, and
    every sum of some of their terms, are at most the product of the lengths."""
    bound = 1.0
    for x in lengths:
        bound *= float(x.max(initial=0.0)) + 1.0
    return np.float64 if bound < EXACT else np.int64


def meet(rows: DataFrame, queries: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int, block_queries: int) -> DataFrame:
    """work(block of rows, block of queries) for every block of rows of a group and every block of queries that go to the group.

    rows: group, i, and what else work needs; queries: group, i, and what else; one row for each group that a query goes to. Groups are
    few (some hundred), their blocks are dealt by hash and of bounded size, so a group with most rows is worked on by many tasks.
    """
    size = lambda df, most, name: df.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = F.broadcast(written(size(rows, block_rows, "nv").join(size(queries, block_queries, "nq"), "group"), "grid"))
    part = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(grid, "group").select("*", part("nv").alias("vb"), each("nq").alias("qb")).drop("nv", "nq")
    right = queries.join(grid, "group").select("*", each("nv").alias("vb"), part("nq").alias("qb")).drop("nv", "nq")
    names = [c.split()[0] for c in schema.split(", ")]

    def block(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        try:
            return work(v, q)
        finally:
            give_back()

    keys = ["group", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, schema)


class Best:
    """The k highest scores of each of n searches, ties to the smaller id, as candidates come in."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.low = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1)

    @property
    def kth(self) -> np.ndarray:
        """The score that a candidate must reach; the least number where there are fewer than k so far."""
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, low: np.ndarray, row: np.ndarray) -> None:
        """Candidates: the search, its score, the id that ties go by, and what stands for the row."""
        if not len(of):
            return
        met, at = np.unique(of, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(met)), self.k), at])
        s = np.concatenate([self.score[met].ravel(), score])
        w = np.concatenate([self.low[met].ravel(), low])
        r = np.concatenate([self.row[met].ravel(), row])
        order = np.lexsort((w, ~s, group))
        group = group[order]
        keep = np.arange(len(group)) - np.searchsorted(group, group) < self.k
        order = order[keep]
        self.score[met], self.low[met], self.row[met] = (x[order].reshape(len(met), self.k) for x in (s, w, r))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(search, row, score, low) of all that was kept."""
        of, place = np.nonzero(self.row >= 0)
        return of, self.row[of, place], self.score[of, place], self.low[of, place]
