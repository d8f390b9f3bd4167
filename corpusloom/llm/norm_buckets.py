"""Exact top-k search by inner product over buckets of vectors of like length.

Vectors are grouped by length (`RATIO` from one bucket to the next), buckets that are too large are dealt into blocks by hash, and a
query goes to the buckets whose greatest length allows the score that it must reach. That score is at first the k-th best among the
`SEED_NUMBERS` longest vectors, which every query meets. In a block, rows lie by falling length and are cut into runs of `RUN`
rows. The score so far of a query, over its length and the greatest length of a run, is its local cosine threshold. Above 1
the run is skipped. Otherwise the threshold decides how rows are left out: below the run's cut by length alone (a prefix of
the run), at or above it by coordinates: in the largest coordinates of the query, unit vectors that reach the threshold lie in
an interval, and the rows of the narrowest one are found by bisection in the sorted coordinate. The cut is set for each run from a few of
its queries, by the numbers of rows that both ways would look at. What is left is verified by its product.

Exact: scores are whole numbers (see `exact`), bounds are widened by `SLACK`, and rows are only left out when they are strictly below
the k-th best so far. Equal vectors are one class, searched for once, that keeps its smallest k + 1 ids, as ties go to the
smaller id and a query leaves out only its own.

Nulls: see `whole_vectors`; the zero vector takes part. Rows that repeat id and vector count once; rows that share an id but
not the vector are each searched for and found. An empty table, or one without a query, gives no rows. Columns other than the two
named aren't read, whatever their names. Rows have no text; a long vector is one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import again, written
from corpusloom.llm.vectors import Best, classes, exact, matrix, meet, whole_vectors

#: Lengths within a bucket: the least is this share of the greatest.
RATIO = 0.9
#: Components of the vectors that all queries meet first, and so the bound of what is broadcast for them.
SEED_NUMBERS = 1 << 19
#: Rows of a block, queries of a block, rows of a run.
BLOCK_ROWS, BLOCK_QUERIES, RUN = 16_384, 2_048, 1_024
#: Coordinates of a query that are looked at, and queries that set a run's cut.
FOCUS, TUNING = 4, 24
#: What looking up an interval costs in rows that are compared, and a row that is gathered to be compared.
LOOKUP, GATHER = 32, 2
SLACK = 1e-9


class Run:
    """Rows of like length, the longest first."""

    def __init__(self, v: np.ndarray, n2: np.ndarray, low: np.ndarray, row: np.ndarray):
        self.v, self.low, self.row = v, low, row
        self.length = np.sqrt(n2)
        self.longest = float(self.length[0])
        self.unit = v / np.maximum(self.length, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.unit.T, self.order, 1)

    def intervals(self, unit: np.ndarray, focus: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and focus coordinate the least and greatest that a unit vector within the threshold has there."""
        x = np.take_along_axis(unit, focus, 1)
        c = np.clip(cos, 0.0, 1.0)[:, None]
        spread = np.sqrt(np.maximum(0.0, 1 - x * x) * np.maximum(0.0, 1 - c * c))
        low = np.where(-x >= c, -1.0, x * c - spread) - SLACK
        high = np.where(x >= c, 1.0, x * c + spread) + SLACK
        return low, high

    def counts(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted coordinate: from, to."""
        a, b = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            here = focus == f
            a[here] = np.searchsorted(self.sorted[f], low[here], "left")
            b[here] = np.searchsorted(self.sorted[f], high[here], "right")
        return a, b

    def prefix(self, least: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rows that are long enough: all where the score to reach isn't positive."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, least / length, 0.0)
        return np.searchsorted(-self.length, -(need * (1 - SLACK)), "right")

    def cut(self, least: np.ndarray, length: np.ndarray, cos: np.ndarray, unit: np.ndarray, focus: np.ndarray) -> float:
        """The local threshold at and above which coordinates leave out more than they cost."""
        able = np.flatnonzero(cos > 0)
        if not len(able):
            return math.inf
        few = able[np.linspace(0, len(able) - 1, min(TUNING, len(able))).astype(int)]
        few = few[np.argsort(cos[few], kind="stable")]
        a, b = self.counts(focus[few], *self.intervals(unit[few], focus[few], cos[few]))
        gain = self.prefix(least[few], length[few]) - (LOOKUP + GATHER * (b - a).min(1))
        above = np.cumsum(gain[::-1])[::-1]
        best = int(above.argmax())
        return float(cos[few[best]]) if above[best] > 0 else math.inf

    def by_coordinates(self, q: np.ndarray, unit: np.ndarray, focus: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the rows that lie in all intervals."""
        low, high = self.intervals(unit, focus, cos)
        a, b = self.counts(focus, low, high)
        of, at, score = [], [], []
        for i, f in enumerate((b - a).argmin(1).tolist()):
            rows = self.order[focus[i, f], a[i, f] : b[i, f]]
            for g in range(focus.shape[1]):
                if g != f and len(rows):
                    x = self.unit[rows, focus[i, g]]
                    rows = rows[(x >= low[i, g]) & (x <= high[i, g])]
            if len(rows):
                of.append(np.full(len(rows), i))
                at.append(rows)
                score.append(self.v[rows] @ q[i])
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(of), np.concatenate(at), np.concatenate(score)


def runs(v: np.ndarray, n2: np.ndarray, low: np.ndarray, run: int = RUN) -> list[Run]:
    order = np.lexsort((low, -n2))
    return [Run(v[o], n2[o], low[o], o) for o in (order[a : a + run] for a in range(0, len(order), run))]


def retrieve(v: np.ndarray, n2: np.ndarray, low: np.ndarray, q: np.ndarray, q2: np.ndarray, least: np.ndarray, k: int, run: int = RUN) -> tuple[Best, dict[str, int]]:
    """The k best rows of each query among v with a score of at least `least`, and how often each way was taken."""
    kind = exact(np.sqrt(n2), np.sqrt(q2))
    v, q = v.astype(kind), q.astype(kind)
    length = np.sqrt(q2)
    unit = q / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    best, taken = Best(len(q), k), {"skipped": 0, "length": 0, "coordinates": 0}
    least = least.astype(np.float64)
    for r in runs(v, n2, low, run):
        reach = length * r.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = np.where(reach > 0, least / reach, np.where(least > 0, np.inf, -np.inf))
        live = np.flatnonzero(cos <= 1 + SLACK)
        taken["skipped"] += len(q) - len(live)
        if not len(live):
            continue
        cut = r.cut(least[live], length[live], cos[live], unit[live], focus[live])
        sharp = live[(cos[live] > 0) & (cos[live] >= cut)]
        other = live[~((cos[live] > 0) & (cos[live] >= cut))]
        taken["length"] += len(other)
        taken["coordinates"] += len(sharp)
        found = []
        if len(other):
            rows = r.prefix(least[other], length[other])
            s = q[other] @ v_t if (v_t := r.v[: rows.max()].T).size else np.zeros((len(other), 0))
            i, j = np.nonzero((s >= least[other][:, None]) & (np.arange(s.shape[1]) < rows[:, None]))
            if s.shape[1] > 4 * k:  # no more than the k-th best of this run and what equals it
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                enough = s[i, j] >= bar[i]
                i, j = i[enough], j[enough]
            found.append((other[i], j, s[i, j]))
        if len(sharp):
            i, j, s = r.by_coordinates(q[sharp], unit[sharp], focus[sharp], cos[sharp])
            enough = s >= least[sharp][i]
            found.append((sharp[i[enough]], j[enough], s[enough]))
        of, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        best.add(of, score.astype(np.int64), r.low[at], r.row[at])
        kth = best.kth
        least = np.where(kth > np.iinfo(np.int64).min, np.maximum(least, kth.astype(np.float64)), least)
    return best, taken


def length_bucket(n2: Column) -> Column:
    """The bucket of a squared length: 0 for the zero vector."""
    return F.when(n2 > 0, F.floor(F.log(n2) / (-2 * math.log(RATIO))) + 1).otherwise(0).cast("int")


def first_scores(queries: DataFrame, seeds: list, k: int) -> DataFrame:
    """queries with least: the k-th best score among the seeds (v, number of ids), or a number below all scores."""
    spark = queries.sparkSession
    v = np.array([s["v"] for s in seeds], np.int64)
    many = np.array([s["many"] for s in seeds])
    held = spark.sparkContext.broadcast((v, many, np.sqrt((v.astype(float) ** 2).sum(1))))

    def run(it):
        v, many, length = held.value
        for pdf in it:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                q = matrix(part["v"])
                kind = exact(length, np.sqrt(part["n2"].to_numpy()))
                s = (q.astype(kind) @ v.T.astype(kind)).astype(np.int64)
                order = np.argsort(-s, axis=1, kind="stable")
                upto = np.cumsum(many[order], axis=1)
                enough = upto[:, -1] >= k
                at = np.take_along_axis(order, (upto >= k).argmax(1)[:, None], 1)
                yield part.assign(least=np.where(enough, np.take_along_axis(s, at, 1)[:, 0], np.iinfo(np.int64).min))

    return queries.mapInPandas(run, "i long, v array<int>, n2 double, least long")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query(vec_id column) holds, the k others of highest inner product."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, vec_id, embedding)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    table = classes(rows, ["v"], k + 1).select(F.monotonically_increasing_id().alias("i"), "v", "ids", F.col("ids")[0].alias("low"), square.alias("n2"))
    table = written(table.withColumn("group", length_bucket(F.col("n2"))), "classes")
    asked = rows.where(is_query(F.col("vec_id"))).select("v", F.col("vec_id").alias("query_id")).distinct()
    asked = written(asked.join(table.select("v", "i"), "v").select("i", "query_id"), "asked")
    dim = table.select(F.size("v").alias("d")).first()
    if dim is None or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_seeds = max(k + 1, SEED_NUMBERS // max(1, dim["d"]))
    seeds = table.orderBy(F.desc("n2"), "i").limit(n_seeds).select("v", F.size("ids").alias("many")).collect()
    queries = table.join(asked.select("i").distinct(), "i", "left_semi").select("i", "v", "n2")
    queries = written(first_scores(queries, seeds, k + 1), "queries")
    # Some hundred buckets at most: a squared length is below 2**62.
    longest = F.broadcast(again(table).groupBy("group").agg(F.max("n2").alias("b2")))
    allowed = (F.col("least") <= 0) | (F.sqrt("n2") * F.sqrt("b2") * (1 + SLACK) >= F.col("least"))
    routed = queries.join(longest, allowed).drop("b2")

    def work(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        low = v["low"].to_numpy()
        best, _ = retrieve(matrix(v["v"]), v["n2"].to_numpy(), low, matrix(q["v"]), q["n2"].to_numpy(), q["least"].to_numpy(), k + 1)
        of, row, score, low = best.found()
        return pd.DataFrame({"q": q["i"].to_numpy()[of], "i": v["i"].to_numpy()[row], "score": score, "low": low})

    found = meet(again(table).select("group", "i", "v", "n2", "low"), routed, work, "q long, i long, score long, low long", BLOCK_ROWS, BLOCK_QUERIES)
    return ranked(found, again(table), asked, k)


def ranked(found: DataFrame, table: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: classes found (q, i, score, low) as rows, each query without its own id."""
    by = Window.partitionBy("q")
    best = found.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "low"))).where(F.col("r") <= k + 1)
    hits = best.join(table.select("i", "ids"), "i").select("q", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    top = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    mine = asked.join(top, asked["i"] == top["q"]).select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return mine.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
