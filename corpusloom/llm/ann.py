"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the least
distance. Centroids come from balanced hierarchical clustering of a bounded sample (`SAMPLE_PER_LIST`
rows for each list, `SAMPLE_ALL` in all); everything else covers every row. The centroids, at most
`MOST_LISTS`, are searched by a graph in memory (`CentroidGraph`: nearest neighbours, links back, beam
search over whole batches). A vector near the border of lists is written to several: its nearest centroid
and further ones within a distance ratio, unless a chosen centroid lies nearer to the candidate than
the vector does. A query reads the lists whose centroid is within a distance ratio of the nearest, the
nearest first, up to a number of lists.

Ratio and number are measured on the table itself: `CALIBRATION` queries, chosen by hash, meet every
row, and the least values are taken under which `COVER` of their true neighbours lie in a list that is
read. So recall doesn't fall as the table grows; where vectors have no structure, more lists are read. A
`cover` of 1.0 reads whatever lists the calibrating queries need. A query's `NEAR` nearest lists are read first;
its others then answer only with what reaches the score of the k + 1 best so far, so that what is passed on for a
query doesn't grow with the lists that it reads.

Equal vectors are one class that is searched for once, and a class keeps its smallest k + 1 ids, as ties
go to the smaller id and a query leaves out only its own: that is exact. Lists and the queries that read
them are dealt in blocks of bounded size, so a popular list is worked on by many tasks.

Nulls: rows with a null id, and vectors that are null, zero, or hold a null or non-finite component, take
no part, nor do vectors whose dimension isn't the most frequent one. Repeated rows count once. An empty
table, or one without a query, gives no rows. Columns other than the two named aren't read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a list, before replication; most lists.
LIST_SIZE, MOST_LISTS = 64, 16_384
SAMPLE_PER_LIST, SAMPLE_ALL = 12, 131_072
#: Copies of a vector at most, and how much farther than the nearest centroid (squared distance).
COPIES, COPY_RATIO = 6, 1.5
#: A copy's centroid is at least this share of its distance (squared) from those already chosen.
SPREAD = 0.1
#: Queries that meet every row to find how many lists must be read, and the share of their neighbours that these must hold.
CALIBRATION, COVER = 128, 0.97
#: Up to so many lists a query reads all of them, and the result is exact.
ALL_LISTS = 64
#: Vectors beyond k + 1 whose scores are summed up again.
SPARE = 8
#: Lists that a query reads first.
NEAR = 4
#: Beyond this share of all lists, centroids are compared one by one and not by the graph.
PROBE_SHARE = 0.125
#: Rows of a list, and queries, that one task compares at a time.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048
SALTS = 32


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of groups of near equal size, by splitting the largest group into up to 8 again and again."""
    rng = np.random.default_rng(seed)
    done, todo = [], [(np.arange(len(x)), max(1, min(lists, len(x))))]
    while todo:
        rows, want = todo.pop()
        if want == 1 or len(rows) <= 1:
            done.append(x[rows].mean(0))
            continue
        k = min(8, want)
        c = x[rng.choice(rows, k, replace=False)].astype(np.float32)
        most = -(-len(rows) // k)
        for _ in range(6):
            d = ((c * c).sum(1) - 2 * x[rows] @ c.T)
            # The surest rows choose first; a full centroid passes rows on to their next best.
            order = np.argsort(np.partition(d, 1, axis=1)[:, 0] - np.partition(d, 1, axis=1)[:, 1], kind="stable")
            pick, of = d.argmin(1), np.full(len(rows), -1)
            room = np.full(k, most)
            for j in range(k):
                choice = pick[order]
                for b in range(k):
                    mine = order[(choice == b) & (of[order] < 0)][: room[b]]
                    of[mine] = b
                    room[b] -= len(mine)
                left = of < 0
                if not left.any():
                    break
                d[:, room <= 0] = np.inf
                pick = np.where(left, d.argmin(1), pick)
            c = np.stack([x[rows[of == b]].mean(0) if (of == b).any() else c[b] for b in range(k)])
        share = np.bincount(of, minlength=k)
        parts = np.maximum(1, np.floor(want * share / len(rows)).astype(int))
        for b in np.argsort(-share, kind="stable")[: max(0, want - parts.sum())]:
            parts[b] += 1
        todo += [(rows[of == b], int(parts[b])) for b in range(k) if share[b]]
    return np.unique(np.stack(done).astype(np.float32), axis=0)


class CentroidGraph:
    """Nearest centroids of a batch of vectors by beam search over a neighbour graph."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c, self.n = c, (c * c).sum(1)
        near = []
        for a in range(0, len(c), 1024):
            d = self.n - 2 * c[a : a + 1024] @ c.T
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            k = min(degree, len(c) - 1)
            near.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(d), 1), int))
        out = np.concatenate(near)
        back: list[list[int]] = [[] for _ in c]
        for i, row in enumerate(out.tolist()):
            for j in row:
                if len(back[j]) < degree:
                    back[j].append(i)
        own = np.arange(len(c))[:, None]
        filled = np.array([r + [i] * (degree - len(r)) for i, r in enumerate(back)]).reshape(len(c), -1)
        self.links = np.concatenate([out, filled, own], axis=1)
        step = max(1, len(c) // 64)
        self.entries = np.arange(0, len(c), step)

    def nearest(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), nearest first; -1 and infinity where there are fewer."""
        k = min(k, len(self.c))
        beam = min(max(beam, k), len(self.c))
        rows = np.arange(len(x))[:, None]
        xx = (x * x).sum(1)[:, None]
        d = xx + self.n[self.entries] - 2 * x @ self.c[self.entries].T
        at = np.argsort(d, axis=1, kind="stable")[:, : min(8, beam)]
        ids = np.full((len(x), beam), -1)
        dist = np.full((len(x), beam), np.inf, np.float32)
        ids[:, : at.shape[1]], dist[:, : at.shape[1]] = self.entries[at], d[rows, at]
        seen = np.zeros((len(x), len(self.c)), bool)
        seen[rows, self.entries[at]] = True
        opened = np.zeros((len(x), beam), bool)
        while True:
            shut = np.where(opened | (ids < 0), np.inf, dist)
            pick = shut.argmin(1)
            live = np.flatnonzero(np.isfinite(shut[np.arange(len(x)), pick]))
            if not len(live):
                break
            opened[live, pick[live]] = True
            new = self.links[ids[live, pick[live]]]
            known = seen[live[:, None], new]
            seen[live[:, None], new] = True
            nd = xx[live] + self.n[new] - 2 * np.einsum("qd,qnd->qn", x[live], self.c[new])
            nd[known] = np.inf
            # A centroid that two links name is met twice in one step: the second is dropped.
            order = np.argsort(new, axis=1, kind="stable")
            s = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(known)
            twice[:, 1:] = s[:, 1:] == s[:, :-1]
            np.put_along_axis(nd, order, np.where(twice, np.inf, np.take_along_axis(nd, order, 1)), 1)
            all_d = np.concatenate([dist[live], nd], 1)
            all_i = np.concatenate([ids[live], new], 1)
            all_o = np.concatenate([opened[live], np.zeros_like(known)], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(all_i, best, 1), -1)
            opened[live] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)

    def copies(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector is written to."""
        ids, d = self.nearest(x, 2 * COPIES, 3 * COPIES)
        out = []
        for i in range(len(x)):
            chosen: list[int] = []
            for j, dj in zip(ids[i].tolist(), d[i].tolist(), strict=True):
                if j < 0 or len(chosen) == COPIES or chosen and dj > COPY_RATIO * d[i, 0] + 1e-9:
                    break
                if chosen and ((self.c[chosen] - self.c[j]) ** 2).sum(1).min() < SPREAD * dj:
                    continue
                chosen.append(j)
            out.append(np.array(chosen))
        return out

    def probes(self, x: np.ndarray, most: int, ratio: float) -> list[np.ndarray]:
        """The lists that each query reads: at most so many, within a ratio of the nearest one's squared distance."""
        k = min(most, len(self.c))
        if k <= PROBE_SHARE * len(self.c):
            ids, d = self.nearest(x, k, k + 32)
        else:
            ids, d = self.ordered(x, k)
        return [i[(i >= 0) & (e <= ratio * e[0] + 1e-6)] for i, e in zip(ids, d, strict=True)]

    def ordered(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids by comparing all."""
        far = np.maximum((x * x).sum(1)[:, None] + self.n - 2 * x @ self.c.T, 0)
        ids = np.argpartition(far, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(far, ids, 1)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)

    def calibrated(self, asking: np.ndarray, near: np.ndarray, of: np.ndarray, cover: float) -> tuple[int, float]:
        """(lists, ratio) under which that share of the near vectors lie in a list that their query reads.

        asking are lifted queries, near lifted vectors, of the query's place for each of them.
        """
        ids, d = self.ordered(asking, len(self.c))
        place = np.empty_like(ids)
        np.put_along_axis(place, ids, np.broadcast_to(np.arange(len(self.c)), ids.shape).copy(), 1)
        rank = np.array([place[q, lists].min() for q, lists in zip(of.tolist(), self.copies(near), strict=True)])
        far = d[of, rank] / np.maximum(d[of, 0], 1e-9)
        # Half of what may be missed goes to each of the two bounds.
        share = 1 - (1 - cover) / 2
        at = min(len(rank) - 1, int(np.ceil(share * len(rank))) - 1)
        return int(np.sort(rank)[at]) + 1, float(np.sort(far)[at]) * (1 + 1e-5)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose nearest by distance is the largest by inner product."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1, keepdims=True)))], 1).astype(np.float32)


def asked(x: np.ndarray) -> np.ndarray:
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def best_of_block(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of every pair that is among the query's k largest, ties with the last one included."""
    s = q @ v.T
    if s.shape[1] <= k:
        i, j = np.divmod(np.arange(s.size), s.shape[1])
    else:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= least[:, None])
    return i, j, s[i, j]


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy())


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query(vec_id column) holds, its k nearest found."""
    from corpusloom.llm.common import written

    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("e", lambda v: v != 0))
    sizes = rows.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("e") == dim).withColumn("c", F.concat_ws(":", F.xxhash64("e"), F.hash("e")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))

    # Classes of equal vectors with their smallest k + 1 ids, in two steps so that no class is in one task.
    first = Window.partitionBy("c", "salt").orderBy("vec_id")
    second = Window.partitionBy("c").orderBy("vec_id")
    ids = rows.select("c", "vec_id", "e").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    ids = ids.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1).dropDuplicates(["c", "salt", "vec_id"])
    ids = ids.withColumn("r", F.row_number().over(second)).where(F.col("r") <= k + 1)
    lists = ids.groupBy("c").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("e", "vec_id").alias("e"))
    # A class is named by a number that is settled when the table is written.
    classes = written(lists.select(F.monotonically_increasing_id().alias("i"), "c", "ids", F.col("ids")[0].alias("low"), "e", norm.alias("norm")), "classes")
    again = lambda: spark.read.schema(classes.schema).parquet(classes._corpusloom_path)
    asked_for = rows.where(is_query(F.col("vec_id"))).select("c", F.col("vec_id").alias("query_id")).distinct()
    queries = written(asked_for.join(classes.select("c", "i"), "c").select("i", "query_id"), "queries")
    stats = classes.agg(F.count("*").alias("n"), F.max("norm").alias("m")).first()
    n_queries = queries.select("i").distinct().count()
    if not stats["n"] or not n_queries:
        return empty
    longest = float(stats["m"])
    n_lists = int(min(MOST_LISTS, max(1, stats["n"] // LIST_SIZE)))

    def bounded(df: DataFrame, most: int, n: int) -> np.ndarray:
        """About `most` of n vectors of df, by the hash of their class, packed on their way to the driver."""

        def pack(it):
            for pdf in it:
                if len(pdf):
                    yield pd.DataFrame({"x": [r.tobytes() for r in matrix(pdf["e"])]})

        share = int(min(1.0, most / n) * (1 << 20)) + 1
        got = df.where(F.pmod(F.xxhash64("c"), F.lit(1 << 20)) < share).select("e").limit(2 * most).mapInPandas(pack, "x binary").toPandas()
        return np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, dim)

    x = bounded(classes, min(SAMPLE_ALL, SAMPLE_PER_LIST * n_lists + 64), stats["n"])
    graph = CentroidGraph(balanced_centroids(lifted(x, longest), n_lists))
    asking = written(again().join(queries.select("i").distinct(), "i", "left_semi").select("i", "c", "e"), "asking")
    few = bounded(asking, CALIBRATION, n_queries)[:CALIBRATION]
    if not len(few):
        few = bounded(asking, n_queries, n_queries)[:CALIBRATION]
    if n_lists <= ALL_LISTS:
        most, ratio = n_lists, float("inf")
    else:
        most, ratio = graph.calibrated(asked(few), *_neighbours(classes, few, k, longest), cover)

    def place(it, queried: bool):
        for pdf in it:
            step = 128 if queried else 512
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                v = matrix(part["e"])
                got = graph.probes(asked(v), most, ratio) if queried else graph.copies(lifted(v, longest))
                yield pd.DataFrame({"list": np.concatenate(got).astype("int32"), "i": np.repeat(part["i"].to_numpy(), [len(g) for g in got]), "near": np.concatenate([np.arange(len(g)) < NEAR for g in got])})

    postings = written(classes.select("i", "e").mapInPandas(lambda it: place(it, False), "list int, i long, near boolean"), "postings")
    probes = written(asking.select("i", "e").mapInPandas(lambda it: place(it, True), "list int, i long, near boolean"), "probes")

    def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = {"q": "int64", "i": "int64", "score": "float64", "low": "int64"}
        if not len(v) or not len(q):
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in names.items()})
        a, b, s = best_of_block(matrix(q["e"]), matrix(v["e"]), k + 1)
        reaches = s >= q["least"].to_numpy()[a]
        a, b, s = a[reaches], b[reaches], s[reaches]
        return pd.DataFrame({"q": q["i"].to_numpy()[a], "i": v["i"].to_numpy()[b], "score": s, "low": v["low"].to_numpy()[b]})

    # Blocks: (list, block of rows, block of queries). Both tables of sizes have at most MOST_LISTS rows.
    nv = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nv"))
    part = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["list", "vb", "qb"]

    def compared(reads: DataFrame) -> DataFrame:
        """q, i, score, low: what the lists answer to reads (list, i, least)."""
        nq = reads.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq"))
        grid = F.broadcast(nv.join(nq, "list"))
        left = postings.join(grid, "list").select("list", part("nv").alias("vb"), each("nq").alias("qb"), "i").join(again().select("i", "e", "low"), "i")
        right = reads.join(grid, "list").select("list", each("nv").alias("vb"), part("nq").alias("qb"), "i", "least").join(asking.select("i", "e"), "i")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "q long, i long, score double, low long")

    near = written(compared(probes.where("near").select("list", "i", F.lit(float("-inf")).alias("least"))), "near")
    so_far = near.select("q", "i", "score").distinct().withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    least = so_far.where(F.col("r") == k + 1).select(F.col("q").alias("i"), F.col("score").alias("least"))
    others = probes.where("NOT near").select("list", "i").join(least, "i", "left").select("list", "i", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = near.unionByName(compared(others))
    found = found.groupBy("q", "i").agg(F.max("score").alias("score"), F.first("low").alias("low"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low"))).where(F.col("r") <= k + 1 + SPARE)
    # Matrix products differ in their last bits with their shape: what is returned is summed up term by term, in order.
    term_by_term = F.aggregate(F.zip_with("e", "qe", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    best = best.join(again().select("i", "e"), "i").join(asking.select(F.col("i").alias("q"), F.col("e").alias("qe")), "q").select("q", "i", "low", term_by_term.alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low"))).where(F.col("r") <= k + 1)
    hits = best.join(again().select("i", "ids"), "i").select("q", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    top = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    mine = queries.join(top, queries["i"] == top["q"]).select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return mine.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def _neighbours(classes: DataFrame, few: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(lifted vectors, place of their query): the true k nearest classes of a few queries, each met by every row."""

    def nearest(it):
        held: tuple[np.ndarray, ...] | None = None
        for pdf in it:
            if not len(pdf):
                continue
            v = matrix(pdf["e"])
            q, j, s = best_of_block(few, v, k)
            new = (q, s, v[j])
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            order = np.lexsort((-held[1], held[0]))
            at = np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order])
            held = tuple(x[order[at < k]] for x in held)
        if held is not None:
            yield pd.DataFrame({"q": held[0], "s": held[1], "x": [r.tobytes() for r in held[2]]})

    each = classes.select("e").mapInPandas(nearest, "q long, s double, x binary")  # at most k rows for each query and task
    got = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "x"))).where(F.col("r") <= k).select("q", "x").toPandas()
    return lifted(np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), -1), longest), got["q"].to_numpy()
