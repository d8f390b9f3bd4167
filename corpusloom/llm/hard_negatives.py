"""Hard negatives by branch and bound over ball trees.

Rows are dealt by the hash of their label into `GROUPS` groups and by hash into blocks; a task builds one ball tree over its block and takes a
block of anchors through it at once. A node has a centre and a radius, and with them an inner product lies between
q.c - |q| r and q.c + |q| r for every row below. An anchor leaves a node when the upper bound is under its score window or strictly
under its k-th score so far, when the lower bound is over the window, or when all rows of the node have a label
that it doesn't look for; a node that no anchor stays in is pruned.

Two searches: an anchor's positives are the best rows of its label, found in the group of the label; each different positive
score then gives a window, and the best rows of other labels in the window are found in all groups. The windows of an anchor
share their products.

Exact: scores are whole numbers (see `vectors.exact`); bounds are widened by `SLACK` of the product of the lengths. Rows that
are equal in label and vector are one class that keeps its smallest ids: as many as a search returns, and one more for the anchor.

Nulls: rows with a null label take no part, for vectors see `whole_vectors`. Repeated rows count once; rows that share an id but not
label and vector are each searched for and found, so their anchors come out together. Ties go to the smaller id. Without other rows
of its label an anchor has no positives, without a row in the window a positive has no negatives, and neither gives rows. An empty
table gives none. Columns other than the three named aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import again, written
from corpusloom.llm.vectors import Best, classes, exact, matrix, meet, whole_vectors

GROUPS = 64
#: Rows of a block (and so of a tree), anchors of a block, rows of a leaf.
BLOCK_ROWS, BLOCK_ANCHORS, LEAF = 16_384, 1_024, 96
SLACK = 1e-9
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Nodes over rows that lie in one order; labels first, then the halves along the line between two far rows."""

    def __init__(self, v: np.ndarray, label: np.ndarray, leaf: int = LEAF):
        x = v.astype(np.float64)
        self.order = np.lexsort((label,))
        self.label = label
        self.start, self.end, self.left, self.right = [], [], [], []
        self.centre, self.radius, self.one = [], [], []
        todo = [(0, len(v), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            rows = self.order[a:b]
            node = len(self.start)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            centre = x[rows].mean(0)
            far = np.sqrt(((x[rows] - centre) ** 2).sum(1))
            single = bool((label[rows] == label[rows[0]]).all())
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.one.append(int(label[rows[0]]) if single else None)
            if b - a <= leaf or single and not far.max():
                continue
            if single:
                p = x[rows[far.argmax()]]
                q = x[rows[((x[rows] - p) ** 2).sum(1).argmax()]]
                order = np.argsort(x[rows] @ (q - p), kind="stable")
                self.order[a:b] = rows[order]
                middle = (a + b) // 2
            else:  # rows lie by label: the border nearest to the middle
                edges = a + 1 + np.flatnonzero(np.diff(label[rows]))
                middle = int(edges[np.abs(edges - (a + b) / 2).argmin()])
            todo += [(a, middle, node, False), (middle, b, node, True)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)


def search(v: np.ndarray, label: np.ndarray, low: np.ndarray, q: np.ndarray, q_label: np.ndarray, windows: tuple[np.ndarray, np.ndarray], same: bool, k: int, leaf: int = LEAF) -> tuple[Best, dict[str, int]]:
    """The k best rows for each anchor and window (numbered anchor * windows + window), and how many nodes were met and left.

    windows: least and greatest score, anchors by windows; a window whose least is over its greatest is empty. same: rows of the anchor's label, else all others.
    """
    n, many = windows[0].shape
    best = Best(n * many, k)
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    row_length = np.sqrt((v.astype(float) ** 2).sum(1))
    kind = exact(length, row_length)
    whole_q, whole_v = q.astype(kind), v.astype(kind)
    fine = q.astype(np.float64)
    tree = BallTree(v, label, leaf)
    slack = SLACK * (1 + length * row_length.max(initial=0.0))
    lo, hi = windows
    met = left = 0
    todo = [(0, np.flatnonzero((lo <= hi).any(1)))]
    while todo:
        node, active = todo.pop()
        met += 1
        one = tree.one[node]
        if one is not None:
            active = active[(q_label[active] == one) == same]
        if len(active):
            middle = fine[active] @ tree.centre[node]
            reach = length[active] * tree.radius[node] + slack[active]
            least = np.maximum(lo[active], best.kth.reshape(n, many)[active]).astype(float)
            stay = ((middle + reach)[:, None] >= least) & ((middle - reach)[:, None] <= hi[active].astype(float)) & (lo[active] <= hi[active])
            active = active[stay.any(1)]
        if not len(active):
            left += 1
            continue
        if tree.left[node] >= 0:
            # The child that promises more goes first: it lies on top.
            sides = [(tree.left[node], active), (tree.right[node], active)]
            promise = [float((fine[active] @ tree.centre[c]).mean()) for c, _ in sides]
            todo += sides if promise[1] >= promise[0] else sides[::-1]
            continue
        rows = tree.order[tree.start[node] : tree.end[node]]
        s = (whole_q[active] @ whole_v[rows].T).astype(np.int64)
        wanted = (label[rows][None, :] == q_label[active][:, None]) == same
        kth = best.kth.reshape(n, many)
        for w in range(many):
            bar = np.maximum(lo[active, w], kth[active, w])
            i, j = np.nonzero(wanted & (s >= bar[:, None]) & (s <= hi[active, w][:, None]) & (lo[active, w] <= hi[active, w])[:, None])
            best.add(active[i] * many + w, s[i, j], low[rows[j]], rows[j])
    return best, {"met": met, "left": left, "nodes": len(tree.start)}


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where is_anchor(vec_id column) holds, its first `positives` other rows of its label, and for each of them the
    first `negatives` rows of other labels whose score is at least and at most so many percent of the positive's.
    """
    spark = rows.sparkSession
    base = whole_vectors(rows, scale, vec_id, embedding, label).where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("long"))
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    table = classes(base, ["label", "v"], max(positives + 1, negatives))
    table = written(table.select(F.monotonically_increasing_id().alias("i"), group.alias("group"), "label", "v", "ids", F.col("ids")[0].alias("low")), "classes")
    asked = base.where(is_anchor(F.col("vec_id"))).select("label", "v", F.col("vec_id").alias("anchor_id")).distinct()
    asked = written(asked.join(table.select("label", "v", "i"), ["label", "v"]).select("i", "anchor_id"), "asked")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if asked.isEmpty():
        return empty
    anchors = written(table.join(asked.select("i").distinct(), "i", "left_semi").select("i", "group", "label", "v"), "anchors")
    targets = again(table).select("group", "i", "label", "v", "low")

    def best_same(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.full((len(q), 1), _LOW), np.full((len(q), 1), _HIGH)
        best, _ = search(matrix(v["v"]), v["label"].to_numpy(), v["low"].to_numpy(), matrix(q["v"]), q["label"].to_numpy(), (lo, hi), True, positives + 1)
        of, row, score, low = best.found()
        return pd.DataFrame({"q": q["i"].to_numpy()[of], "i": v["i"].to_numpy()[row], "score": score, "low": low})

    def windowed(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        scores = [np.asarray(s, np.int64) for s in q["scores"]]
        many = max(map(len, scores))
        at = np.zeros((len(q), many), np.int64)
        lo, hi = np.full((len(q), many), 1), np.full((len(q), many), 0)  # empty where an anchor has fewer windows
        for a, s in enumerate(scores):
            at[a, : len(s)], lo[a, : len(s)], hi[a, : len(s)] = s, [-(-percent[0] * x // 100) for x in s.tolist()], [percent[1] * x // 100 for x in s.tolist()]
        best, _ = search(matrix(v["v"]), v["label"].to_numpy(), v["low"].to_numpy(), matrix(q["v"]), q["label"].to_numpy(), (lo, hi), False, negatives)
        of, row, score, low = best.found()
        a, w = of // many, of % many
        return pd.DataFrame({"q": q["i"].to_numpy()[a], "positive_score": at[a, w], "i": v["i"].to_numpy()[row], "score": score, "low": low})

    ids = again(table).select("i", "ids")
    found = meet(targets, anchors, best_same, "q long, i long, score long, low long", BLOCK_ROWS, BLOCK_ANCHORS)
    same = written(_rows(found, ids, ["q"], positives + 1), "positives")
    own = Window.partitionBy("q", "anchor_id").orderBy(F.desc("score"), "vec_id")
    mine_ = same.join(asked.withColumnRenamed("i", "q"), "q").where(F.col("vec_id") != F.col("anchor_id")).withColumn("r", F.row_number().over(own)).where(F.col("r") <= positives)
    mine_ = written(mine_.select("q", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    scores = mine_.groupBy("q").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # few: a class has so many positives and one more
    windows = written(anchors.drop("group").join(scores, anchors["i"] == scores["q"]).drop("q"), "windows")
    labels = F.broadcast(again(table).groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")))  # GROUPS rows
    routed = windows.join(labels, ~((F.col("a") == F.col("b")) & (F.col("a") == F.col("label")))).select("group", "i", "label", "v", "scores")
    other = meet(targets, routed, windowed, "q long, positive_score long, i long, score long, low long", BLOCK_ROWS, BLOCK_ANCHORS)
    hard = _rows(other, ids, ["q", "positive_score"], negatives)
    out = mine_.join(hard.select("q", "positive_score", F.col("r").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["q", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rows(found: DataFrame, ids: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, r, vec_id, score: the k best rows from the classes found (by, i, score, low) by each block."""
    of = Window.partitionBy(*by)
    best = found.withColumn("r", F.row_number().over(of.orderBy(F.desc("score"), "low"))).where(F.col("r") <= k)
    hits = best.join(ids, "i").select(*by, "score", F.explode("ids").alias("vec_id"))
    return hits.withColumn("r", F.row_number().over(of.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)


def relabelled(label: Column, vec_id: Column, every: int = 7, labels: int = 10) -> Column:
    """Labels with some moved on by one, where the id is divisible by `every`."""
    return F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)
