"""Hard-negative mining by inner product: rows packed sort-tile-recursively into R-trees, searched best first.

The rows are dealt into ranges of label and coordinate, which are the outermost tiles; each task packs its tile, at most HELD vector
components at a time, into a tree of minimum bounding boxes. A box gives an interval of inner products with an anchor, coordinate by
coordinate. The anchors, a stated hundredth of the rows, come in blocks of at most ANCHORS, which are sent to every task; each task
hands on no more than the first few rows for each anchor, and those are ranked together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import settle

EVERY = 100
SHIFT = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share, in hundredths, of the positive's.
LEAST = 80

LEAF = 256
FAN = 8
#: Components of the vectors that one tree holds, and anchors sent to the tasks at once.
HELD = 4_000_000
ANCHORS = 20_000
#: Anchors whose boxes' bounds are worked out together.
TOGETHER = 256
#: Rows of a tile when the rows are dealt out.
TILE = 200_000


def vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with changed labels and whole-number components."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("label is not null").where(whole)
    label = F.when(F.col("vec_id") % SHIFT == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double"))).alias("v"))


def tiles(rows: DataFrame) -> DataFrame:
    """The rows dealt into ranges of label and first coordinates; a hot label is cut by its coordinates."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TILE))
    return rows.repartitionByRange(n, "label", *[F.coalesce(F.get("v", F.lit(i)), F.lit(0)) for i in range(2)], "row")


def matrix(values: list, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the type whose products are exact: floating point while sums stay under 2**53, else whole numbers of 64 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64), b.astype(np.float64)) if most < 2**53 else (a, b)


class Tree:
    """Rows in sort-tile-recursive order: by label, then slices of the coordinates that vary most. levels[0] has the leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order: list[np.ndarray] = []
        axes = np.argsort(-v.std(axis=0), kind="stable") if v.size else np.arange(0)
        for label in np.unique(labels):
            self._tile(np.flatnonzero(labels == label), v, list(axes), order)
        at = np.concatenate(order)
        self.ids, self.rows, self.labels, self.v = ids[at], rows[at], labels[at], v[at]
        ends = np.cumsum([len(x) for x in order])
        starts = ends - [len(x) for x in order]
        cut = starts
        level = (starts, ends, *(f.reduceat(self.v, cut, axis=0) for f in (np.minimum, np.maximum)), np.minimum.reduceat(self.labels, cut), np.maximum.reduceat(self.labels, cut))
        self.levels = [level]
        while len(level[0]) > 1:
            first = np.arange(0, len(level[0]), FAN)
            level = (first, np.minimum(first + FAN, len(level[0])), np.minimum.reduceat(level[2], first, axis=0), np.maximum.reduceat(level[3], first, axis=0), np.minimum.reduceat(level[4], first), np.maximum.reduceat(level[5], first))
            self.levels.append(level)

    def _tile(self, rows: np.ndarray, v: np.ndarray, axes: list[int], order: list[np.ndarray]) -> None:
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or not axes:
            order.extend(rows[i : i + LEAF] for i in range(0, len(rows), LEAF))
            return
        left = min(len(axes), leaves.bit_length())
        slices = min(leaves, int(np.ceil(leaves ** (1 / left))) + (left == 1))
        for part in np.array_split(rows[np.argsort(v[rows, axes[0]], kind="stable")], max(2, slices)):
            self._tile(part, v, axes[1:], order)

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and the largest inner product that a box allows, anchors by boxes."""
        out = []
        for _, _, lo, hi, _, _ in self.levels:
            a, both = exact(anchors, np.concatenate([lo, hi]))
            low, high = both[: len(lo)].T, both[len(lo) :].T
            up, down = np.maximum(a, 0), np.minimum(a, 0)
            out.append((up @ low + down @ high, up @ high + down @ low))
        return out

    def search(self, i: int, bounds: list, useful: Callable, visit: Callable) -> None:
        """Leaves of anchor i, highest bound first. useful(level, nodes, low, high) tells which boxes may still matter."""
        top = len(self.levels) - 1
        queue = [(-float(bounds[top][1][i, n]), top, n) for n in range(len(self.levels[top][0]))]
        heapq.heapify(queue)
        while queue:
            high, level, n = heapq.heappop(queue)
            one = np.array([n])
            if not useful(level, one, bounds[level][0][i, one], bounds[level][1][i, one])[0]:
                continue
            start, end = self.levels[level][0][n], self.levels[level][1][n]
            if level == 0:
                visit(start, end)
                continue
            nodes = np.arange(start, end)
            for m in nodes[useful(level - 1, nodes, bounds[level - 1][0][i, nodes], bounds[level - 1][1][i, nodes])]:
                heapq.heappush(queue, (-float(bounds[level - 1][1][i, m]), level - 1, int(m)))


def best(kept: list[tuple], scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple]:
    """The first k of kept and the new ones, as ascending (-score, id, row)."""
    if len(scores) > k:
        at = np.lexsort((rows, ids, -scores))[:k]
        scores, ids, rows = scores[at], ids[at], rows[at]
    return sorted([*kept, *zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)])[:k]


#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def trees(frames: Iterator[pd.DataFrame], width: int) -> Iterator[Tree]:
    """Trees over a task's rows, each of at most about HELD components."""

    def packed(held: list[pd.DataFrame]) -> Tree:
        f = pd.concat(held)
        ids = np.array([NO_ID if pd.isna(x) else int(x) for x in f["vec_id"].astype(object)], dtype=np.int64)
        return Tree(ids, f["row"].to_numpy(np.int64), f["label"].to_numpy(np.int64), matrix(list(f["v"]), width))

    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            n += len(frame)
        if n * max(width, 1) >= HELD:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def mine_positives(anchors: pd.DataFrame, width: int, k: int) -> Callable:
    """A task: the first k other rows of its own label for each anchor among the task's rows."""
    q = matrix(list(anchors["v"]), width)
    own, label, ids = (anchors[c].to_numpy() for c in ("row", "label", "vec_id"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tree in trees(frames, width):
            a, v = exact(q, tree.v)
            out = []
            for start in range(0, len(q), TOGETHER):
                bounds = tree.bounds(q[start : start + TOGETHER])
                for i in range(start, min(start + TOGETHER, len(q))):
                    kept: list[tuple] = []

                    def useful(level, nodes, low, high):
                        _, _, _, _, first, last = tree.levels[level]
                        far = -kept[-1][0] if len(kept) == k else -np.inf
                        return (first[nodes] <= label[i]) & (last[nodes] >= label[i]) & (high >= far)

                    def visit(s, e):
                        nonlocal kept
                        score = v[s:e] @ a[i]
                        take = (tree.labels[s:e] == label[i]) & (tree.rows[s:e] != own[i])
                        if len(kept) == k:
                            take &= score >= -kept[-1][0]
                        at = np.flatnonzero(take)
                        kept = best(kept, score[at], tree.ids[s:e][at], tree.rows[s:e][at], k)

                    tree.search(i - start, bounds, useful, visit)
                    out += [(own[i], ids[i], r, x, int(-s)) for s, x, r in kept]
            yield pd.DataFrame(out, columns=["anchor", "anchor_id", "positive", "positive_id", "positive_score"])

    return task


def mine_negatives(anchors: pd.DataFrame, width: int, k: int, least: int) -> Callable:
    """A task: for each anchor and positive the first k rows of other labels whose scores lie in the positive's window."""
    q = matrix(list(anchors["v"]), width)
    own, label, ids, windows = (anchors[c].to_numpy() for c in ("row", "label", "vec_id", "windows"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tree in trees(frames, width):
            a, v = exact(q, tree.v)
            out = []
            for start in range(0, len(q), TOGETHER):
                bounds = tree.bounds(q[start : start + TOGETHER])
                for i in range(start, min(start + TOGETHER, len(q))):
                    high = np.array([w[2] for w in windows[i]])
                    floor = np.array([-(-least * w[2] // 100) for w in windows[i]])
                    kept: list[list[tuple]] = [[] for _ in high]
                    far = floor.copy()  # of each window, the least score that can still enter

                    def useful(level, nodes, low, top):
                        _, _, _, _, first, last = tree.levels[level]
                        inside = (top[:, None] >= far) & (low[:, None] <= high)
                        return ((first[nodes] != label[i]) | (last[nodes] != label[i])) & inside.any(axis=1)

                    def visit(s, e):
                        score = v[s:e] @ a[i]
                        near = np.flatnonzero((tree.labels[s:e] != label[i]) & (score >= far.min()) & (score <= high.max()))
                        if not len(near):
                            return
                        some, theirs, rows = score[near], tree.ids[s:e][near], tree.rows[s:e][near]
                        for j in range(len(high)):
                            at = np.flatnonzero((some >= far[j]) & (some <= high[j]))
                            if len(at):
                                kept[j] = best(kept[j], some[at], theirs[at], rows[at], k)
                                if len(kept[j]) == k:
                                    far[j] = max(far[j], -kept[j][-1][0])

                    tree.search(i - start, bounds, useful, visit)
                    out += [(own[i], ids[i], w[0], w[1], w[2], r, x, int(-s)) for w, found in zip(windows[i], kept, strict=True) for s, x, r in found]
            yield pd.DataFrame(out, columns=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"])

    return task


def first_of(found: DataFrame, keys: list[str], score: str, item: str, row: str, k: int) -> DataFrame:
    """The first k of each group by score, item and row; every task cuts its own rows before they meet."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item, row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings (vec_id, embedding, label).

    Rows with a null label or vector, or a null or non-finite component, take no part. Repeated rows and ids are rows of their own:
    such a row can be another's positive. A null id is no anchor and comes last in ties. Shorter vectors end in zeros, an empty
    vector's scores are 0. Scores must fit 64 bits, as the result's type does. An anchor without positives, or a positive whose window
    is empty (as for a negative score), has no rows; an empty table has none. Other columns, whatever their names, are not read.
    """
    spark = embeddings.sparkSession
    rows = settle(tiles(settle(vectors(embeddings))))
    width = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    chosen = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-chosen.count() // at_once))
    parts = []
    for b in range(blocks):
        # a block of the stated query set: about at_once anchors, whatever the size of the table
        anchors = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "label", "v").toPandas()
        if not len(anchors):
            continue
        schema = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
        near = rows.mapInPandas(mine_positives(anchors, width, positives), schema)
        chose = first_of(near, ["anchor"], "positive_score", "positive_id", "positive", positives).toPandas()
        windows = {r: list(zip(g["positive"].tolist(), g["positive_id"].tolist(), g["positive_score"].tolist(), strict=True)) for r, g in chose.groupby("anchor")}
        with_windows = anchors[anchors["row"].isin(list(windows))].reset_index(drop=True)
        with_windows["windows"] = [windows[r] for r in with_windows["row"]]
        if not len(with_windows):
            continue
        hard = rows.mapInPandas(mine_negatives(with_windows, width, negatives, least), schema + ", negative long, negative_id long, negative_score long")
        ranked = first_of(hard, ["anchor", "positive"], "negative_score", "negative_id", "negative", negatives)
        parts.append(settle(ranked) if blocks > 1 else ranked)
    positive, negative = (F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c) for c in ("positive_id", "negative_id"))
    told = ["anchor_id", positive, F.col("rank").cast("int").alias("rank"), negative, "positive_score", "negative_score"]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*told)
