"""Hard negatives by vantage-point trees over norm-augmented vectors.

A further component gives all vectors of a shard one norm, and anchors have a zero there: a row's squared distance from
an anchor is then a constant less twice their inner product. The nearest rows are those with the highest scores, and a window
of scores is an annulus around the anchor. A tree of vantage points bounds the distance of each leaf from each anchor; leaves
that the annulus touches are read nearest first, until no other can hold a row before the ``k`` found. Scores are whole
numbers, exact; distances only choose leaves, with a margin for rounding. What a task has found in one shard bounds its
search of the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, first_in_groups, lean

#: Rows of a shard and of a leaf; anchors that are searched together.
SHARD, LEAF, ANCHORS = 8192, 64, 4096
NO_ID = np.iinfo(np.int64).max
#: Sums of products of whole numbers up to this are exact in doubles.
EXACT = float(1 << 53)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, of each row of ``x`` with ``y``: in doubles where they are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[-1])
    return np.rint(x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64) if most < EXACT else x @ y.T


class VantageTree:
    """Rows of one length, in the order of leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        norms = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
        self.most = float(norms.max())
        augmented = np.column_stack([x.astype(np.float64), np.sqrt(self.most - norms)])
        order = np.arange(len(ids))
        #: Of each node: its parent, the vantage point (of an inner one), and how far its rows are from the parent's.
        self.parent, self.near, self.far, self.point, self.leaf_of, self.spans = [-1], [0.0], [0.0], [None], [], []
        todo = [(0, 0, len(ids))]
        points = []
        while todo:
            node, i, j = todo.pop()
            at = order[i:j]
            some = augmented[at]
            # the vantage point is the row that is farthest from the node's first one
            point = some[np.argmax(((some - some[0]) ** 2).sum(1))]
            away = np.sqrt(((some - point) ** 2).sum(1))
            if j - i <= LEAF or away.max() == 0:
                self.leaf_of.append(node)
                self.spans.append((i, j))
                continue
            half = (j - i) // 2
            by = np.argpartition(away, half)
            order[i:j], away = at[by], away[by]
            self.point[node] = len(points)
            points.append(point)
            for a, b in ((0, half), (half, j - i)):
                self.parent.append(node)
                self.near.append(float(away[a:b].min()))
                self.far.append(float(away[a:b].max()))
                self.point.append(None)
                todo.append((len(self.parent) - 1, i + a, i + b))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.points = np.array(points).reshape(-1, augmented.shape[1])
        self.spans = np.array(self.spans, np.int64)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that rows of each leaf may have from each anchor."""
        q = np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))])
        square = (q * q).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * q @ self.points.T
        away = np.sqrt(np.maximum(0, square))
        low, high = np.zeros((len(self.parent), len(q))), np.full((len(self.parent), len(q)), np.inf)
        for i in range(1, len(self.parent)):
            d = away[:, self.point[self.parent[i]]]
            low[i] = np.maximum(low[self.parent[i]], np.maximum(d - self.far[i], self.near[i] - d))
            high[i] = np.minimum(high[self.parent[i]], d + self.far[i])
        return low[self.leaf_of].T, high[self.leaf_of].T

    def distance(self, norm: float, score: float) -> float:
        return float(np.sqrt(max(0.0, norm + self.most - 2 * score)))


class Search:
    """One anchor in one tree: leaves are read at most once, whatever number of windows is asked for."""

    def __init__(self, tree: VantageTree, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.tree, self.anchor, self.norm = tree, anchor, float(anchor.astype(np.float64) @ anchor.astype(np.float64))
        self.order = np.argsort(low, kind="stable")
        self.low, self.high = low[self.order], high[self.order]
        # roots of differences of large squares: this much they may be off, and a little more
        self.slack = 1e-6 * (1 + np.sqrt(self.norm + tree.most))
        self.rows, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)
        self.read = np.zeros(len(low), bool)

    def _open(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of leaves that nobody has read yet."""
        rows = np.concatenate([np.arange(i, j) for i, j in self.tree.spans[self.order[leaves]]])
        scores = inner(self.tree.x[rows], self.anchor[None, :])[:, 0]
        self.rows, self.scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        self.read[leaves] = True
        return rows, scores

    def first(self, k: int, least: int | None, most: int | None, takes, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of ``best`` and of the rows that ``takes`` chooses with scores from ``least`` to ``most``: ``(scores, ids)``, higher scores first, then smaller ids."""
        nearest, farthest = (0.0 if most is None else self.tree.distance(self.norm, most)), (np.inf if least is None else self.tree.distance(self.norm, least))
        scores, ids = best

        def met(rows, found):
            nonlocal scores, ids
            ok = takes(rows)
            if least is not None:
                ok &= found >= least
            if most is not None:
                ok &= found <= most
            if ok.any():
                scores, ids = np.concatenate([scores, found[ok]]), np.concatenate([ids, self.tree.ids[rows[ok]]])
                at = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[at], ids[at]

        if len(self.rows):
            met(self.rows, self.scores)
        todo = np.flatnonzero((self.low <= farthest + self.slack) & (self.high >= nearest - self.slack) & ~self.read)
        at, width = 0, 1
        while at < len(todo):
            if len(scores) == k and self.low[todo[at]] > self.tree.distance(self.norm, scores[-1]) + self.slack:
                break
            met(*self._open(todo[at : at + width]))
            at, width = at + width, min(2 * width, 16)
        return scores, ids


@dataclass
class Anchors:
    """A block of anchors and what is asked of each."""

    ids: np.ndarray
    labels: np.ndarray
    x: list[np.ndarray]
    #: ``(anchor, least, most)`` of each window; none: the first rows of the anchor's own label are asked for.
    windows: np.ndarray | None = None


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """``(ask, id, score)``: the first ``k`` rows of a task for each anchor or window."""
    asked = sent.value
    n = len(asked.ids) if asked.windows is None else len(asked.windows)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
    dims = np.array([len(v) for v in asked.x])
    asks: dict[int, list[tuple[int, int | None, int | None]]] = {}
    for i, (a, least, most) in enumerate(([(a, None, None) for a in range(n)] if asked.windows is None else asked.windows.tolist())):
        asks.setdefault(a, []).append((i, least, most))
    held: list[tuple[np.ndarray, np.ndarray, list]] = []

    def searched():
        ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        vectors = [v for h in held for v in h[2]]
        held.clear()
        size = np.array([len(v) for v in vectors])
        for dim in np.unique(size):
            rows, some = np.flatnonzero(size == dim), np.flatnonzero(dims == dim)
            some = [a for a in some.tolist() if a in asks]
            if not some:
                continue
            tree = VantageTree(ids[rows], labels[rows], np.stack([vectors[i] for i in rows]))
            low, high = tree.bounds(np.stack([asked.x[a] for a in some]))
            for at, a in enumerate(some):
                one = Search(tree, asked.x[a], low[at], high[at])
                if asked.windows is None:
                    takes = lambda r, a=a: (tree.labels[r] == asked.labels[a]) & (tree.ids[r] != asked.ids[a])
                else:
                    takes = lambda r, a=a: tree.labels[r] != asked.labels[a]
                for i, least, most in asks[a]:
                    best[i] = one.first(k, least, most, takes, best[i])

    waiting = 0
    for b in batches:
        for at in range(0, b.num_rows, SHARD):
            part = b.slice(at, SHARD)
            if waiting + part.num_rows > SHARD:
                searched()
                waiting = 0
            waiting += part.num_rows
            held.append((part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy(), _rows(part.column(2))))
    if held:
        searched()
    many = [len(s) for s, _ in best]
    if sum(many):
        ids = np.concatenate([i for _, i in best])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), many)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in best]))], ["ask", "id", "score"])


def _rows(lists: pa.Array) -> list[np.ndarray]:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []


def mined(rows: DataFrame, anchor: Column, *, scale: int = 256, n_positives: int = 5, k: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``anchor`` holds and whose id isn't null. Components become ``floor(scale * x)``, and a score is
    the inner product of such rows; higher scores come first, then smaller ids, null ids last. An anchor's positives are its
    first ``n_positives`` rows of the same label and another id; for each of them its negatives are the first ``k`` rows of
    another label whose score is from ``least`` to ``most`` hundredths of the positive's, so a positive with a score below
    0 has none. Rows with a null label, a null vector or a component that is null or not finite take no part; vectors of
    different lengths have no score. Rows that repeat an id count one by one, also as anchors. Scores beyond 64 bits aren't
    defined. Labels are compared by a 64-bit hash of their text. Other columns aren't read.

    Anchors are collected in blocks of about ``block`` by a hash of the id, however many there are; every block passes all rows.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "negatives")
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kept = rows.where(good).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("label"), whole.alias("v"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor"))
    kept = work.save(kept, "rows")
    chosen = kept.where("anchor")
    blocks = 1 + chosen.count() // block
    out = None
    for i in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        found = _block(kept, part.select("id", "label", "v"), work, i, n_positives, k, least, most)
        out = found if out is None else out.unionByName(found)
    return out


def _block(kept: DataFrame, chosen: DataFrame, work: Workspace, number: int, n_positives: int, k: int, least: int, most: int) -> DataFrame:
    spark = kept.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id")]
    got = chosen.toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    asked = Anchors(got.column("id").to_numpy(), got.column("label").to_numpy(), _rows(got.column("v").combine_chunks()))

    def searched(asked: Anchors, k: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)
        return first_in_groups(kept.select("id", "label", "v").mapInArrow(lambda batches: lean(_searched(batches, sent, k)), "ask int, id long, score long"), ["ask"], order, k, "rank")

    # at most n_positives rows of each anchor of the block
    positives = work.save(searched(asked, n_positives), f"positives-{number}").toArrow().sort_by([("ask", "ascending"), ("rank", "ascending")])
    at, score, other = (positives.column(c).combine_chunks() for c in ("ask", "score", "id"))
    at, score = at.to_numpy().astype(np.int64), score.to_numpy()
    # hundredths: 100 * negative >= least * positive and <= most * positive, in whole numbers
    windows = np.column_stack([at, -(-least * score // 100), most * score // 100]) if len(at) else np.empty((0, 3), np.int64)
    found = work.save(searched(Anchors(asked.ids, asked.labels, asked.x, windows), k), f"negatives-{number}")
    asks = pa.table({"ask": pa.array(np.arange(len(at), dtype=np.int32)), "anchor_id": pa.array(asked.ids[at], pa.int64()), "positive_id": other, "positive_score": pa.array(score, pa.int64())})
    asks = spark.createDataFrame(asks)
    return found.join(F.broadcast(asks), "ask").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
