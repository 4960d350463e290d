"""Hard negatives for anchors, found with score bounds along a spanning tree of the anchors.

A score is the inner product of integer vectors. If a parent anchor's score with a candidate is known to
lie in an interval, a child anchor's lies in the same interval widened on both sides by the distance of
the two anchors times the candidate's norm. Anchors in blocks of ``BLOCK`` form a minimum spanning tree
each; a root is scored against every candidate, and every other anchor takes its bounds from its
parent and rescores only the candidates whose interval meets a window that it is looking for:

* first its best rows of its own label: the window begins at the last of the best found so far;
* then, for each of these positives, rows of other labels in a window of shares of the positive's score;
  the window's lower end rises to the last of the best found in it so far.

Candidates stay where they are: a pass sends ``ANCHORS`` anchors at most, with their trees and windows, to
all tasks, and a task returns its best rows of each window. Blocks are cut from the anchors in the order
of a code of random hyperplanes, so that a block's anchors lie close and its tree's edges are short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import prepare
from trawl.llm.ordering import numbered
from trawl.session import stored

SCALE = 256
LARGEST = 1 << 26    # components are cut off here, so that scores of 1,024 of them fit 62 bits
BLOCK = 512          # anchors of a tree
ANCHORS = 16_384     # anchors that are sent to all tasks at once
CODE_BITS = 16
NO_ID = np.int64(2**63 - 1)


@dataclass
class Tree:
    """A block's anchors, parents before their children; ``parent`` is -1 for the root."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    depth: np.ndarray


@dataclass
class Windows:
    """Windows of a block's anchors in order: the anchor's place, the window's number and its ends."""

    anchor: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, distance to it) of a minimum spanning tree grown from the first row.

    Parents are places in the order.
    """
    n = len(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    order, parent, edge = [0], np.full(n, -1), np.zeros(n)
    nearest = np.full(n, np.inf)
    by = np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    left[0] = False
    while len(order) < n:
        new = order[-1]
        apart = squares + squares[new] - 2 * (vectors @ vectors[new])
        closer = left & (apart < nearest)
        nearest[closer], by[closer] = apart[closer], len(order) - 1
        at = int(np.argmin(np.where(left, nearest, np.inf)))
        left[at] = False
        parent[len(order)] = by[at]
        edge[len(order)] = np.linalg.norm(vectors[at] - vectors[order[by[at]]])
        order.append(at)
    return np.array(order), parent, edge


def padded(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors of 32-bit integers as rows of doubles; a shorter one is filled with zeros."""
    out = np.zeros((len(raw), width))
    for i, value in enumerate(raw):
        row = np.frombuffer(value, dtype="<i4")
        out[i, :len(row)] = row
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as integers; in doubles where these are sure to be exact."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < k]


class Search:
    """The best k rows of each window of one block, over the candidates seen so far."""

    def __init__(self, tree: Tree, windows: Windows, same: bool, k: int) -> None:
        self.tree, self.windows, self.same, self.k = tree, windows, same, k
        self.low = windows.low.astype(np.float64)    # rises as better rows are found
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.rescored = self.met = 0
        levels = np.unique(tree.depth)
        self.levels = [np.flatnonzero(tree.depth == d) for d in levels]
        self.of_level = [np.flatnonzero(np.isin(windows.anchor, rows)) for rows in self.levels]

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        tree, n = self.tree, len(ids)
        norms = np.linalg.norm(vectors, axis=1)
        lowest = np.empty((len(tree.ids), n))
        highest = np.empty((len(tree.ids), n))
        for anchors, wanted in zip(self.levels, self.of_level, strict=True):
            above = tree.parent[anchors]
            if above[0] < 0:
                known = scores(tree.vectors[anchors], vectors)
                lowest[anchors] = highest[anchors] = known
                exact = np.ones((len(anchors), n), dtype=bool)
                self.rescored += n
            else:
                # A little is added, since distances and norms are rounded.
                reach = tree.edge[anchors, None] * norms * (1 + 1e-9) + 1e-6 * (tree.edge[anchors, None] > 0)
                lowest[anchors] = lowest[above] - reach
                highest[anchors] = highest[above] + reach
                exact = lowest[anchors] == highest[anchors]
                near = self._meeting(anchors, wanted, ids, labels, lowest, highest) & ~exact
                self._rescore(anchors, near, vectors, lowest, highest)
                exact |= near
            self.met += len(anchors) * n
            self._keep(anchors, wanted, ids, labels, lowest, highest, exact)

    def _labels_fit(self, window: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        at = self.windows.anchor[window]
        alike = self.tree.labels[at, None] == labels[None, :]
        return alike & (self.tree.ids[at, None] != ids[None, :]) if self.same else ~alike

    def _meeting(self, anchors, wanted, ids, labels, lowest, highest) -> np.ndarray:
        """Which candidates' intervals meet a window of the anchors."""
        w = self.windows
        at = w.anchor[wanted]
        meets = (highest[at] >= self.low[wanted, None]) & (lowest[at] <= w.high[wanted, None])
        meets &= self._labels_fit(wanted, ids, labels)
        out = np.zeros((len(anchors), len(ids)), dtype=bool)
        some, first = np.unique(at, return_index=True)    # windows are in the order of their anchors
        if len(some):
            out[np.searchsorted(anchors, some)] = np.logical_or.reduceat(meets, first, axis=0)
        return out

    def _rescore(self, anchors, near, vectors, lowest, highest) -> None:
        for row, anchor in enumerate(anchors):
            some = np.flatnonzero(near[row])
            if len(some):
                self.rescored += len(some)
                known = scores(self.tree.vectors[anchor:anchor + 1], vectors[some])[0]
                lowest[anchor, some] = highest[anchor, some] = known

    def _keep(self, anchors, wanted, ids, labels, lowest, highest, exact) -> None:
        w = self.windows
        at = w.anchor[wanted]
        hit = exact[np.searchsorted(anchors, at)] & (highest[at] >= self.low[wanted, None]) & (
            lowest[at] <= w.high[wanted, None]) & self._labels_fit(wanted, ids, labels)
        i, j = np.nonzero(hit)
        if not len(i):
            return
        group = np.concatenate([self.held[0], wanted[i]])
        score = np.concatenate([self.held[1], lowest[at[i], j].astype(np.int64)])
        found = np.concatenate([self.held[2], ids[j]])
        kept = best_of(group, score, found, self.k)
        self.held = group[kept], score[kept], found[kept]
        full, size = np.unique(self.held[0], return_counts=True)
        full = full[size == self.k]
        last = np.full(len(w.anchor), np.iinfo(np.int64).max)
        np.minimum.at(last, self.held[0], self.held[1])
        self.low[full] = np.maximum(self.low[full], last[full])


def _searched(batches: Iterator[pa.RecordBatch], work: Broadcast, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    searches = [Search(tree, windows, same, k) for tree, windows in work.value if len(windows.anchor)]
    width = max([s.tree.vectors.shape[1] for s in searches], default=0)
    for batch in batches:
        ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
        labels = batch.column(1).to_numpy()
        raw = batch.column(2).to_pylist()
        vectors = padded(raw, max([width, *(len(v) // 4 for v in raw)]))
        for search in searches:
            mine = search.tree.vectors
            if mine.shape[1] < vectors.shape[1]:
                search.tree.vectors = np.pad(mine, ((0, 0), (0, vectors.shape[1] - mine.shape[1])))
            search.add(ids, labels, vectors[:, :search.tree.vectors.shape[1]])
    for search in searches:
        group, score, found = search.held
        if len(group):
            yield pa.RecordBatch.from_arrays(
                [pa.array(search.windows.number[group]), pa.array(found), pa.array(score)],
                names=["window", "_id", "score"])


def _quantised(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[pa.RecordBatch]:
    """Usable rows with their integer vector and a code of the sides of hyperplanes it lies on."""
    normals: dict[int, np.ndarray] = {}   # by vector length; the same in every task
    for batch in batches:
        kept, raw, code = [], [], []
        for i, (label, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if label is None or v is None or None in v:
                continue
            x = np.array(v, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.clip(np.floor(SCALE * np.clip(x, -LARGEST, LARGEST)), -LARGEST, LARGEST)
            if len(q) not in normals:
                normals[len(q)] = np.random.default_rng(5).standard_normal((planes, len(q)))
            sides = normals[len(q)] @ q > 0
            kept.append(i)
            raw.append(q.astype("<i4").tobytes())
            code.append(int(sides @ (1 << np.arange(planes))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())),
             pa.array(raw, pa.binary()), pa.array(code, pa.int64())], names=["_id", "label", "vector", "code"])


TREE = "block long, number long, place int, _id long, label long, vector binary, parent int, edge double, depth int"


def _trees(table: pa.Table) -> pa.Table:
    """A block's anchors in the order of its spanning tree."""
    raw = table.column("vector").to_pylist()
    order, parent, edge = spanning_tree(padded(raw, max(len(v) // 4 for v in raw)))
    depth = np.zeros(len(order), dtype=np.int32)
    for i in range(1, len(order)):
        depth[i] = depth[parent[i]] + 1
    there = table.take(pa.array(order))
    return pa.table({"block": there["block"], "number": there["number"], "place": np.arange(len(order), dtype=np.int32),
                     "_id": there["_id"], "label": there["label"], "vector": there["vector"],
                     "parent": parent.astype(np.int32), "edge": edge, "depth": depth})


def _id(value: int) -> int | None:
    return None if value == NO_ID else value


def _blocks(rows: list) -> list[Tree]:
    out = []
    for block in sorted({r["block"] for r in rows}):
        mine = sorted((r for r in rows if r["block"] == block), key=lambda r: r["place"])
        raw = [r["vector"] for r in mine]
        # Breadth first, so that the anchors of a level stand together.
        by = np.lexsort(([r["place"] for r in mine], [r["depth"] for r in mine]))
        new = np.empty(len(by), dtype=np.int64)
        new[by] = np.arange(len(by))
        parent = np.array([r["parent"] for r in mine])
        out.append(Tree(
            np.array([r["number"] for r in mine])[by],
            np.array([NO_ID if r["_id"] is None else r["_id"] for r in mine])[by],
            np.array([r["label"] for r in mine])[by], padded(raw, max(len(v) // 4 for v in raw))[by],
            np.where(parent < 0, -1, new[parent])[by], np.array([r["edge"] for r in mine])[by],
            np.array([r["depth"] for r in mine])[by]))
    return out


def _best(rows: DataFrame, work: list, same: bool, k: int) -> DataFrame:
    """(window, _id, score, rank) of the first k rows of each window, over all candidates."""
    held = rows.sparkSession.sparkContext.broadcast(work)
    found = rows.select("_id", "label", "vector").mapInArrow(
        partial(_searched, work=held, same=same, k=k), "window long, _id long, score long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3,
                   least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x count as floor(256 x). An anchor's positives are the best ``n_positives`` rows of its
    label with another id. For each, the best ``n_negatives`` rows of other labels whose score is
    ``least`` to ``most`` percent of the positive's are returned, ranked from 1. Higher scores come
    first, of equal ones smaller ids (null ids last). Scores are exact and all rows are searched.

    Rows with a null label, a null vector or null or non-finite components take no part. Components
    beyond 262,144 are cut off there. Vectors of different lengths are compared as if the shorter one
    ended in zeros. Repeated rows are rows of their own: as candidates they are returned as often,
    but never for an anchor of the same id as its positives; as anchors each gives rows. Other
    columns are ignored, whatever their names. An empty table, or one without anchors, gives an empty
    result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)).alias("label"),
                           F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    with_flag = given.select(F.struct("_id", "_anchor").alias("_id"), "label", "vector")
    rows = stored(with_flag.mapInArrow(
        partial(_quantised, planes=CODE_BITS),
        "_id struct<_id: long, _anchor: boolean>, label long, vector binary, code long").select(
        "_id._id", "_id._anchor", "label", "vector", "code"), "hardneg-rows")
    anchors = numbered(rows.where("_anchor").drop("_anchor"), ["code", "_id"], "number", "hardneg-anchors")
    trees = stored(anchors.withColumn("block", F.expr(f"number div {BLOCK}")).groupBy("block").applyInArrow(
        _trees, TREE), "hardneg-trees")
    n = anchors.count()
    out = [_pass(rows, trees.where(F.col("number").between(at, at + ANCHORS - 1)).collect(), n_positives,
                 n_negatives, least, most) for at in range(0, n, ANCHORS)]
    if not out:
        out = [spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")]
    return reduce(DataFrame.unionByName, out)


def _pass(rows: DataFrame, anchors: list, n_positives: int, n_negatives: int, least: int, most: int) -> DataFrame:
    """The rows of ``ANCHORS`` anchors at most."""
    spark = rows.sparkSession
    blocks = _blocks(anchors)
    whole = [(t, Windows(np.arange(len(t.ids)), t.number, np.full(len(t.ids), -np.inf), np.full(len(t.ids), np.inf)))
             for t in blocks]
    positives = _best(rows, whole, True, n_positives).collect()
    by_anchor: dict[int, list] = {}
    for r in positives:
        by_anchor.setdefault(r["window"], []).append(r)
    work, asked = [], []
    for tree in blocks:
        at, number, low, high = [], [], [], []
        for place, (anchor, anchor_id) in enumerate(zip(tree.number.tolist(), tree.ids.tolist(), strict=True)):
            for r in sorted(by_anchor.get(anchor, []), key=lambda r: r["rank"]):
                ends = -(-least * r["score"] // 100), most * r["score"] // 100
                if ends[0] <= ends[1]:
                    at.append(place)
                    number.append(len(asked))
                    low.append(ends[0])
                    high.append(ends[1])
                    asked.append((len(asked), _id(anchor_id), _id(r["_id"]), r["score"]))
        work.append((tree, Windows(*(np.array(x, dtype=np.int64) for x in (at, number, low, high)))))
    names = spark.createDataFrame(asked, "window long, anchor_id long, positive_id long, positive_score long")
    found = stored(_best(rows, work, False, n_negatives).join(F.broadcast(names), "window"), "hardneg-found")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"),
                        F.when(F.col("_id") != int(NO_ID), F.col("_id")).alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
