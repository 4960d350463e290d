"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics come from the whole text in one vectorised pass per batch. The trees are grown by
the driver from at most ``SAMPLE`` labelled rows: features are cut into ``BINS`` quantile bins, and each
split is the best of all bins of all features by summed gradients. Every tree is a complete
binary tree in flat arrays (children of node i are 2i + 1 and 2i + 2), so that scoring a batch is
``DEPTH`` gathers per tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trawl.llm import bytewords
from trawl.llm.common import first_by_hash, with_computed

SAMPLE = 20_000   # labelled rows the trees are grown from, at most
BINS, DEPTH, TREES = 64, 4, 80
RATE, RIDGE, LEAST_WEIGHT = 0.15, 2.0, 2.0

_MARKS = b"!?.,;:#$%&*|=<>{}[]()\"'-_/\\@+~^`"
FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digits", "not_ascii", "spaces",
    "lines_per_word", "words_per_line", "distinct_words", "repeated_lines", "repeated_triples", "commonest_word",
    "short_words", "capitalised", "marks", "ends_in_mark", "symbol_words", "sentence_ends", "commas", "bangs", "bars",
    "hashes_and_stars", "braces",
)


def _lookup(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_UPPER, _DIGIT = _lookup(bytes(range(65, 91))), _lookup(bytes(range(48, 58)))
_LETTER = _lookup(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_HIGH, _SPACE, _MARK = _lookup(bytes(range(128, 256))), _lookup(b" \t\n\r\x0b\x0c"), _lookup(_MARKS)
_SYMBOL = _lookup(b"#$%&*|=<>{}[]@+~^`\\")


def _per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a mask within each row's part of it."""
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, count of the commonest value) of each row."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = bytewords.mixed(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55))
    _, first, n = np.unique(own, return_index=True, return_counts=True)
    most = np.zeros(len(bounds) - 1, dtype=np.int64)
    np.maximum.at(most, rows[first], n)
    return np.bincount(rows[first], minlength=len(bounds) - 1), most


def statistics(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, one float32 row of ``FEATURES`` each); null texts count as empty, which is all zeros."""
    for found in bytewords.words(texts, lower=False):
        data, at, words = found.data, found.offsets, found.bounds
        size, n = np.diff(at), found.counts
        some, letters = np.maximum(size, 1), np.maximum(_per_row(_LETTER[data], at), 1)
        per_word = np.maximum(n, 1)
        length = found.ends - found.starts
        longest = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            longest[full] = np.maximum.reduceat(length, words[:-1][full])
        line_starts, line_ends, lines = bytewords.lines(data, at)
        line_hashes = bytewords.span_hashes(data, line_starts, line_ends)
        n_lines = np.maximum(np.diff(lines), 1)
        triples, triple_bounds = bytewords.shingles(found, 3)
        distinct, commonest = _distinct(found.hashes, words)
        first = data[found.starts] if len(found.starts) else data[:0]
        last = data[found.ends - 1] if len(found.ends) else data[:0]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
        with_symbol = symbols[found.ends] > symbols[found.starts]
        columns = (
            np.log1p(size), np.log1p(n), _per_row(~_SPACE[data], at) / per_word, np.log1p(longest),
            _per_row(_UPPER[data], at) / letters, _per_row(_DIGIT[data], at) / some, _per_row(_HIGH[data], at) / some,
            _per_row(_SPACE[data], at) / some, np.diff(lines) / per_word, np.log1p(n / n_lines), distinct / per_word,
            1 - _distinct(line_hashes, lines)[0] / n_lines * (np.diff(lines) > 0),
            1 - _distinct(triples, triple_bounds)[0] / np.maximum(np.diff(triple_bounds), 1),
            commonest / per_word, _per_row(length <= 3, words) / per_word, _per_row(_UPPER[first], words) / per_word,
            _per_row(_MARK[data], at) / some, _per_row(_MARK[last], words) / per_word,
            _per_row(with_symbol, words) / per_word, _per_row(_lookup(b".?")[data], at) / per_word,
            _per_row(data == ord(","), at) / per_word, _per_row(data == ord("!"), at) / per_word,
            _per_row(data == ord("|"), at) / per_word,
            _per_row(_lookup(b"#*$%&")[data], at) / per_word, _per_row(_lookup(b"{}[]<>()")[data], at) / per_word)
        out = np.stack(columns, axis=1).astype(np.float32)
        out[size == 0] = 0
        yield found.rows, out


@dataclass
class Forest:
    """Trees in flat arrays of shape (trees, nodes); a node past a leaf repeats the leaf's value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1 by logistic loss; without rows all scores are one half."""
    n, inner = len(x), 2**DEPTH - 1
    share = (y.sum() + 1) / (n + 2)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64),
                    np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if not n:
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)).astype(np.float32)
            for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    total, trees = np.full(n, forest.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, weight = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            here, width = 2**depth, x.shape[1] * BINS
            place = (node[:, None] * width + flat).ravel()
            g, h = (np.bincount(place, np.repeat(v, x.shape[1]), here * width).reshape(here, -1, BINS)
                    for v in (slope, weight))
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2)[:, :1, None], h.sum(axis=2)[:, :1, None]
            gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            split = gain.reshape(here, -1)[np.arange(here), best] > 1e-9
            f, b = np.divmod(best, BINS - 1)
            right = np.zeros(n, dtype=bool)
            for k in np.flatnonzero(split):
                if b[k] < len(cuts[f[k]]):
                    at = here - 1 + k
                    feature[at], threshold[at] = f[k], cuts[f[k]][b[k]]
                    own = node == k
                    right[own] = x[own, f[k]] > threshold[at]
            node = 2 * node + right
        leaves = 2**DEPTH
        value = RATE * np.bincount(node, slope, leaves) / (np.bincount(node, weight, leaves) + RIDGE)
        total += value[node]
        trees.append((feature, threshold, value))
    forest.feature, forest.threshold, forest.value = (np.stack(z) for z in zip(*trees, strict=True))
    return forest


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in statistics(batch.column(1)):
            places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows.start:rows.stop], pa.ListArray.from_arrays(places, pa.array(x.ravel()))],
                names=["label", "x"])


def _scores(batches: Iterator[pa.RecordBatch], forest: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [forest.value.score(x) for _, x in statistics(batch.column(batch.num_columns - 1))]
        out = np.concatenate(scores) if scores else np.zeros(0)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out)],
                                         names=[*batch.schema.names[:-1], "made"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Forest:
    """Grow the trees from the labelled rows for which ``usable`` is true.

    ``usable`` is a condition on the labels' id. Labels other than 0 and 1 and ids without a text row
    are left out; an id labelled twice is two rows. At most ``SAMPLE`` rows, chosen by a hash of the id,
    are used; they are broadcast to the documents, and only their statistics reach the driver.
    """
    fit_for = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    chosen = first_by_hash(fit_for, "_id", fit_for.count(), SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    some = rows.join(F.broadcast(chosen), "_id").select("label", "text")
    found = some.mapInArrow(_features, "label double, x array<float>").orderBy(F.xxhash64("x", "label")).limit(
        SAMPLE).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))
    return grow(x, found.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, forest: Forest, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``quality_score``, the probability of label 1.

    ``keep`` names the columns to return with it, by default all. Null and empty texts have all-zero
    statistics and are scored by them. Statistics are those of whole texts, however long; equal texts
    have equal scores. A column of that name is replaced. Repeated rows stay; an empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(forest)
    kept = [c for c in keep or docs.columns if c != "quality_score"]
    return with_computed(docs, kept, [F.col(text_col)], lambda batches: _scores(batches, held), "quality_score",
                         DoubleType())
