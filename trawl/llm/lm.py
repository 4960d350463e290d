"""Hashed maximum-entropy language model with classes of words.

    P(word | history) = P(class | history) * P(word | class, word before)

Classes are the ``FREQUENT`` most frequent tokens, one each, and ``SUFFIXES`` classes of all others by
their last two bytes. Three kinds of features have weights:

* A successor feature is a pair of tokens that follow each other in training, however rare. P(word | class,
  word before) is the word's count plus one, with one more outcome per class for words that training has
  not seen, times the exponential of the pair's weight, normalised over the class. Words that are not held
  share their successor features with the others of their class and hash, ``SHARED`` in all.
* P(class | history) is a softmax over class scores. Each class has the log of what the successor
  features of the word before add to it, and weights of the history's hashed features: the classes of
  the two words before, the class of the word before the last, and that of the one before it. These
  features are hashed into ``ROWS`` rows of weights.
* A class's log share is its constant.

Counts come from all training texts. Successor weights are learnt by gradient steps with a Gaussian
prior, in tasks that hold all pairs of a word. The ``PAIRS`` most frequent pairs are held; places of the others
are brought together by pair, where their number gives the weight again. Hashed weights are
learnt in ``ROUNDS`` rounds that share out the training texts: each task takes gradient steps from the
round's weights over its texts, and the changes are averaged per row, weighted by how often a task used
the row. What the driver and the tasks hold has these bounds: the hashed weights, the held pairs, what
successors add to classes for each held token or shared feature, and the counts of at most ``HELD`` tokens,
the most frequent (of those with equal counts all or none), and of the end. Other tokens meet their counts
in a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm import bytewords, langid
from trawl.session import stored

FREQUENT, SUFFIXES = 31, 32
CLASSES = 1 + FREQUENT + SUFFIXES   # class 0 is the end of a text
ROWS = 1 << 13
ROUNDS = 3
HELD = 1 << 18
SHARED = 1 << 16        # features of tokens that are not held, the same number for each suffix
PAIRS = 1 << 21
HELD_FROM = 2           # pairs seen less often than this are never held
PAIR_STEPS, NEAR = 25, 1e-4   # steps at most, until no weight changes by more
WEIGHT_STEPS = 25
SPREAD = 3.0            # standard deviation that successor weights have beforehand
PAIRS_GATHERED = 1 << 22  # pairs that a task gathers before it counts them and passes them on
STEP = 0.8
LIMIT = 12.0    # of a weight, so that no score over- or underflows
MINIBATCH = 4096
END = 0x5EED0FE4D0C5E2D1 - 2**63    # stands for the hash of the end token


@dataclass
class Vocabulary:
    """Bounded facts of the training counts; arrays of held tokens are sorted by hash."""

    tokens: np.ndarray   # int64 hashes
    counts: np.ndarray
    classes: np.ndarray  # of held tokens
    table: langid.Table  # to find a held token's number
    logs: np.ndarray     # per class: log10 of the within-class denominator
    prior: np.ndarray    # per class: log share
    total: int           # training tokens
    uses: np.ndarray     # of held tokens, the start and the shared features: how often they occur
    mass: np.ndarray     # of the same: sum of their tokens' counts plus one
    kinds: np.ndarray    # of the same: their class

    @property
    def start(self) -> int:
        """The number that stands for a text's start, after those of the held tokens."""
        return len(self.tokens)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"table": langid.Table(state["tokens"].view(np.uint64))}


@dataclass
class Successors:
    """Weights of held pairs, and per word before, the log of what all its pairs add to each class."""

    pairs: langid.Table
    weights: np.ndarray
    rows: np.ndarray     # the first row is zero
    row_of: np.ndarray   # of each number that a word before may have

    def __getstate__(self) -> dict:
        """As sent to tasks: without the table, which they make again, and without zeros."""
        some = self.rows != 0
        return self.__dict__ | {"pairs": self.pairs.keys, "rows": (self.rows.shape, np.packbits(some), self.rows[some])}

    def __setstate__(self, state: dict) -> None:
        shape, some, values = state["rows"]
        rows = np.zeros(shape, dtype=np.float32)
        rows[np.unpackbits(some, count=rows.size).reshape(shape).astype(bool)] = values
        self.__dict__ = state | {"pairs": langid.Table(state["pairs"]), "rows": rows}

    def of_pairs(self, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pair's weight, 0 where it is not held; whether it is held)."""
        found = self.pairs.find(pair_keys(before, at))
        if not len(self.weights):
            return np.zeros(len(at)), np.zeros(len(at), dtype=bool)
        return np.where(found >= 0, self.weights[found], 0), found >= 0


@dataclass
class Tokens:
    """Tokens of a chunk with their ends: text d has tokens ``bounds[d]`` up to ``bounds[d + 1]``."""

    rows: slice
    bounds: np.ndarray
    hashes: np.ndarray
    suffixes: np.ndarray


def tokens(texts: pa.Array) -> Iterator[Tokens]:
    for found in bytewords.words(texts):
        n, docs = len(found.hashes), len(found.counts)
        bounds = found.bounds + np.arange(docs + 1)
        place = np.arange(n) + np.repeat(np.arange(docs), found.counts)
        hashes = np.full(n + docs, END, dtype=np.int64)
        hashes[place] = found.hashes.view(np.int64)
        last = found.data[found.ends - 1].astype(np.uint32) if n else np.zeros(0, np.uint32)
        before = found.data[np.maximum(found.ends - 2, found.starts)].astype(np.uint32) if n else last
        suffix = np.zeros(n + docs, dtype=np.int64)
        suffix[place] = ((last * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % SUFFIXES
        yield Tokens(found.rows, bounds, hashes, suffix)


def classes(found: Tokens, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, its number among the held tokens or -1)."""
    at = vocabulary.table.find(found.hashes.view(np.uint64)).astype(np.int64)
    own = np.where(at >= 0, vocabulary.classes[at], -1) if len(vocabulary.tokens) else at
    out = np.where(own >= 0, own, 1 + FREQUENT + found.suffixes)
    out[found.bounds[1:] - 1] = 0
    return out, at


def numbers(found: Tokens, at: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The number of each token for successor features: that of the held token or of its shared feature."""
    own = SHARED // SUFFIXES
    return np.where(at >= 0, at, vocabulary.start + 1 + found.suffixes * own + found.hashes % own)


def words_before(found: Tokens, number: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Number of the token before each one, or that of the start."""
    out = np.concatenate([[-1], number[:-1]])
    out[found.bounds[:-1]] = vocabulary.start
    return out


def pair_keys(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One key per pair of numbers."""
    return before.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)


def pair_ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def features(found: Tokens, kinds: np.ndarray) -> np.ndarray:
    """Rows of weights for each token's history, one column per feature."""
    n = len(found.hashes)
    past = np.arange(n) - np.repeat(found.bounds[:-1], np.diff(found.bounds))  # tokens before it in its text

    def back(values: np.ndarray, steps: int, missing: np.uint64) -> np.ndarray:
        out = np.full(n, missing, dtype=np.uint64)
        if n > steps:
            out[steps:] = values[:n - steps]
        out[past < steps] = missing
        return out

    kind = kinds.astype(np.uint64)
    k1, k2, k3 = (back(kind, i, np.uint64(CLASSES)) for i in (1, 2, 3))
    histories = (k1 * np.uint64(997) + k2, k2, k3)
    mixes = [bytewords.mixed(h * np.uint64(5) + np.uint64(i)) for i, h in enumerate(histories, 1)]
    return np.stack([(x >> np.uint64(40)).astype(np.int64) % ROWS for x in mixes], axis=1)


def exp_scores(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray,
               pairs: Successors, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of each class's score, one row per token; the sums of the rows)."""
    scores = weights[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        scores += weights[rows[:, i]]
    scores += prior
    scores += pairs.rows[pairs.row_of[before]]
    np.exp(scores, out=scores)
    return scores, scores @ np.ones(CLASSES, dtype=np.float32)


def group_sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct groups, number of rows of each, sum of each one's rows), by halving the rows."""
    order = np.argsort(groups.astype(np.uint16), kind="stable")
    ordered = groups[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    values = values[order]
    left = np.repeat(size, size) - np.arange(len(ordered)) + np.repeat(first, size)  # rows to the group's end
    place = np.arange(len(ordered)) - np.repeat(first, size)
    step = 1
    while step < size.max():
        at = np.flatnonzero((place & (2 * step - 1) == 0) & (left > step))
        values[at] += values[at + step]
        step *= 2
    return ordered[first], size, values[first]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in tokens(batch.column(0)):
            unique, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique), pa.array(found.suffixes[first]), pa.array(n)], names=["token", "suffix", "n"])


BLOCK = "part int, base long, before array<int>, at array<int>, mark array<int>, token array<long>"


def _blocks(keys: np.ndarray, marks: np.ndarray, parts: int, base: int = 0,
            token: np.ndarray | None = None) -> pa.RecordBatch:
    """Sorted pairs with a mark each, one row for each share of the words before."""
    before, at = pair_ends(keys)
    part = (bytewords.mixed(before.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = pa.array(np.append(first, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order].astype(np.int32))) for x in (before, at, marks)]
    tokens_ = pa.nulls(len(first), pa.list_(pa.int64())) if token is None else \
        pa.ListArray.from_arrays(bounds, pa.array(token[order]))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), base)), *lists, tokens_],
        names=["part", "base", "before", "at", "mark", "token"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(share of the words before, its blocks), from sorted blocks."""
    rows = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
    return itertools.groupby(rows, key=lambda row: row.column(0)[0].as_py())


def _keys(block: pa.RecordBatch) -> np.ndarray:
    return pair_keys(*(block.column(i).flatten().to_numpy() for i in (2, 3)))


def _paired(batches: Iterator[pa.RecordBatch], held: Broadcast, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's pairs with their counts, gathered before they leave it."""
    vocabulary = held.value
    keys: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for found in tokens(batch.column(0)):
            number = numbers(found, classes(found, vocabulary)[1], vocabulary)
            keys.append(pair_keys(words_before(found, number, vocabulary), number))
            size += len(keys[-1])
            if size > PAIRS_GATHERED:
                yield _blocks(*np.unique(np.concatenate(keys), return_counts=True), parts)
                keys, size = [], 0
    if keys:
        yield _blocks(*np.unique(np.concatenate(keys), return_counts=True), parts)


def pair_weights(n: np.ndarray, uses: np.ndarray, share: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weights of pairs seen n times, by Newton steps, given the sum over all successors of the word before."""
    scale = uses * share / whole
    weight = np.clip(np.log(np.maximum(n - 0.5, 0.1) / scale), -2.0, LIMIT)
    for _ in range(WEIGHT_STEPS):
        expected = scale * np.exp(weight)
        step = (n - expected - weight / SPREAD**2) / (expected + 1 / SPREAD**2)
        weight = np.clip(weight + np.clip(step, -1, 1), -LIMIT, LIMIT)
        if np.abs(step).max(initial=0) < NEAR / 10:   # the error is of the order of its square
            break
    return weight.astype(np.float32)


def fitted(keys: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of each of the sorted pairs, which are all of their words before; the words before; the sum over
    each one's successors), by gradient steps scaled by the curvature."""
    before, at = pair_ends(keys)
    group = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    uses, share = vocabulary.uses[before], vocabulary.uses[at] / vocabulary.total
    weight = np.clip(np.log(np.maximum(n - 0.5, 0.1) / (uses * share)), -2.0, LIMIT)
    for _ in range(PAIR_STEPS):
        odds = share * np.exp(weight)
        whole = 1 + np.add.reduceat(odds - share, first)
        p = odds / whole[group]
        slope = n - uses * p - weight / SPREAD**2
        curve = uses * p * (1 - np.minimum(p, 1)) + 1 / SPREAD**2
        step = np.clip(0.7 * slope / curve, -1, 1)
        weight = np.clip(weight + step, -LIMIT, LIMIT)
        if np.abs(step).max() < NEAR:
            break
    whole = 1 + np.add.reduceat(share * np.expm1(weight), first)
    return pair_weights(n, uses, share, whole[group]), before[first], whole


def successor_weights(keys: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    return fitted(keys, n, vocabulary)[0]


def class_offsets(keys: np.ndarray, weights: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The log of what sorted pairs add to each class, one row for each word before."""
    before, at = pair_ends(keys)
    group = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    kind = vocabulary.kinds[at]
    added = vocabulary.mass[at] / 10 ** vocabulary.logs[kind] * np.expm1(weights.astype(np.float64))
    sums = np.bincount(group * CLASSES + kind, weights=added, minlength=(group[-1] + 1) * CLASSES)
    return np.log1p(sums).astype(np.float32).reshape(-1, CLASSES)


def _fitted(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per word before: the sum over its successors, what they add to classes, and its pairs that may be held."""
    vocabulary = held.value

    def added(keys, n):
        order = np.argsort(keys := np.concatenate(keys), kind="stable")
        keys, n = keys[order], np.concatenate(n)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    for _, blocks in _by_part(batches):
        keys, n, size = [], [], 0
        for block in blocks:
            keys.append(_keys(block))
            n.append(block.column(4).flatten().to_numpy().astype(np.int64))
            size += len(n[-1])
            if size > 2 * PAIRS_GATHERED:
                keys, n = ([x] for x in added(keys, n))
                size = len(n[0])
        keys, n = added(keys, n)
        weights, before, whole = fitted(keys, n, vocabulary)
        offsets = class_offsets(keys, weights, vocabulary)
        often = n >= HELD_FROM
        bounds = np.searchsorted(pair_ends(keys[often])[0], np.append(before, before[-1] + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(before), pa.array(whole), pa.array([row.tobytes() for row in offsets], pa.binary()),
             pa.ListArray.from_arrays(pa.array(bounds), pa.array(pair_ends(keys[often])[1].astype(np.int32))),
             pa.ListArray.from_arrays(pa.array(bounds), pa.array(n[often])),
             pa.ListArray.from_arrays(pa.array(bounds), pa.array(weights[often]))],
            names=["before", "whole", "offsets", "at", "n", "weight"])


def successors(keys: np.ndarray, weights: np.ndarray, vocabulary: Vocabulary) -> Successors:
    """All pairs as held ones, with their weights and what they add to classes."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    row_of = np.zeros(len(vocabulary.uses), dtype=np.int32)
    before = np.unique(pair_ends(keys)[0])
    row_of[before] = 1 + np.arange(len(before))
    rows = np.concatenate([np.zeros((1, CLASSES), np.float32), class_offsets(keys, weights, vocabulary)])
    return Successors(langid.Table(keys), weights, rows, row_of)


FETCHES = 8     # what successors add to classes reaches the driver in so many pieces


def _successors(train: DataFrame, vocabulary: Vocabulary, held: Broadcast, parts: int) -> tuple[Successors, np.ndarray]:
    """(the held pairs and what all pairs add to classes, the sum over the successors of each number)."""
    found = stored(_dealt(train.select("_text").mapInArrow(lambda b: _paired(b, held, parts), BLOCK)).mapInArrow(
        lambda b: _fitted(b, held), "before long, whole double, offsets binary, at array<int>, n array<long>, "
        "weight array<float>"), "lm-pairs")
    pairs = found.selectExpr("before", "inline(arrays_zip(at, n, weight))").selectExpr(
        "shiftleft(before, 32) | at as pair", "n", "weight")
    step = F.floor(8 * F.log2("n"))
    top = pairs.where(step >= _least_step(pairs, step, PAIRS)).select("pair", "weight").toArrow()
    whole = np.ones(len(vocabulary.uses))
    row_of = np.zeros(len(whole), dtype=np.int32)
    rows = np.zeros((1 + found.count(), CLASSES), dtype=np.float32)
    filled = 1
    for piece in range(FETCHES):
        some = found.where(F.pmod("before", F.lit(FETCHES)) == piece).select("before", "whole", "offsets").toArrow()
        before = some.column(0).to_numpy()
        whole[before] = some.column(1).to_numpy()
        row_of[before] = np.arange(filled, filled + len(before))
        for chunk in some.column(2).chunks:
            here = np.frombuffer(b"".join(chunk.to_pylist()), dtype=np.float32).reshape(-1, CLASSES)
            rows[filled:filled + len(here)] = here
            filled += len(here)
    keys, weights = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(keys)
    return Successors(langid.Table(keys[order]), weights[order], rows, row_of), whole


def _dealt(blocks: DataFrame) -> DataFrame:
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


def _least_step(counts: DataFrame, step: Column, most: int) -> int:
    """The lowest step of a count from which on at most ``most`` rows are left."""
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    over = [r["step"] for r, n in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if n > most]
    return over[0] + 1 if over else 0


def _trained(batches: Iterator[pa.RecordBatch], held: Broadcast, pairs: Broadcast,
             weights: Broadcast) -> Iterator[pa.RecordBatch]:
    """Gradient steps over a task's texts; yields each used row's change times its uses."""
    vocabulary, start = held.value, weights.value
    now, used = start.copy(), np.zeros(ROWS, dtype=np.float64)
    for batch in batches:
        for found in tokens(batch.column(0)):
            kinds, at = classes(found, vocabulary)
            rows, before = features(found, kinds), words_before(found, numbers(found, at, vocabulary), vocabulary)
            for a in range(0, len(kinds), MINIBATCH):
                part, k = rows[a:a + MINIBATCH], kinds[a:a + MINIBATCH]
                slope, total = exp_scores(now, vocabulary.prior, part, pairs.value, before[a:a + MINIBATCH])
                slope *= (-1 / total)[:, None]
                slope[np.arange(len(k)), k] += 1
                for i in range(part.shape[1]):
                    row, n, change = group_sums(slope, part[:, i])
                    used[row] += n
                    change *= (STEP / np.sqrt(used[row] + 1)).astype(np.float32)[:, None]
                    now[row] = np.clip(now[row] + change, -LIMIT, LIMIT)
    rows = np.flatnonzero(used)
    if len(rows):
        change = ((now[rows] - start[rows]) * used[rows, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(used[rows]), *(pa.array(change[:, k]) for k in range(CLASSES))],
            names=["row", "used", *(f"c{k}" for k in range(CLASSES))])


def token_logs(found: Tokens, kinds: np.ndarray, at: np.ndarray, vocabulary: Vocabulary, pairs: Successors,
               weights: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, but for log10 of its count plus one and for pairs that are not held."""
    number = numbers(found, at, vocabulary)
    before = words_before(found, number, vocabulary)
    own = np.where(at >= 0, pairs.of_pairs(before, number)[0], 0)
    return own / np.log(10) + _class_logs(found, kinds, before, vocabulary, pairs, weights)


def _class_logs(found: Tokens, kinds: np.ndarray, before: np.ndarray, vocabulary: Vocabulary, pairs: Successors,
                weights: np.ndarray) -> np.ndarray:
    """log10 of each token's class's probability over what the class adds up to after the word before."""
    rows = features(found, kinds)
    out = -vocabulary.logs[kinds]
    for a in range(0, len(kinds), MINIBATCH):
        k, b = kinds[a:a + MINIBATCH], before[a:a + MINIBATCH]
        exps, total = exp_scores(weights, vocabulary.prior, rows[a:a + MINIBATCH], pairs, b)
        out[a:a + MINIBATCH] += np.log10(exps[np.arange(len(k)), k] / total) - pairs.rows[pairs.row_of[b], k] / np.log(10)
    return out


def _scored(batches: Iterator[pa.RecordBatch], held: Broadcast, pairs: Broadcast,
            weights: Broadcast, parts: int) -> Iterator[pa.RecordBatch]:
    """Per text: number of tokens, what held tokens and classes add to it, and its other tokens with their
    pairs' weights. And, as blocks, the places of pairs that are not held: the text's row, twice, plus one where
    it is held out. There a token that is not held may be unknown, and is named."""
    vocabulary = held.value
    logs = np.log10(vocabulary.counts + 1.0)
    gathered: list[tuple] = []
    size = 0

    def passed():
        keys, rows, out, rare, hashes = (np.concatenate(x) for x in zip(*gathered))
        base = int(rows.min())
        for some, named in ((~rare, False), (rare, True)):
            some = np.flatnonzero(some)
            if len(some):
                some = some[np.argsort(keys[some], kind="stable")]
                yield _with_nulls(_blocks(keys[some], 2 * (rows[some] - base) + out[some], parts, base,
                                          hashes[some] if named else None), columns)

    columns: pa.Schema | None = None
    for batch in batches:
        for found in tokens(batch.column(1)):
            ids = batch.column(0)[found.rows.start:found.rows.stop]
            kinds, at = classes(found, vocabulary)
            number = numbers(found, at, vocabulary)
            before = words_before(found, number, vocabulary)
            weight, whether = pairs.value.of_pairs(before, number)
            known = at >= 0
            share = _class_logs(found, kinds, before, vocabulary, pairs.value, weights.value)
            share += np.where(known, weight, 0) / np.log(10)
            counted = np.zeros(len(kinds))
            counted[known] = logs[at[known]]
            starts = found.bounds[:-1]
            rest = np.flatnonzero(~known)
            place = pa.array(np.searchsorted(rest, found.bounds).astype(np.int32))
            texts = pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(found.bounds)), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                 pa.array(np.add.reduceat(counted, starts)), pa.array(np.add.reduceat(share, starts)),
                 pa.ListArray.from_arrays(place, pa.array(found.hashes[rest])),
                 pa.ListArray.from_arrays(place, pa.array(weight[rest].astype(np.float32)))],
                names=["_id", "n_tokens", "n_held", "held_logs", "share_logs", "others", "weights"])
            texts = _with_nulls(texts, _schema(texts.schema))
            columns = texts.schema
            yield texts
            open_ = np.flatnonzero(~whether)
            text = np.repeat(np.arange(len(starts)), np.diff(found.bounds))[open_]
            row, out = (ids.field(i).to_numpy(zero_copy_only=False)[text] for i in ("_row", "_held"))
            gathered.append((pair_keys(before[open_], number[open_]), row, out, out & ~known[open_], found.hashes[open_]))
            size += len(open_)
            if size > PAIRS_GATHERED // 2:
                yield from passed()
                gathered, size = [], 0
    if size:
        yield from passed()


def _schema(texts: pa.Schema) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([*texts, ("part", pa.int32()), ("base", pa.int64()), ("before", ints), ("at", ints),
                      ("mark", ints), ("token", pa.list_(pa.int64()))])


def _with_nulls(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with null columns for those that it lacks."""
    return pa.RecordBatch.from_arrays(
        [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema],
        schema=schema)


def _summed(batches: Iterator[pa.RecordBatch], held: Broadcast, whole: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per text, and per token that may be unknown, the weights of pairs that are not held. All places of such
    a pair are together, so those in training texts are its count."""
    vocabulary = held.value
    for _, blocks in _by_part(batches):
        keys, rows, out, named, hashes = [], [], [], [], []
        for block in blocks:
            mark = block.column(4).flatten().to_numpy()
            keys.append(_keys(block))
            rows.append(block.column(1)[0].as_py() + (mark >> 1).astype(np.int64))
            out.append(mark & 1)
            named.append(np.full(len(mark), block.column(5).null_count == 0))
            hashes.append(block.column(5).flatten().to_numpy() if named[-1].any() else np.zeros(len(mark), np.int64))
        keys, rows, out, named, hashes = map(np.concatenate, (keys, rows, out, named, hashes))
        distinct, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of[out == 0], minlength=len(distinct))
        seen = np.flatnonzero(n)
        before, at = pair_ends(distinct[seen])
        weight = np.zeros(len(distinct))
        weight[seen] = pair_weights(n[seen], vocabulary.uses[before], vocabulary.uses[at] / max(vocabulary.total, 1),
                                    whole.value[before])
        weight = weight[of]
        texts, of = np.unique(rows[~named], return_inverse=True)
        sums = np.bincount(of, weights=weight[~named], minlength=len(texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([texts, rows[named]])),
             pa.concat_arrays([pa.nulls(len(texts), pa.int64()), pa.array(hashes[named])]),
             pa.array(np.concatenate([sums, weight[named]]))], names=["_row", "token", "weight"])


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """(vocabulary, number of training tokens, number of distinct ones)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Tokens are held by whole steps of their count's logarithm, as many steps as fit.
    step = F.floor(16 * F.log2("n"))
    is_held = (step >= _least_step(counts, step, HELD)) | (F.col("token") == END)
    top = counts.where(is_held).toPandas().sort_values(["n", "token"], ascending=[False, True])
    tokens_, n = top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    kind = np.full(len(top), -1)
    frequent = np.flatnonzero(tokens_ != END)[:FREQUENT]
    kind[frequent] = 1 + np.arange(len(frequent))
    mass = np.zeros(CLASSES)
    for row in counts.where(F.col("token") != END).groupBy("suffix").agg(
            F.sum(F.col("n") + 1).alias("n")).collect():
        mass[1 + FREQUENT + row["suffix"]] = row["n"]
    suffixes = top["suffix"].to_numpy(np.int64)
    for i in frequent:
        mass[kind[i]] = n[i]
        mass[1 + FREQUENT + suffixes[i]] -= n[i] + 1
    mass[0] = n[tokens_ == END].sum()
    kind = np.where(kind >= 0, kind, 1 + FREQUENT + suffixes)
    kind[tokens_ == END] = 0
    order = np.argsort(tokens_)
    share = (mass + 1) / (mass + 1).sum()
    table = langid.Table(tokens_[order].view(np.uint64))
    own = SHARED // SUFFIXES
    shared = counts.where(~is_held).groupBy((F.col("suffix") * own + F.pmod("token", F.lit(own))).alias("feature")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("mass")).toPandas()
    uses, masses = (np.concatenate([x[order], [start], np.zeros(SHARED, np.int64)])
                    for x, start in ((n, n[tokens_ == END].sum()), (n + 1, 0)))
    at = len(top) + 1 + shared["feature"].to_numpy(np.int64)
    uses[at], masses[at] = shared["n"], shared["mass"]
    kinds = np.concatenate([kind[order], [0], 1 + FREQUENT + np.arange(SHARED) // own])
    return Vocabulary(tokens_[order], n[order], kind[order], table, np.log10(mass + 1), np.log(share).astype(np.float32),
                      int(total[0]), uses, masses, kinds), int(total[0]), int(total[1])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows for which ``held_out`` is not true are learnt from. A text is its words, A to Z lower-cased,
    and one end token; null texts count as empty. ``n_known`` counts tokens seen in training,
    ``base_score`` is the sum of log10((count + 1) / (train_tokens + distinct + 1)), ``score`` the
    model's log10 probability. Without training rows all probabilities come from empty counts.
    Equal ids stay apart; an empty table gives an empty result. Words are known by 64-bit hashes, and
    of words with equal counts those with smaller hashes have classes of their own first. Texts are
    read in whole; one longer than a chunk is a chunk of its own. Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(held_out, F.lit(False)).alias("_held"))
    train = rows.where("not _held").select("_id", "_text")
    counts = stored(train.select("_text").mapInArrow(_counted, "token long, suffix long, n long").groupBy(
        "token").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n")), "lm-counts")
    vocabulary, n, distinct = _vocabulary(counts)
    held = spark.sparkContext.broadcast(vocabulary)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, whole = _successors(train, vocabulary, held, parts)
    pairs, whole = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(whole)
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    columns = [f"c{k}" for k in range(CLASSES)]
    for turn in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(ROUNDS)) == turn).select("_text")
        now = spark.sparkContext.broadcast(weights)
        changes = part.mapInArrow(lambda b, now=now: _trained(b, held, pairs, now),
                                  "row long, used double, " + ", ".join(f"{c} float" for c in columns))
        mean = changes.groupBy("row").agg(*((F.sum(c) / F.sum("used")).alias(c) for c in columns)).toPandas()
        weights = weights.copy()
        weights[mean["row"].to_numpy()] += mean[columns].to_numpy(np.float32)
    now = spark.sparkContext.broadcast(weights)
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select(F.struct("_id", "_held", F.monotonically_increasing_id().alias("_row")).alias("_id"), "_text")
    found = stored(found.mapInArrow(
        lambda b: _scored(b, held, pairs, now, parts),
        f"_id struct<_id: {kind}, _held: boolean, _row: long>, n_tokens long, n_held long, held_logs double, "
        f"share_logs double, others array<long>, weights array<float>, {BLOCK}"), "lm-scored")
    open_ = found.where("part is not null").select("part", "base", "before", "at", "mark", "token")
    open_ = stored(_dealt(open_).mapInArrow(lambda b: _summed(b, held, whole), "_row long, token long, weight double"),
                   "lm-open")
    found = found.where("_id is not null")
    rare = found.select(F.col("_id._row").alias("_row"), F.explode(F.arrays_zip("others", "weights")).alias("o")).select(
        "_row", F.col("o.others").alias("token"), F.col("o.weights").cast("double").alias("weight"), F.lit(1).alias("one"))
    rare = rare.unionByName(open_.where("token is not null").withColumn("one", F.lit(0)))
    known = rare.join(counts.select("token", "n"), "token").groupBy("_row").agg(
        F.sum("one").alias("n"), F.sum(F.col("one") * F.log10(F.col("n") + 1) + F.col("weight") / np.log(10)).alias("logs"),
        F.sum(F.col("one") * F.log10(F.col("n") + 1)).alias("base_logs"))
    others = open_.where("token is null").groupBy("_row").agg((F.sum("weight") / np.log(10)).alias("open_logs"))
    none = F.lit(0.0)
    base = F.col("held_logs") + F.coalesce("base_logs", none)
    return found.withColumn("_row", F.col("_id._row")).join(known, "_row", "left").join(others, "_row", "left").select(
        F.col("_id._id").alias(id_col), F.col("_id._held").alias("held_out"), "n_tokens",
        (F.col("n_held") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.log10(F.lit(float(n + distinct + 1)))).alias("base_score"),
        (F.col("held_logs") + F.coalesce("logs", none) + F.coalesce("open_logs", none) + F.col("share_logs")).alias("score"))
