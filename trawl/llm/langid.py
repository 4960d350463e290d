"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of 0 to ``ORDER`` bytes with counts of the bytes that followed
them in training. A byte's probability in a context is n / (N + q) of its count n, the sum N of counts and
the number q of bytes seen there; q / (N + q) is the probability to escape to the context that is one byte
shorter, where the bytes seen in the longer one are left out (method C with exclusion). Below the empty
context all bytes left are equally likely. A text's code length is the sum over its bytes, with contexts
of zero bytes at its start, and the language with the shortest code is predicted.

The counts are frozen, so what a byte costs depends only on the ``ORDER`` bytes before it and itself: its
cost in every language is worked out once per gram in the trees, and what an escape costs once per
context. Bytes left out on an escape are those of one context, so the rescaling belongs to that context.
A text is then scored by looking up its longest known grams, all languages at once.

Counts come from all training texts; a tree keeps the most frequent grams of its language, by whole steps
of their count, as many as fit ``HELD``. A gram kept implies that its shorter ends are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm import bytewords
from trawl.llm.common import prepare, quoted, with_computed
from trawl.session import stored

ORDER = 4
# Grams of each length that a language keeps at most, and costs that the table of all languages holds.
HELD = 1 << 15
CELLS = 1 << 22
WINDOW = 1 << 18     # bytes of text that are looked up at once
KEPT_GRAMS = 1 << 21  # distinct grams that a training task gathers before it passes them on
_LENGTH = 8 * (ORDER + 1)
UNDECIDED = "und"


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << (8 * length)) - 1)


def _tagged(grams: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each gram, told apart from grams of other lengths."""
    return (grams & _mask(length)) | np.uint64(length << _LENGTH)


def grams(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> np.ndarray:
    """For the bytes ``at`` up to ``to``: each with the ``ORDER`` before it in its text, as one number."""
    lead = min(ORDER, at)
    raw = data[at - lead:to].astype(np.uint64)
    out = raw[lead:].copy()
    for k in range(1, ORDER + 1):
        skip = max(0, k - lead)
        if skip < len(out):
            out[skip:] |= raw[lead + skip - k:len(raw) - k] << np.uint64(8 * k)
    near = offsets[np.searchsorted(offsets, at - ORDER):np.searchsorted(offsets, to)]
    for k in range(ORDER):  # what lies before a text's first byte counts as zero
        own = near + k
        out[own[(own >= at) & (own < to)] - at] &= _mask(k + 1)
    return out


class Table:
    """Rows by 64-bit key: open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, place = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            unplaced = self.slots[place] != left
            left, place = left[unplaced], (place[unplaced] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        spread = (keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        place = self._home(keys)
        out = self.slots[place]
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(other):
            place[other] = (place[other] + 1) & (len(self.slots) - 1)
            out[other] = self.slots[place[other]]
            other = other[(out[other] >= 0) & (self.keys[out[other]] != keys[other])]
        return out


@dataclass
class Model:
    """Frozen costs in bits: one row per gram or context, one column per language."""

    languages: list[str]
    grams: Table
    costs: np.ndarray
    contexts: Table
    escapes: np.ndarray
    unseen: np.ndarray   # of a byte below the empty context

    def bits(self, found: np.ndarray) -> np.ndarray:
        """Cost of each gram's last byte, one column per language."""
        out = np.zeros((len(found), len(self.languages)), dtype=np.float32)
        left = np.arange(len(found))
        for length in range(ORDER + 1, 0, -1):
            at = self.grams.find(_tagged(found, length))
            known = at >= 0
            if length == ORDER + 1:
                out[known] = self.costs[at[known]]
            else:
                out[left[known]] += self.costs[at[known]]
            left, found = left[~known], found[~known]
            if not len(left):
                return out
            at = self.contexts.find(_tagged(found >> np.uint64(8), length - 1))
            escaped = at >= 0
            out[left[escaped]] += self.escapes[at[escaped]]
        out[left] += self.unseen
        return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, place of each key's run) of sorted keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], first


def build(counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """The model of (sorted grams, counts) by language and gram length."""
    n_langs = len(languages)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unseen = np.full(n_langs, 8.0)
    known: list[np.ndarray] = []      # by length - 1: grams of any language
    costs: list[np.ndarray] = []
    contexts: list[np.ndarray] = []   # by context length
    escapes: list[np.ndarray] = []
    likely: list[tuple[np.ndarray, np.ndarray]] = [empty] * n_langs   # grams one byte shorter, probabilities
    for length in range(1, ORDER + 2):
        per_language = []
        for k, name in enumerate(languages):
            found, n = counts.get((name, length), empty)
            context, first = _runs(found >> np.uint64(8))
            size = np.diff(np.append(first, len(found)))
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            whole = total + np.where(size < 256, size, 0)
            p = n / np.repeat(whole, size)
            escape = np.where(size < 256, size / np.maximum(whole, 1), 1.0)
            if length == 1:
                price = -np.log2(escape)
                if len(found):
                    unseen[k] = np.log2(max(1, 256 - len(found)))
            else:
                shorter, share = likely[k]
                same = share[np.searchsorted(shorter, found & _mask(length - 1))]
                rest = 1 - (np.add.reduceat(same, first) if len(first) else np.zeros(0))
                price = np.log2(np.maximum(rest, 1e-12)) - np.log2(escape)
            per_language.append((found, p, context, price))
            likely[k] = found, p
        known.append(np.unique(np.concatenate([f for f, *_ in per_language] + [empty[0]])))
        contexts.append(np.unique(np.concatenate([c for _, _, c, _ in per_language] + [empty[0]])))
        escape = np.zeros((len(contexts[-1]), n_langs))
        for k, (_, _, context, price) in enumerate(per_language):
            escape[np.searchsorted(contexts[-1], context), k] = price
        escapes.append(escape)
        grams_, shorter = known[-1], np.tile(unseen, (len(known[-1]), 1))
        if length > 1:
            shorter = costs[-1][np.searchsorted(known[-2], grams_ & _mask(length - 1))]
        cost = shorter + escape[np.searchsorted(contexts[-1], grams_ >> np.uint64(8))]
        for k, (found, p, _, _) in enumerate(per_language):
            cost[np.searchsorted(grams_, found), k] = -np.log2(p)
        costs.append(cost)

    def table(parts: list[np.ndarray], least: int) -> Table:
        return Table(np.concatenate([_tagged(x, length) for length, x in enumerate(parts, least)]))

    return Model(languages, table(known, 1), np.concatenate(costs).astype(np.float32), table(contexts, 0),
                 np.concatenate(escapes).astype(np.float32), unseen.astype(np.float32))


def _windows(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, int, int, np.ndarray]]:
    """(rows, offsets, at, to, grams) of consecutive bytes; a long text is several windows."""
    for rows, data, offsets in bytewords.chunks(texts, WINDOW):
        for at in range(0, len(data), WINDOW):
            to = min(at + WINDOW, len(data))
            yield rows, offsets, at, to, grams(data, offsets, at, to)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    joined, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(joined)
    distinct, first = _runs(joined[order])
    return distinct, np.add.reduceat(n[order], first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's grams of the longest kind with their counts, gathered before they leave it."""
    codes: dict[str, int] = {}
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def passed():
        found, n = _summed(keys, counts)
        names = pa.array(list(codes))
        code = pa.array((found >> np.uint64(_LENGTH)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [names.take(code), pa.array((found & _mask(ORDER + 1)).astype(np.int64)), pa.array(n)],
            names=["lang", "gram", "n"])

    for batch in batches:
        of = batch.column(0).dictionary_encode()
        own = np.array([codes.setdefault(x, len(codes)) for x in of.dictionary.to_pylist()], dtype=np.uint64)
        code = own[of.indices.to_numpy()] << np.uint64(_LENGTH)
        for rows, offsets, at, to, found in _windows(batch.column(1)):
            here = np.clip(offsets, at, to)
            distinct, n = np.unique(found | np.repeat(code[rows], np.diff(here)), return_counts=True)
            keys.append(distinct)
            counts.append(n.astype(np.int64))
            size += len(distinct)
            if size > KEPT_GRAMS:
                found, n = _summed(keys, counts)
                keys, counts, size = [found], [n], len(found)
                if size > KEPT_GRAMS // 2:
                    yield passed()
                    keys, counts, size = [], [], 0
    if keys:
        yield passed()


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows with a language and a text, however long; repeated rows count as often.

    Languages are a small stated set: the more there are, the fewer grams each of them keeps, so that
    the table of costs holds ``CELLS`` numbers at most. Without rows the model has no languages.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang is not null and text is not null")
    longest = stored(rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")), "langid-grams")
    ends = ", ".join(f"named_struct('length', {length}, 'gram', gram & {int(_mask(length))}L)"
                     for length in range(1, ORDER + 2))
    counts = stored(longest.selectExpr("lang", "n", f"inline(array({ends}))").groupBy("lang", "length", "gram").agg(
        F.sum("n").alias("n")), "langid-counts")
    step = F.floor(8 * F.log2("n")).cast("int")
    sizes = counts.groupBy("lang", "length", step.alias("step")).count().collect()
    languages = sorted({r["lang"] for r in rows.select("lang").distinct().collect()})
    most = max(1, min(HELD, CELLS // (max(1, len(languages)) ** 2 * (ORDER + 1))))
    least = {name: max((_least_step(sizes, name, length, most) for length in range(1, ORDER + 2)))
             for name in languages}
    kept = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least int")
    held = counts.join(F.broadcast(kept), "lang").where(step >= F.col("least")).select("lang", "length", "gram", "n")
    found = held.toPandas().sort_values(["lang", "length", "gram"])
    return build({(name, int(length)): (part["gram"].to_numpy(np.uint64), part["n"].to_numpy(np.int64))
                  for (name, length), part in found.groupby(["lang", "length"])}, languages)


def _least_step(sizes: list, language: str, length: int, most: int) -> int:
    """The lowest step from which on at most ``most`` grams of a length are kept."""
    mine = sorted(((r["step"], r["count"]) for r in sizes if r["lang"] == language and r["length"] == length),
                  reverse=True)
    total = 0
    for step, n in mine:
        total += n
        if total > most:
            return step + 1
    return 0


PREDICTED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("code_bits", T.DoubleType())])


def _predicted(batches: Iterator[pa.RecordBatch], model: Broadcast, kept: int) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        texts, letters = batch.column(kept), batch.column(kept + 1)
        bits = np.zeros((batch.num_rows, len(m.languages)))
        for rows, offsets, at, to, found in _windows(texts):
            here = np.clip(offsets, at, to) - at
            some = np.flatnonzero(here[1:] > here[:-1])
            if len(some):
                bits[rows.start + some] += np.add.reduceat(m.bits(found), here[some], axis=0, dtype=np.float64)
        sure = letters.to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
        lang = np.full(batch.num_rows, UNDECIDED, dtype=object)
        score, code = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        if m.languages:
            best = bits.argmin(axis=1)
            code = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(np.maximum(code[:, None] - bits, -1000)).sum(axis=1)
            lang[sure] = np.array(m.languages, dtype=object)[best[sure]]
            score[sure] = share[sure]
        made = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(code)],
                                          names=["lang_pred", "score", "code_bits"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], made], names=[*batch.schema.names[:kept], "made"])


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and code_bits, one row per input row.

    ``score`` is the language's share of 2 to the power of minus code bits over all languages; of equally
    short codes the first language by name is predicted. A text that is null or has no letter is
    ``und`` with score 0, and so is every text when the model has no languages. Whole texts are coded,
    in windows, so a very long one takes no more memory than it has bytes. Columns that are not kept
    are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col)
    inputs: list[Column] = [text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))]
    rows = with_computed(docs, keep, inputs, partial(_predicted, model=held, kept=len(keep)), "_made", PREDICTED)
    return rows.select(*quoted(keep), "_made.*")
