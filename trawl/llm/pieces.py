"""SentencePiece merge-type encoding with seeded merge dropout, and decoding.

A text becomes its characters, white space written as U+2581, after a leading one. Then the best
adjacent pair that is a piece is merged (highest score, leftmost of equals), again and again. A
candidate is skipped when a hash of (seed, id, unit's place, unit, place in unit, piece) falls below the
dropout rate. Characters without a piece become byte pieces, so decoding returns every text exactly.

No piece reaches from a letter into a following space, so a text is encoded in units: a run of spaces
with the word behind it, or one other white space character, unless longer pieces have it, as some do
a carriage return; then it belongs to the word. Every occurrence of a unit draws
for itself. What merging gives depends only on the unit and on which of its possible candidates are
skipped, so a worker merges each distinct (unit, set of skipped candidates) once, many new ones
together: every round merges the best pair of each unit. Units of more than ``LONG`` characters go
through an agenda of their own, each occurrence for itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from trawl.llm import bytewords
from trawl.llm.common import with_computed
from trawl.llm.memo import Memo

LONG = 64
KNOWN_UNITS = 1 << 20
KNOWN_POSSIBLE = 1 << 18    # units whose candidates are kept, which takes more memory
TOGETHER = 1 << 13      # units merged at once, so that their arrays stay in a core's cache
DRAWN = 1 << 14         # units whose candidates are drawn at once
SPACE = 0x2581
_SLOTS = 18             # of the pair table, as a power of two
_FAR = np.int32(2**31 - 1)
_NONE = np.iinfo(np.int32).min


@dataclass
class Vocabulary:
    """A model's pieces as arrays. Symbols are piece ids, or ``-1 - code point`` without a piece."""

    symbols: np.ndarray     # by code point
    pairs: np.ndarray       # left * 2^32 + right, or -1, in the slots of a hash table
    merged: np.ndarray      # by slot, the piece a pair makes
    ranks: np.ndarray       # by slot, 0: highest score; equal scores have equal ranks
    probes: int             # slots in which a pair may be
    byte_ids: np.ndarray    # by byte
    longest: int            # characters of the longest piece
    data: np.ndarray        # the pieces' text, white space as spaces, one after another
    offsets: np.ndarray
    alone: np.ndarray       # by byte: whether it is white space, no space, that no longer piece has


@lru_cache(maxsize=1)
def vocabulary(model: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    ids = {names[i]: i for i in range(n) if plain[i]}
    if any(chr(SPACE) in name.lstrip(chr(SPACE)) for name in ids):
        raise ValueError("a piece reaches from a word into white space")
    symbols = -1 - np.arange(0x110000, dtype=np.int32)
    byte_ids, texts = np.zeros(256, dtype=np.int64), []
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            texts.append(bytes([int(name[3:5], 16)]))
        else:
            texts.append(name.replace(chr(SPACE), " ").encode() if plain[i] else b"")
            if plain[i] and len(name) == 1:
                symbols[ord(name)] = i
    # Spaces take the sign's place; the sign itself has no piece, or it would decode to a space.
    symbols[32], symbols[SPACE] = symbols[SPACE], -1 - SPACE
    order = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
    rows = [(ids[name[:k]] << 32 | ids[name[k:]], i, order[sp.get_score(i)])
            for name, i in ids.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids]
    joined = {c for name in ids if len(name) > 1 for c in name}
    alone = np.array([9 <= b <= 13 and chr(b) not in joined for b in range(256)])
    return Vocabulary(symbols, *_pair_table(np.array(rows, dtype=np.int64).reshape(-1, 3)), byte_ids,
                      max(map(len, ids)),
                      np.frombuffer(b"".join(texts), dtype=np.uint8),
                      np.concatenate([[0], np.cumsum([len(t) for t in texts])]), alone)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C55) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _pair_table(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs, pieces, ranks, probes): each row in the first free slot from its hash on."""
    pairs, merged, ranks = (np.full(1 << _SLOTS, x, t) for x, t in ((-1, np.int64), (0, np.int32), (_FAR, np.int32)))
    probes, at = 0, _slot(rows[:, 0].copy())
    while len(rows):
        free = pairs[at] == -1
        _, first = np.unique(at, return_index=True)
        lucky = np.zeros(len(rows), dtype=bool)
        lucky[first] = True
        lucky &= free
        pairs[at[lucky]], merged[at[lucky]], ranks[at[lucky]] = rows[lucky].T
        rows, at = rows[~lucky], (at[~lucky] + 1) % (1 << _SLOTS)
        probes += 1
    return pairs, merged, ranks, probes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each) of UTF-8 bytes."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.int32)
    length = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    points = np.where(length == 1, lead, lead & (0xFF >> (length + 1)))
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
    for i in range(1, 4):
        more = length > i
        points[more] = points[more] << 6 | padded[starts[more] + i] & 0x3F
    return np.minimum(points, 0x10FFFF), starts


def _found(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which adjacent symbols make a piece, the slots of all)."""
    pair = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
    at = _slot(pair)
    open_ = np.flatnonzero(v.pairs[at] != pair)
    for _ in range(v.probes):   # most pairs are found, or their slot is empty, at once
        open_ = open_[v.pairs[at[open_]] != -1]
        if not len(open_):
            break
        at[open_] = (at[open_] + 1) % (1 << _SLOTS)
        open_ = open_[v.pairs[at[open_]] != pair[open_]]
    return np.flatnonzero((v.pairs[at] == pair) & (left >= 0) & (right >= 0)), at


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the occurrence of a unit with this key skips a piece at a place."""
    own = bytewords.mixed(key + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                          + piece.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return (own >> np.uint64(11)) * 2.0**-53 < dropout


def _candidates(v: Vocabulary, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray,
                dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged piece) of adjacent symbols; ``_FAR`` where they make no piece or are skipped."""
    found, at = _found(v, left, right)
    rank, piece = np.full(len(at), _FAR), np.zeros(len(at), dtype=np.int32)
    piece[found], rank[found] = v.merged[at[found]], v.ranks[at[found]]
    if dropout > 0:
        rank[found[_skipped(key[found], place[found], piece[found], dropout)]] = _FAR
    return rank, piece


def possible(v: Vocabulary, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each unit's candidates, candidates as ``place << 25 | piece``) that any merging can meet.

    A candidate is a piece at a place that some two pieces make which can be made themselves.
    """
    n = len(symbols)
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left_over = bounds[1:][unit] - np.arange(n)     # symbols from here to the unit's end
    made = [np.zeros(0, dtype=np.int32), np.where(symbols >= 0, symbols, -1).astype(np.int32)]
    for length in range(2, min(v.longest, int(left_over.max(initial=0))) + 1):
        now = np.full(n, -1, dtype=np.int32)
        for k in range(1, length):
            at = np.flatnonzero((made[k][:n - length + 1] >= 0) & (made[length - k][k:n - length + k + 1] >= 0))
            at = at[left_over[at] >= length]
            found, slots = _found(v, made[k][at], made[length - k][at + k])
            now[at[found]] = v.merged[slots[found]]
        made.append(now)
    at = [np.flatnonzero(now >= 0) for now in made[2:]]
    pieces = np.concatenate([now[x] for now, x in zip(made[2:], at, strict=True)] or [np.zeros(0, np.int32)])
    at = np.concatenate(at or [np.zeros(0, np.int64)])
    order = np.argsort(unit[at], kind="stable")
    places = (at - bounds[unit[at]]).astype(np.uint32)
    return (np.bincount(unit[at], minlength=len(bounds) - 1),
            (places << np.uint32(25) | pieces.astype(np.uint32))[order])


def merge_all(v: Vocabulary, symbols: np.ndarray, bounds: np.ndarray, keys: np.ndarray,
              dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of many units and the number of each, ``TOGETHER`` units at a time."""
    parts = [merge_together(v, symbols[bounds[a]:bounds[min(a + TOGETHER, len(keys))]],
                            bounds[a:a + TOGETHER + 1] - bounds[a], keys[a:a + TOGETHER], dropout)
             for a in range(0, len(keys), TOGETHER)]
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def merge_together(v: Vocabulary, symbols: np.ndarray, bounds: np.ndarray, keys: np.ndarray,
                   dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of these units and the number of each; every unit has one symbol at least."""
    unit = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(bounds))
    place = (np.arange(len(symbols)) - bounds[unit]).astype(np.int32)
    symbols = symbols.copy()
    last = np.zeros(len(symbols), dtype=bool)
    last[bounds[1:] - 1] = True
    rank, piece = _candidates(v, symbols, np.append(symbols[1:], -1), keys[unit], place, dropout)
    rank[last] = _FAR
    done_symbols, done_units, done_places = [], [], []
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        order = (rank.astype(np.int64) << 32) + np.arange(len(rank))
        best = np.minimum.reduceat(order, starts)
        going = best >> 32 < _FAR
        keep = np.repeat(going, np.diff(np.append(starts, len(symbols))))
        done_symbols.append(symbols[~keep])
        done_units.append(unit[~keep])
        done_places.append(place[~keep])
        at = best[going] & 0xFFFFFFFF
        symbols[at] = piece[at]
        keep[at + 1] = False
        last[at] = last[at + 1]
        new = np.cumsum(keep) - 1
        at = new[at]
        symbols, unit, place, rank, piece, last = (x[keep] for x in (symbols, unit, place, rank, piece, last))
        again = np.concatenate([at, at[at > 0] - 1])
        again = again[~last[again]]
        rank[at] = _FAR
        r, p = _candidates(v, symbols[again], symbols[np.minimum(again + 1, len(symbols) - 1)], keys[unit[again]],
                           place[again], dropout)
        rank[again], piece[again] = r, p
    symbols, unit, place = (np.concatenate(x) if x else np.zeros(0, np.int64)
                            for x in (done_symbols, done_units, done_places))
    order = np.lexsort((place, unit))
    return symbols[order], np.bincount(unit, minlength=len(keys))


def merge_by_agenda(v: Vocabulary, symbols: np.ndarray, key: np.uint64, dropout: float) -> np.ndarray:
    """Final symbols of one unit, its candidates taken from a heap: for long units."""
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank, piece = _candidates(v, symbols[:-1], symbols[1:], np.full(n - 1, key), np.arange(n - 1), dropout)
    agenda = [(int(rank[i]), i, int(symbols[i]), int(symbols[i + 1]), int(piece[i]))
              for i in np.flatnonzero(rank < _FAR)]
    heapq.heapify(agenda)
    while agenda:
        _, i, left, right, made = heapq.heappop(agenda)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = made, _NONE
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        near = np.array([k for k in (before[i], i) if k >= 0 and after[k] < n], dtype=np.int64)
        if len(near):
            r, p = _candidates(v, symbols[near], symbols[after[near]], np.full(len(near), key), near, dropout)
            for k, rk, pk in zip(near.tolist(), r.tolist(), p.tolist(), strict=True):
                if rk < _FAR:
                    heapq.heappush(agenda, (rk, k, int(symbols[k]), int(symbols[after[k]]), pk))
    return symbols[symbols != _NONE]


def _with_bytes(v: Vocabulary, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece written as byte pieces."""
    missing = np.flatnonzero(symbols < 0)
    if not len(missing):
        return symbols.astype(np.uint32), counts
    text = "".join(map(chr, (-1 - symbols[missing]).tolist())).encode(errors="surrogatepass")
    raw = np.frombuffer(text, dtype=np.uint8)
    points = -1 - symbols[missing]
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    width = np.ones(len(symbols), dtype=np.int64)
    width[missing] = sizes
    out = np.repeat(symbols, width)
    out[np.repeat(symbols < 0, width)] = v.byte_ids[raw]
    unit = np.repeat(np.arange(len(counts)), counts)
    return out.astype(np.uint32), np.bincount(unit, weights=width, minlength=len(counts)).astype(np.int64)


@dataclass
class Units:
    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def units(texts: pa.Array, alone: np.ndarray) -> Iterator[Units]:
    """The units of a batch of texts; a text that is not empty gets a leading space. Bytes that are
    ``alone`` are units of their own."""
    for rows, raw, offsets in bytewords.chunks(texts):
        full = np.diff(offsets) > 0
        data = np.insert(raw, offsets[:-1][full], 32)
        at = offsets + np.concatenate([[0], np.cumsum(full)])
        other = alone[data]
        first = other.copy()
        if len(data):
            first[1:] |= other[:-1]
            first[1:] |= (data[1:] == 32) & (data[:-1] != 32)
            first[at[:-1][full]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        yield Units(rows, data, starts, ends, np.searchsorted(starts, at), bytewords.span_hashes(data, starts, ends))


class Encoder:
    """Encodes batches of texts; keeps the merged units."""

    def __init__(self, model: str, dropout: float, seed: int) -> None:
        self.v, self.dropout, self.seed = vocabulary(model), dropout, np.uint64(seed % 2**64)
        self.known, self.possible = Memo(KNOWN_UNITS), Memo(KNOWN_POSSIBLE)

    def encode(self, texts: pa.Array, ids: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, piece ids of these rows one after another, number of ids per row)."""
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for found in units(texts, self.v.alone):
            n, of = len(found.starts), np.diff(found.bounds)
            own = keys = found.hashes
            if self.dropout > 0:
                place = (np.arange(n) - np.repeat(found.bounds[:-1], of)).astype(np.uint64)
                text = bytewords.mixed(numbers[found.rows] + self.seed)
                own = bytewords.mixed(bytewords.mixed(np.repeat(text, of) + place) + found.hashes)
                keys = self._drawn(found, own)
            counts, out = self.known.runs(keys, lambda at, _, found=found, own=own: self._merged(found, at, own[at]))
            whole = np.concatenate([[0], np.cumsum(counts)])[found.bounds]
            yield found.rows, out, np.diff(whole)

    def _drawn(self, found: Units, own: np.ndarray) -> np.ndarray:
        """A key of each unit and the set of candidates that its occurrence skips; of long units, their own."""
        first = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
        long = first[found.ends] - first[found.starts] > LONG
        keys = np.where(long, own, found.hashes)
        short = np.flatnonzero(~long)
        for a in range(0, len(short), DRAWN):
            at = short[a:a + DRAWN]
            sizes, candidates = self.possible.runs(
                keys[at], lambda new, _, at=at: possible(self.v, *self._symbols(found, at[new])))
            of = np.repeat(np.arange(len(at)), sizes)
            skipped = np.flatnonzero(_skipped(own[at][of], candidates >> np.uint32(25),
                                              candidates & np.uint32(2**25 - 1), self.dropout))
            marks = bytewords.mixed(candidates[skipped].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C55))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
            ends = np.cumsum(np.bincount(of[skipped], minlength=len(at)))
            marks = np.diff(sums[np.concatenate([[0], ends])])
            keys[at] = bytewords.mixed(keys[at] + marks)
        return keys

    def _symbols(self, found: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the units numbered ``at``, their bounds)."""
        size = found.ends[at] - found.starts[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = found.data[np.repeat(found.starts[at] - bounds[:-1], size) + np.arange(bounds[-1])]
        points, places = code_points(data)
        return self.v.symbols[points], np.searchsorted(places, bounds)

    def _merged(self, found: Units, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of the units numbered ``at``."""
        symbols, bounds = self._symbols(found, at)
        lengths = np.diff(bounds)
        short = lengths <= LONG
        take = np.repeat(short, lengths)
        merged, counts = merge_all(self.v, symbols[take], np.concatenate([[0], np.cumsum(lengths[short])]),
                                   keys[short], self.dropout)
        ids = merged
        if not short.all():
            pieces, ends = [], np.cumsum(counts)
            whole, every = np.zeros(len(keys), dtype=np.int64), iter(zip(ends - counts, ends, strict=True))
            for i in range(len(keys)):
                if short[i]:
                    a, b = next(every)
                    pieces.append(merged[a:b])
                else:
                    pieces.append(merge_by_agenda(self.v, symbols[bounds[i]:bounds[i + 1]], keys[i], self.dropout))
                whole[i] = len(pieces[-1])
            counts, ids = whole, np.concatenate(pieces)
        ids, counts = _with_bytes(self.v, ids, counts)
        return counts, ids


@lru_cache(maxsize=1)
def worker_encoder(model: str, dropout: float, seed: int) -> Encoder:
    """The encoder that this Python worker's tasks share."""
    return Encoder(model, dropout, seed)


def decoded(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Texts of piece ids; the leading space of a text that is not empty is taken away."""
    size = v.offsets[ids + 1] - v.offsets[ids]
    ends = np.cumsum(size)
    data = v.data[np.repeat(v.offsets[ids] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [data[a + 1:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _encode(batches: Iterator[pa.RecordBatch], model: str, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(model, dropout, seed)
    for batch in batches:
        n = batch.num_columns - 2
        for rows, ids, counts in encoder.encode(batch.column(n + 1), batch.column(n)):
            places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            kept = [batch.column(i)[rows.start:rows.stop] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.ListArray.from_arrays(pa.array(places), pa.array(ids.astype(np.int32)))],
                names=[*batch.schema.names[:n], "made"])


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model)
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        for rows, ids, counts in _id_chunks(lists):
            texts = [t.decode(errors="replace") for t in decoded(v, ids, counts)]
            kept = [batch.column(i)[rows.start:rows.stop] for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], "made"])


def _checked(batches: Iterator[pa.RecordBatch], model: str, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Encodes, decodes the ids and compares: the last but two columns are kept, the last is the text."""
    v = vocabulary(model)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        with_text = batch.append_column("text", text)  # the encoder drops its own two inputs
        with_text = with_text.select([*range(batch.num_columns - 2), batch.num_columns, batch.num_columns - 2,
                                      batch.num_columns - 1])
        for encoded in _encode(iter([with_text]), model, dropout, seed):
            n = encoded.num_columns
            for rows, ids, counts in _id_chunks(encoded.column(n - 1)):
                raw, offsets = bytewords.buffers(encoded.column(n - 2)[rows.start:rows.stop])
                same = [raw[a:b].tobytes() == back for a, b, back in zip(
                    offsets[:-1].tolist(), offsets[1:].tolist(), decoded(v, ids, counts), strict=True)]
                made = pa.StructArray.from_arrays(
                    [encoded.column(n - 1)[rows.start:rows.stop], pa.array(same, pa.bool_())], ["piece_ids", "lossless"])
                kept = [encoded.column(i)[rows.start:rows.stop] for i in range(n - 2)]
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*batch.schema.names[:n - 2], "made"])


def _id_chunks(lists: pa.ListArray, most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a list column together up to ``most`` ids, one row at least; null lists are empty."""
    counts = np.array(lists.value_lengths().fill_null(0))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield slice(at, to), values[ends[at]:ends[to]], counts[at:to]
        at = to


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 11, id_col: str = "doc_id",
           text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``piece_ids``, an array of int.

    ``keep`` names the columns to return with it, by default all. Null and empty texts have no
    pieces; null ids count as 0. With dropout 0 the ids are the model's own. Equal texts with
    different ids are segmented differently. A column named piece_ids is replaced. Repeated rows
    stay; an empty table gives an empty result.
    """
    kept = [c for c in keep or docs.columns if c != "piece_ids"]
    return with_computed(docs, kept, [F.col(id_col).cast("long"), F.col(text_col)],
                         partial(_encode, model=model, dropout=dropout, seed=seed), "piece_ids",
                         ArrayType(IntegerType()))


def encode_checked(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 11, id_col: str = "doc_id",
                   text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``encode``, in the struct column ``pieces`` (piece_ids, lossless): whether decoding the ids
    gives the text again. Null texts count as empty ones."""
    kept = [c for c in keep or docs.columns if c != "pieces"]
    kind = StructType([StructField("piece_ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())])
    return with_computed(docs, kept, [F.col(id_col).cast("long"), F.col(text_col)],
                         partial(_checked, model=model, dropout=dropout, seed=seed), "pieces", kind)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """All rows and other columns with ``decoded``, the text of the ids; null ids give empty text."""
    kept = [c for c in encoded.columns if c not in (ids_col, "decoded")]
    return with_computed(encoded, kept, [F.col(ids_col)], partial(_decode, model=model), "decoded", StringType())
