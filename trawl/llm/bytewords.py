"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than ASCII white space, with A to Z lower-cased. A word is known by a
64-bit polynomial hash of its bytes, which is computed for all words of a chunk from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are taken together up to this many bytes; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_MASK = 2**64 - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


@dataclass
class Words:
    """Words of a chunk: document d has words ``bounds[d]`` up to ``bounds[d + 1]``."""

    data: np.ndarray     # bytes of the chunk, lower-cased if so wanted
    rows: slice          # the chunk's rows in its batch
    offsets: np.ndarray  # documents' places in ``data``
    starts: np.ndarray   # words' places in ``data``
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray   # uint64

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    bases = (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64)))
    out = []
    for base in bases:
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse, up to n at least."""
    return _powers(1 << max(21, int(n).bit_length()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; nulls count as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, dtype=np.uint8)
    return raw, offsets


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of consecutive rows of at most ``most`` bytes, one row at least."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield slice(at, to), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(texts: pa.Array, most: int = CHUNK_BYTES, lower: bool = True) -> Iterator[Words]:
    """The words of a batch of texts, chunk by chunk; ``lower=False`` keeps A to Z apart from a to z."""
    for rows, raw, offsets in chunks(texts, most):
        data = _LOWER[raw] if lower else raw
        blank = np.ones(len(data) + 2, dtype=bool)
        blank[1:-1] = _BLANK[raw]
        first = ~blank[1:] & blank[:-1]   # a word begins at this byte
        last = ~blank[:-1] & blank[1:]    # a word ended before this byte
        inner = np.unique(offsets[1:-1])
        if len(inner):  # documents touch without white space between them
            touching = inner[~blank[inner + 1] & ~blank[inner]] if len(data) else inner[:0]
            first[touching] = True
            last[touching] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        hashes = span_hashes(data, starts, ends)
        yield Words(data, rows, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of the bytes of each span, wherever it lies."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the non-empty lines of each document, parted at line feeds."""
    breaks = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    starts, ends = breaks[:-1], breaks[1:]
    some = data[starts] != 10 if len(starts) else np.zeros(0, dtype=bool)
    return starts[some], ends[some], np.searchsorted(starts[some], offsets)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each run of ``width`` words of a document; fewer words are one run."""
    h, bounds, counts = found.hashes, found.bounds, found.counts
    n = len(h)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, n)):
        run[:n - i] = run[:n - i] * np.uint64(0xD6E8FEB86659FD93) + h[i:]
    run = mixed(run)
    kept = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        whole = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for x in h[bounds[d]:bounds[d + 1]]:
                whole = whole * np.uint64(0x9FB21C651E98DF25) + x
        run[bounds[d]] = mixed(np.array([whole]))[0]
    new = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(kept, out=new[1:])
    take = np.repeat(bounds[:-1] - new[:-1], kept) + np.arange(new[-1])
    return run[take], new
