import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import bytewords
from trawl.llm.memo import Memo

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1f z", max_size=12)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 30), st.booleans())
def test_words_and_hashes(rows, most, lower):
    known = {}
    seen = 0
    for found in bytewords.words(pa.array(rows, pa.string()), most, lower):
        for d, row in enumerate(rows[found.rows]):
            wanted = WORD.findall((row or "").encode())
            wanted = [w.lower() for w in wanted] if lower else wanted
            at = slice(found.bounds[d], found.bounds[d + 1])
            got = [bytes(found.data[s:e]) for s, e in zip(found.starts[at], found.ends[at], strict=True)]
            assert got == wanted
            assert all(known.setdefault(w, h) == h for w, h in zip(got, found.hashes[at].tolist(), strict=True))
            seen += 1
    assert seen == len(rows)
    assert len(set(known.values())) == len(known)


@settings(max_examples=40, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_are_equal_when_their_words_are(rows, width):
    known = {}
    for found in bytewords.words(pa.array(rows, pa.string())):
        hashes, bounds = bytewords.shingles(found, width)
        for d, row in enumerate(rows[found.rows]):
            words = [w.lower() for w in WORD.findall((row or "").encode())]
            wanted = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
            got = hashes[bounds[d]:bounds[d + 1]].tolist()
            assert len(got) == len(wanted)
            assert all(known.setdefault(w, h) == h for w, h in zip(wanted, got, strict=True))
    assert len(set(known.values())) == len(known)


def test_lines():
    rows = ["a\nb\n\nc", "", "\n\n", "x", "y\n"]
    for rows_, raw, offsets in bytewords.chunks(pa.array(rows)):
        starts, ends, bounds = bytewords.lines(raw, offsets)
        got = [[bytes(raw[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
               for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [[x for x in row.split("\n") if x] for row in rows]


def test_memo_starts_again_when_full():
    memo, made = Memo(4), []

    def make(first, keys):
        made.append(len(keys))
        return np.full(len(keys), 2), np.repeat(keys, 2).astype(np.uint32)

    for keys in ([1, 2, 1], [2, 3], [5, 6, 7, 5], [1]):
        counts, ids = memo.runs(np.array(keys, dtype=np.uint64), make)
        assert counts.tolist() == [2] * len(keys)
        assert ids.tolist() == [k for k in keys for _ in range(2)]
    assert made == [2, 1, 3, 1]
