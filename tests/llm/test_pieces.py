import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, decoded int, piece_ids string, `a.b` int"
ODD = [None, "", " ", "  two  spaces ", "\n\t x\n", "▁ is a sign", "<s> <0x41>", "中文 é 😀 \x00 \x7f", "y" * 3000,
       "the same words the same words", "the same words the same words", "many " * 30_000]
anything = st.text(alphabet=st.one_of(st.sampled_from("the ing▁\n\té中😀"), st.characters(codec="utf-8")), max_size=80)


def segments(text, dropout, doc_id=0, seed=1):
    (_, ids, _), = pieces.Encoder(MODEL, dropout, seed).encode(pa.array([text]), pa.array([doc_id]))
    return ids


@settings(max_examples=80, deadline=None)
@given(anything, st.sampled_from([0.0, 0.1, 0.7, 1.0]))
def test_any_text_comes_back(text, dropout):
    ids = segments(text, dropout)
    assert pieces.decoded(pieces.vocabulary(MODEL), ids.astype(np.int64), np.array([len(ids)]))[0].decode() == text


@settings(max_examples=80, deadline=None)
@given(anything)
def test_without_dropout_ids_are_the_models(text):
    text = text.replace("▁", "").replace("\x00", "")
    assert segments(text, 0.0).tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


@pytest.mark.parametrize("text", ["\r", "x;\r", "}\r", " {\r\n", "\r\r", " \r", "a\r", " }\r b", "\r ", "();\r\n\tx\r y"])
def test_carriage_returns_belong_to_pieces(text):
    assert segments(text, 0.0).tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_the_agenda_and_the_rounds_agree(monkeypatch):
    rng = random.Random(2)
    words = [" " + "".join(rng.choice("abcdethingo") for _ in range(rng.randrange(1, 60))) for _ in range(200)]

    def every():
        return [ids.tolist() for _, ids, _ in pieces.Encoder(MODEL, 0.3, 9).encode(pa.array(words), pa.array(range(200)))]

    together = every()
    monkeypatch.setattr(pieces, "LONG", 0)
    assert every() == together


def test_dropout_varies_and_is_repeatable():
    text = "international organisations understand everything " * 8
    plain, some, more = (segments(text, d) for d in (0.0, 0.1, 0.6))
    assert len(plain) < len(some) < len(more)
    assert segments(text, 0.1).tolist() == some.tolist()
    assert segments(text, 0.1, doc_id=7).tolist() != some.tolist()
    assert segments(text, 0.1, seed=2).tolist() != some.tolist()
    assert len(segments("abc def", 1.0)) == 8  # characters only


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_round_trip_of_a_table(spark, dropout):
    rows = [(i, t, 1, "p", 2) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = pieces.encode(df, MODEL, dropout)
    assert encoded.columns == ["doc_id", "text", "decoded", "a.b", "piece_ids"]
    back = pieces.decode(encoded, MODEL)
    assert back.columns == ["doc_id", "text", "a.b", "decoded"]
    found = {r["doc_id"]: r for r in back.collect()}
    assert {i: r["decoded"] for i, r in found.items()} == {i: t or "" for i, t in enumerate(ODD)}
    ids = {r["doc_id"]: r["piece_ids"] for r in encoded.collect()}
    checked = pieces.encode_checked(df, MODEL, dropout, keep=["doc_id", "a.b"])
    assert checked.columns == ["doc_id", "a.b", "pieces"]
    assert {r["doc_id"]: r["pieces"]["piece_ids"] for r in checked.collect()} == ids
    assert all(r["pieces"]["lossless"] for r in checked.collect())
    assert ids[0] == ids[1] == []
    assert (ids[9] == ids[10]) == (dropout == 0)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert pieces.encode(df, MODEL).count() == 3
    assert pieces.decode(pieces.encode(df.limit(0), MODEL), MODEL).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, piece_ids array<int>")
    assert pieces.decode(none, MODEL).first()["decoded"] == ""


def test_every_occurrence_draws_for_itself():
    n, words = 4000, " international"
    (_, ids, counts), = pieces.Encoder(MODEL, 0.1, 5).encode(pa.array([words] * n), pa.array(range(n)))
    ends = np.cumsum(counts)
    found = [tuple(ids[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
    assert len(set(found)) > 16     # many more than a few frozen ones
    plain = tuple(segments(words, 0.0))
    assert 0.2 < found.count(plain) / n < 0.9
    assert len(segments(words * n, 0.1)) > 1.05 * len(segments(words * n, 0.0))


@settings(max_examples=60, deadline=None)
@given(st.lists(anything, min_size=1, max_size=20), st.sampled_from([0.05, 0.1, 0.5]))
def test_kept_results_are_what_merging_each_occurrence_gives(texts, dropout):
    encoder = pieces.Encoder(MODEL, dropout, 7)
    texts = texts * 5
    kept = [(ids.tolist(), counts.tolist()) for _, ids, counts in encoder.encode(pa.array(texts), pa.array(range(len(texts))))]
    fresh = pieces.Encoder(MODEL, dropout, 7)
    fresh._drawn = lambda found, own: own   # no two occurrences share a key
    assert kept == [(ids.tolist(), counts.tolist()) for _, ids, counts in fresh.encode(
        pa.array(texts), pa.array(range(len(texts))))]
