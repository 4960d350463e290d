import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trawl.llm import idfiles

FILE = public_tokenizers.path("word_bpe_49k.json")
ENCODING = idfiles.Encoding(FILE, end_id=2, vocabulary=49_408)
SCHEMA = "doc_id long, text string, part int, start string, _id int"
ODD = [None, "", " \n", "<|endoftext|> <|ENDOFTEXT|>x", "It's we'LL, don't", "é é ΑΣ İx 中文 123 4a", "a\x1fb\x85c\xa0d",
       "😀😀 ...!!", "The the THE", "word " * 30_000, "y" * 5000]


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_packed_ids_come_back_from_any_place(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), dtype=np.uint32)
    payload = idfiles.pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert idfiles.unpack(payload, bits, start, stop).tolist() == ids[start:stop].tolist()


def test_bits_are_the_fewest_for_the_vocabulary():
    assert [idfiles.Encoding("", 0, n).bits for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("block,bits", [(idfiles.BLOCK_IDS, 16), (50, 17)])
def test_documents_equal_the_tokenizer(spark, monkeypatch, tmp_path, block, bits):
    monkeypatch.setattr(idfiles, "BLOCK_IDS", block)
    monkeypatch.setattr(idfiles, "KNOWN_WORDS", 40)
    idfiles.worker_encoder.cache_clear()
    texts = ODD + [f"text number {i} says Hello, world" for i in range(120)]
    encoding = idfiles.Encoding(FILE, 2, 1 << bits)
    df = spark.createDataFrame([(i * 5 - 20, t, 1, "s", 2) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    idfiles.write_ids(df, str(tmp_path / "ids"), encoding)
    found = {r["doc_id"]: r for r in idfiles.read_documents(spark, str(tmp_path / "ids")).collect()}
    tokenizer, start = Tokenizer.from_file(FILE), 0
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(found[i * 5 - 20])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, None)], "doc_id long, text string")
    found = sorted(idfiles.encoded(df, ENCODING).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in found] == [(None, 0, 2), (0, 2, 1), (1, 3, 2), (1, 5, 2)]
    assert idfiles.encoded(df.limit(0), ENCODING).count() == 0


def test_an_id_that_all_rows_share_is_written_by_several_tasks(spark, tmp_path):
    df = spark.createDataFrame([(None, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    idfiles.write_ids(df, path, ENCODING)
    sizes = [sum(len(r["doc_ids"]) for r in rows) for rows in _by_part(spark.read.parquet(path).collect()).values()]
    assert sum(sizes) == 2000 and len(sizes) == 4 and max(sizes) < 1000
    found = idfiles.read_documents(spark, path).collect()
    assert len(found) == 2000
    spans = sorted((r["start"], r["n_tokens"]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def _by_part(rows):
    out = {}
    for r in rows:
        out.setdefault(r["part"], []).append(r)
    return out
