"""Prediction by partial matching against a plain version of it, and held-out accuracy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import langid, queries
from trawl.llm.common import remainder

SF = "/root/testdata/sf0.01"
TRAIN = {"aa": ["abra cadabra abracadabra", "aéa", "abba"], "bb": ["bonobo bobo", "", "nonono"], "cc": ["zzz"]}


def plain_counts(texts):
    """By context: counts of the bytes that follow it."""
    tree = {}
    for text in texts:
        raw = bytes(langid.ORDER) + text.encode()
        for i in range(langid.ORDER, len(raw)):
            for j in range(langid.ORDER + 1):
                row = tree.setdefault(raw[i - j:i], {})
                row[raw[i]] = row.get(raw[i], 0) + 1
    return tree


def plain_bits(tree, context, byte):
    """Code length of a byte: escapes with exclusion, one context after another."""
    out, bits = set(), 0.0
    for j in range(langid.ORDER + 1):
        row = {b: n for b, n in tree.get(context[j:], {}).items()}
        if not row:
            continue
        whole = sum(row.values()) + len(row)
        left = whole - sum(n for b, n in row.items() if b in out)
        if byte in row and byte not in out:
            return bits - math.log2(row[byte] / left)
        bits -= math.log2(len(row) / left)
        out |= set(row)
    return bits + math.log2(256 - len(out))


def model_of(trees):
    counts = {}
    for name, tree in trees.items():
        for length in range(1, langid.ORDER + 2):
            found = sorted((int.from_bytes(c + bytes([b]), "big"), n) for c, row in tree.items()
                           if len(c) == length - 1 for b, n in row.items())
            if found:
                counts[name, length] = tuple(map(np.array, zip(*found)))
                counts[name, length] = (counts[name, length][0].astype(np.uint64), counts[name, length][1])
    return langid.build(counts, sorted(trees))


@pytest.fixture(scope="module")
def trees():
    return {name: plain_counts(texts) for name, texts in TRAIN.items()}


def test_costs_are_the_plain_ones_and_sum_to_one(trees):
    model = model_of(trees)
    for context in (b"\0\0\0\0", b"abra", b"\0\0\0a", b"onob", b"qqqq", b"zzzz", b"caaa"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        bits = model.bits(codes)
        for k, name in enumerate(model.languages):
            assert np.allclose(bits[:, k], [plain_bits(trees[name], context, b) for b in range(256)], atol=1e-4)
        assert np.allclose(np.exp2(-bits.astype(float)).sum(axis=0), 1, atol=1e-4)


@pytest.mark.parametrize("window", [1 << 18, 7])
def test_training_and_prediction_are_the_plain_ones(spark, trees, monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    rows = [(text, name) for name, texts in TRAIN.items() for text in texts] + [("never counted", None), (None, "bb")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    given = ["abra", "bobono", "zz top", "", None, "12 34!", "é", "abracadabra bonobo " * 9, "zzz", "zzz"]
    asked = spark.createDataFrame(list(enumerate(given)), "id long, text string").withColumn("lang_pred", F.lit(1))
    found = {r["id"]: r for r in langid.predict(asked, langid.fit(docs), ["id"]).collect()}
    assert len(found) == len(given)
    for i, text in enumerate(given):
        if text is None or not any(c.isalpha() for c in text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        raw = bytes(langid.ORDER) + text.encode()
        bits = {name: sum(plain_bits(tree, raw[j - langid.ORDER:j], raw[j]) for j in range(langid.ORDER, len(raw)))
                for name, tree in trees.items()}
        best = min(bits, key=lambda k: (round(bits[k], 3), k))
        assert found[i]["lang_pred"] == best
        assert found[i]["code_bits"] == pytest.approx(bits[best], rel=1e-4)
        assert found[i]["score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-2)


def test_grams_in_windows_are_those_of_whole_texts():
    texts = pa.array(["", "a", "abcdefgh", "xy", None, "éèê" * 5])
    data, offsets = langid.bytewords.buffers(texts)
    whole = langid.grams(data, offsets, 0, len(data))
    parts = [langid.grams(data, offsets, a, min(a + 3, len(data))) for a in range(0, len(data), 3)]
    assert np.array_equal(whole, np.concatenate(parts))
    assert [int(x) for x in whole[:4]] == [97, 97, 97 << 8 | 98, 97 << 16 | 98 << 8 | 99]


def test_trees_keep_the_most_frequent_grams_and_all_their_ends(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    keys = set(model.grams.keys.tolist())
    lengths = [k >> langid._LENGTH for k in keys]
    assert max(map(lengths.count, set(lengths))) <= 12 * len(model.languages)
    for key in keys:
        length, gram = key >> langid._LENGTH, key & ((1 << langid._LENGTH) - 1)
        if length > 1:
            assert (length - 1) << langid._LENGTH | gram & ((1 << 8 * (length - 1)) - 1) in keys


def test_nothing_learnt_and_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    model = langid.fit(none)
    asked = spark.createDataFrame([("some text",)], "text string")
    assert [tuple(r)[:2] for r in langid.predict(asked, model, []).collect()] == [("und", 0.0)]
    assert langid.predict(asked.limit(0), model, []).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op13_langid(spark, SF).join(docs, "doc_id").where("lang_pred <> 'und'")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert found.where(F.col("held_out") != (remainder("doc_id", 4) == 2)).isEmpty()
