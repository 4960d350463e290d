import hashlib
import re

import pytest
from pyspark.sql import functions as F

from trawl.llm import fingerprints

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(9000))


def shingles(text):
    words = re.split(r"[\x20\x09-\x0D]+", (text or "").strip(" \t\n\x0b\f\r").lower())
    if words == [""]:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_merge_and_estimate(spark):
    parts = [LONG[:30_000], LONG[25_000:]]
    df = spark.createDataFrame([(LONG, *parts)], "text string, a string, b string")
    for name in ("text", "a", "b"):
        df = fingerprints.with_sketch(df, F.col(name), f"{name}_sketch")
    s, a, b = (F.col(f"{n}_sketch") for n in ("text", "a", "b"))
    row = df.select(
        fingerprints.resemblance(s, a).alias("near"), fingerprints.containment(a, s).alias("inside"),
        fingerprints.n_distinct(s).alias("n"), fingerprints.merge(a, b).alias("merged"), s.alias("s"),
        fingerprints.resemblance(s, s).alias("same")).first()
    assert row["same"] == 1.0
    assert row["near"] == pytest.approx(likeness(LONG, parts[0]), abs=0.12)
    assert row["inside"] > 0.85
    assert row["n"] == pytest.approx(len(shingles(LONG)), rel=0.3)
    # the parts lack the few shingles that the cut runs through and have some of their own
    assert len(set(row["merged"]) & set(row["s"])) > 240


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_texts_against_brute_force(spark, partitions):
    texts = [LONG, None, "", "one two", "One  TWO", "é😀 ß a b c d e f g", LONG[:900], LONG[:900], "\n", "x" * 50]
    rows = [(i * 3, t, 5, 6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int, sketch int").repartition(partitions)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(df).select(
        "*", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next")).collect()}
    assert len(found) == len(rows)
    descending = sorted(found, reverse=True)
    for at, doc_id in enumerate(descending):
        text = texts[doc_id // 3] or ""
        after = texts[descending[(at + 1) % len(descending)] // 3] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        assert found[doc_id]["n_chars"] == len(text)
        assert found[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[doc_id]["near_next"] == pytest.approx(likeness(text, after), abs=0.12)
    assert found[9]["sketch"] == found[12]["sketch"]
    assert found[3]["sketch"] == found[6]["sketch"] == []


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z"), (2, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_pairs(df).count() == 4
    assert fingerprints.fingerprint_pairs(df.limit(0)).count() == 0
    one = fingerprints.fingerprint_pairs(df.where("doc_id = 2")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("hot", [None, 7, 10**6])
def test_a_hot_id_is_dealt_over_ranges_of_their_share(spark, hot):
    rows = [(i, f"own {i}") for i in range(2000)] + [(hot, f"hot {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, _text string").repartition(5)
    dealt, order = fingerprints.in_ranges(df, "doc_id", ["_text"])
    assert dealt.count() < 4000 + 30
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert max(sizes) < 2 * 4000 / 16
    paired = dealt.withColumn("_next", F.lead("_text").over(order)).where("_guest = 0").collect()
    after = {r["_text"]: r["_next"] for r in paired}
    ids = {t: -1 if i is None else i for i, t in rows}
    assert len(after) == 4000 and set(after.values()) == set(after)
    at, seen = max(after, key=lambda t: ids[t]), set()
    while at not in seen:  # one round through all rows, going up in ids once only
        seen.add(at)
        at = after[at]
    assert len(seen) == 4000
    assert sum(ids[b] > ids[a] for a, b in after.items()) == 1


def test_copies_of_one_row_are_dealt_over_ranges(spark):
    df = spark.createDataFrame([(None, "same words here")] * 3000 + [(i, f"t {i}") for i in range(500)],
                               "doc_id long, text string").repartition(4)
    dealt, _ = fingerprints.in_ranges(df, "doc_id", ["text"])
    assert max(r["count"] for r in dealt.groupBy("_range").count().collect()) < 2 * 3500 / 16
    found = fingerprints.fingerprint_pairs(df).collect()
    assert len(found) == 3500 and all(r["edited_sha256"] for r in found)
