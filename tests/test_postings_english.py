from collections import defaultdict
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from trawl.functions.stemming import stem
from trawl.operators import postings

SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_every_english_posting_of_every_term(spark):
    """Words and positions by SQL, each word stemmed by itself."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{Path(SF) / 'documents.parquet'}')")
    places = defaultdict(list)
    for raw, doc_id, weight, pos in con.execute(
            f"WITH {entry.ENGLISH_TOKENS} SELECT raw, doc_id, weight, pos FROM raws").fetchall():
        places[stem(raw), doc_id, weight].append(pos)
    found = entry.queries()["text_postings_english_all"](spark, SF).collect()
    assert len({r["term"] for r in found}) > 1000
    assert {(r["term"], r["doc_id"], r["weight"]): r["positions"] for r in found} == {
        k: ",".join(map(str, sorted(v))) for k, v in places.items()}
    assert len(found) == len(places)


def test_stemming_gets_small_batches_of_texts(spark):
    """A worker holds a batch of words at once, which Spark counts in rows, not in bytes."""
    kept = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "10000")
        docs = spark.createDataFrame([(1, "licensed versions")], "doc_id long, body string")
        found = postings.text_postings(docs, "doc_id", [("body", "B")], "english")
        assert int(spark.conf.get(BATCH)) <= 1000
        assert {r["term"] for r in found.collect()} == {"licens", "version"}
        spark.conf.set(BATCH, "77")
        postings.text_postings(docs, "doc_id", [("body", "B")], "english")
        assert spark.conf.get(BATCH) == "77"
    finally:
        spark.conf.set(BATCH, kept)
