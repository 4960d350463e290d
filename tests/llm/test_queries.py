"""The registered queries and the pipeline, against their SQL, brute force and each other."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from check_oracle import compare
from test_minhash import brute
from trawl.llm import mixing, pieces, quality, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    rows, same = compare(spark, SF, name)
    assert rows and same


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_has_a_row_for_every_document(spark, name):
    ids = {r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The small documents with odd rows: no text, no id, repeated rows."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10_001, None, "en", "src1", 0), (10_002, "", "en", None, 0), (None, "A text without an id.", "en", "src2", 21),
         (10_003, "The same row twice, and nothing else like it here.", "en", "src3", 50),
         (10_003, "The same row twice, and nothing else like it here.", "en", "src3", 50)], given.schema)
    folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    given.unionByName(odd).write.parquet(folder)
    return spark.read.parquet(folder)


def test_stages_are_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "pieces"]


def test_quality_stage_drops_what_the_classifier_rejects(spark, docs):
    kept = corpus_pipeline.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    rows = docs.select("doc_id", "text").collect()
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [r["doc_id"] for r in quality.score(texts, forest).collect() if r["quality_score"] >= 0.3]
    assert sorted(map(str, wanted)) == sorted(str(r["doc_id"]) for r in kept.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept.collect()}
    assert all(i in left for i, good in labels.items() if good)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    _, roots = brute([text for _, text in rows], 80, 5)
    wanted = [doc_id for at, (doc_id, _) in enumerate(rows) if roots[at] == at]
    assert len(wanted) < len(rows)
    assert sorted(map(str, [*wanted, None])) == sorted(str(r["doc_id"]) for r in kept.collect())


def test_mixing_stage_uses_every_document_in_the_mixtures_order(spark, docs):
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    once = {str(r["doc_id"]) for r in docs.collect()}
    assert {str(r["doc_id"]) for r in mixed.collect()} == once
    wanted = [r["doc_id"] for r in mixing.mix(docs, most_repeats=2.0).rows.orderBy("mix_place").collect()]
    assert sorted(map(str, wanted)) == sorted(str(r["doc_id"]) for r in mixed.collect())


def test_the_whole_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    found = pieces.decode(out, queries.PIECES_MODEL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found and all(r["decoded"] == texts[r["doc_id"]] for r in found)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
