"""The inverted term index of weighted text fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.analysis import ANY_DOCUMENT, document_entry, text_list
from trawl.operators.postings import read_as, text_postings
from trawl.session import local_table
from trawl.sources import buckets

BUCKET = "term_bucket"


@dataclass(frozen=True)
class TermIndex:
    """Where an index is and how its text was read. Choose buckets for files of 100+ MB, and key
    buckets so that a change touches few: it rewrites whole ones. Phrases read the postings of pairs of
    ``frequent`` terms in place of the long ones of both (see ``frequent_terms``)."""

    path: str
    key: str
    fields: tuple[tuple[str, str], ...]
    config: str = "english"
    buckets: int = 64
    key_type: str = "bigint"
    key_buckets: int = 4
    frequent: tuple[str, ...] = ()

    @property
    def layout(self) -> buckets.Layout:
        schema = T.StructType.fromDDL(f"term string, doc_id {self.key_type}, weight string, "
                                      "positions array<int>, version bigint")
        return buckets.Layout(self.path, schema, BUCKET, self.buckets, self.key_buckets, "doc_id", ("term",),
                              f"term = {text_list([ANY_DOCUMENT])}", counted=True)


def _rows(df: DataFrame, index: TermIndex, order: str | None) -> DataFrame:
    given = df.withColumn("_version", buckets.version(df, order))
    return text_postings(given, index.key, list(index.fields), index.config, with_documents=True, version="_version",
                         frequent=index.frequent)


def build_term_index(df: DataFrame, index: TermIndex, order: str | None = None) -> None:
    """Index all rows of a table, unless the index is already there. Of rows with the same key the
    last one by the column ``order`` counts; without one, such rows are refused."""
    if not buckets.is_built(df.sparkSession, index.layout):
        buckets.build_once(_rows(buckets.one_per_key(df, index.key, order), index, order), index.layout)


def refresh_term_index(changed: DataFrame, index: TermIndex, order: str | None = None) -> None:
    """Index new and changed rows; repeating it is harmless.

    Without ``order`` what comes later replaces what came before. With it, a row that is older than
    the indexed one of its key is left out, and of equally old ones the later one counts.
    """
    spark, at = changed.sparkSession, index.layout
    buckets.finish(spark, at)
    if not buckets.is_built(spark, at):
        build_term_index(changed, index, order)
        return
    new = buckets.not_older(buckets.one_per_key(changed, index.key, order), index.key, order, at)
    buckets.replace(_rows(new, index, order), new.select(F.col(index.key).alias("_key")), at)


def sync_term_index(df: DataFrame, index: TermIndex, order: str | None = None) -> bool:
    """Bring an index up to date with its table: index the rows that are new or whose text is
    not what was indexed, and take out those that are gone. Returns whether anything was written."""
    spark, at = df.sparkSession, index.layout
    buckets.finish(spark, at)
    if not buckets.is_built(spark, at):
        build_term_index(df, index, order)
        return True
    df = buckets.one_per_key(df, index.key, order)
    digest = F.expr(f"{document_entry(list(index.fields), read_as(index.config, index.frequent))}.positions")
    known = read_postings(spark, index, at.registry).select(
        F.col("doc_id").alias("_known"), F.col("positions").alias("_digest"))
    found = buckets.changes(df, index.key, digest, known)
    if found is None:
        return False
    changed, keys = found
    buckets.replace(_rows(changed, index, order), keys, at)
    return True


def _terms(spark: SparkSession, index: TermIndex, terms) -> str:
    """SQL for the postings of some terms, with their buckets as literals."""
    if not terms:
        return "false"
    found = local_table(spark, term=list(terms)).select(
        F.expr(buckets.bucket_of(["term"], index.buckets)).alias("b")).distinct().collect()
    return f"{BUCKET} in ({', '.join(str(r['b']) for r in found)}) and term in ({text_list(terms)})"


def read_postings(spark: SparkSession, index: TermIndex, wanted: str | None = None) -> DataFrame:
    """(term, doc_id, weight, positions) of all documents as they are now."""
    return buckets.read_rows(spark, index.layout, wanted).select("term", "doc_id", "weight", "positions")


def term_counts(spark: SparkSession, index: TermIndex, terms) -> tuple[dict[str, int], int]:
    """(number of postings of each term, the most bytes of a key), from the table of counts."""
    found, width = buckets.frequencies(spark, index.layout, _terms(spark, index, terms))
    return {term: n for (term,), n in found.items()}, width


def all_counts(spark: SparkSession, index: TermIndex) -> DataFrame:
    """(term, n): the vocabulary, with the number of postings of each term."""
    return buckets.read_counts(spark, index.layout).select("term", "n")


def find_postings(spark: SparkSession, index: TermIndex, terms, leads, item: str) -> DataFrame:
    """(doc_id, items) of the given terms; with ``leads``, which have to be few, only of documents
    that have one of them.

    The terms' buckets are literals, so other folders are not listed or opened, and the term
    filter is pushed into Parquet, whose row groups are sorted by term.
    """
    leading = None if leads is None else _terms(spark, index, leads)
    return buckets.gather(spark, index.layout, _terms(spark, index, terms), item, leading)


def compact_term_index(spark: SparkSession, index: TermIndex, target: TermIndex) -> None:
    """Write the rows of an index as the full build of a new one, which may have other buckets."""
    buckets.build_once(buckets.read_rows(spark, index.layout), target.layout)
