"""Boolean and phrase matching of many requests at once.

Matching works on one row per document that holds the requested terms found in it. A scan makes
that row in place, so matching a scan shuffles nothing; an index lookup groups the postings of
the requested terms by document, each posting once however many requests share it.

A request's documents must contain one of its lead terms. Documents meet requests on lead terms
only, by an equi-join, and each pair is then decided inside its row. Sets of requests that are too
large to be sent to every task are decided by their shared words and phrases instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.analysis import (ANY_DOCUMENT, document_entry, grouped, let, text_list,
                                      with_entries)
from trawl.operators.pairing import pairs
from trawl.operators.postings import text_postings
from trawl.operators.shared_items import decided, steps_hold
from trawl.plans.requests import Requests
from trawl.session import rows_of, stored
from trawl.sources.buckets import few
from trawl.sources.term_index import TermIndex, all_counts, find_postings, read_postings, term_counts


@dataclass(frozen=True)
class Scan:
    """Search the text columns themselves."""

    df: DataFrame
    key: str
    fields: list[tuple[str, str]]

    def documents(self, requests: Requests, positions: bool) -> tuple[Requests, DataFrame]:
        """The requests, and (doc_id, found) rows with the requested terms of each document."""
        columns = [name for name, _ in self.fields]
        df = with_entries(self.df.select(self.key, *columns), self.fields, requests.config)
        entries = f"filter(entries, e -> e.term in ({text_list(requests.terms)}))"
        if positions:
            found = f"array_append({grouped(entries)}, {document_entry()})"
        else:
            found = f"""transform(array_distinct(array_append(
                transform({entries}, e -> e.term), '{ANY_DOCUMENT}')),
                t -> named_struct('term', t))"""
        return requests, df.selectExpr(f"`{self.key}` as doc_id", f"{found} as found")

    def postings(self, requests: Requests) -> tuple[DataFrame, DataFrame | None]:
        """(postings of all documents, counts of terms where they are known)."""
        return text_postings(self.df, self.key, self.fields, requests.config, with_documents=True), None


@dataclass(frozen=True)
class Lookup:
    """Search a term index; only the buckets of the requested terms are read."""

    index: TermIndex

    def documents(self, requests: Requests, positions: bool) -> tuple[Requests, DataFrame]:
        """As for a scan. The index counts its terms first: the rarest ones become leads, and
        when these have few postings, those of frequent terms are cut down to their documents."""
        self._check(requests)
        spark = requests.asked.sparkSession
        columns = ["term", "weight", "positions"] if positions else ["term"]
        item = f"struct({', '.join(columns)})"
        counts, width = term_counts(spark, self.index, requests.terms)
        requests = requests.led_by(counts)
        led = few(requests.leads, counts, width)
        leads = requests.leads if led and set(requests.leads) != set(requests.terms) else None
        found = find_postings(spark, self.index, requests.terms, leads, item)
        return requests, found.withColumnRenamed("items", "found")

    def postings(self, requests: Requests) -> tuple[DataFrame, DataFrame]:
        """(postings of all documents, counts of terms as the index has them)."""
        self._check(requests)
        spark = requests.asked.sparkSession
        return read_postings(spark, self.index), all_counts(spark, self.index)

    def _check(self, requests: Requests) -> None:
        if self.index.config != requests.config:
            raise ValueError(f"the index was built with {self.index.config!r}, the requests "
                             f"with {requests.config!r}")


def matches(requests: Requests, corpus: Scan | Lookup, detail: bool = False,
            per_document: dict[str, str] | None = None) -> DataFrame:
    """(query_id, doc_id) of every request and the documents it holds for.

    With ``detail`` the rows also carry the request and its terms' occurrences in the document,
    for ranking, and the ``per_document`` columns, SQL over (found, here) worked out beforehand.
    """
    if not requests.small:
        return _many_matches(requests, corpus, detail, per_document or {})
    if isinstance(corpus, Lookup) and corpus.index.frequent and not detail and requests.phrases:
        requests = requests.paired(corpus.index.frequent)
    positions = detail or requests.phrases
    requests, documents = corpus.documents(requests, positions)
    documents = _with_terms(documents, per_document or {})
    kept = pairs(requests, documents, "doc_id").where(_holds(requests))
    if not detail:
        return kept.select("query_id", "doc_id")
    return kept.withColumn("found", F.expr("filter(found, f -> array_contains(terms, f.term))"))


def _with_terms(documents: DataFrame, per_document: dict[str, str]) -> DataFrame:
    documents = documents.withColumn("here", F.expr("array_distinct(found.term)"))
    return documents.withColumns({c: F.expr(e) for c, e in per_document.items()})


def _many_matches(requests: Requests, corpus: Scan | Lookup, detail: bool, per_document: dict[str, str]) -> DataFrame:
    """As ``matches``, for a set that is not broadcast. Only postings of requested terms are kept; a frequent
    term's are split by Spark. Documents and requests are joined in whole only where they match."""
    found, counts = corpus.postings(requests)
    asked = requests.rows.select(F.explode("terms").alias("term")).distinct()
    found = stored(found.join(asked, "term", "left_semi"), "requested-postings")
    one = found.select("term", "doc_id", "positions")
    if not isinstance(corpus, Scan) or len(corpus.fields) > 1:  # a term may have a row per weight
        one = stored(one.groupBy("doc_id", "term").agg(F.flatten(F.collect_list("positions")).alias("positions")),
                     "requested-positions")
    counts = one.groupBy("term").agg(F.count("*").alias("n")) if counts is None else counts.join(
        asked, "term", "left_semi")
    kept = decided(requests.rows, one, counts)
    if not detail:
        return kept
    documents = found.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight", "positions")).alias("found"))
    kept = kept.join(_with_terms(documents, per_document), "doc_id").join(requests.rows, "query_id")
    return kept.withColumn("found", F.expr("filter(found, f -> array_contains(terms, f.term))"))


def _holds(requests: Requests) -> str:
    """Whether a pair's request holds, from the request's terms that the document has."""
    # A phrase holds when all its words occur at their distances from one start.
    if requests.alternatives:
        here = "exists(i.terms, u -> u.offset = o and array_contains(mine, u.term))"
        present = f"forall(transform(i.terms, t -> t.offset), o -> {here})"
        starts = """flatten(transform(filter(found, f -> exists(i.terms, t -> t.offset = o and t.term = f.term)),
            f -> transform(f.positions, p -> p - o)))"""
        common = let("os", "array_distinct(transform(i.terms, t -> t.offset))", f"""aggregate(slice(os, 2, size(os)),
            {let("o", "os[0]", starts)}, (at, o) -> array_intersect(at, {starts}))""")
    else:
        present = "forall(i.terms, t -> array_contains(mine, t.term))"
        starts = """flatten(transform(filter(found, f -> f.term = t.term),
            f -> transform(f.positions, p -> p - t.offset)))"""
        common = f"""aggregate(slice(i.terms, 2, size(i.terms)),
            {let("t", "i.terms[0]", starts)}, (at, t) -> array_intersect(at, {starts}))"""
    if requests.phrases:
        present += f" and (size(i.terms) = 1 or size({common}) > 0)"
    if requests.flat:  # all items are wanted
        return let("mine", "array_intersect(terms, here)", f"forall(items, i -> {present})")
    steps = steps_hold("steps", "present")
    holds = let("present", f"transform(filter(items, i -> {present}), i -> i.item_id)", steps)
    return let("mine", "array_intersect(terms, here)", holds)


def counts(requests: Requests, matched: DataFrame) -> DataFrame:
    """(query_id, n_docs) for every request asked, also those that found nothing."""
    found = matched.groupBy("query_id").agg(F.count("*").alias("n"))
    return requests.asked.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


def matching_rows(df: DataFrame, key: str, matched: DataFrame) -> DataFrame:
    """The rows of a base table that any request matched; a table clustered by its key is read where
    they are only."""
    return rows_of(df, key, matched.select("doc_id"), "matched")
