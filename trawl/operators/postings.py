"""Postings: one row per (term, document, weight) with the positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.analysis import ANY_DOCUMENT, CONFIGS, STOP_WORDS, document_entry, with_entries, words
from trawl.functions.stemming import stem
from trawl.session import ship_package, small_batches


def text_tokens(df: DataFrame, key: str, text: str, config: str = "simple") -> DataFrame:
    """(doc_id, pos, term), one row per kept word."""
    return (with_entries(df.select(key, text), [(text, "D")], config)
            .selectExpr(f"`{key}` as doc_id", "inline(entries)").select("doc_id", "pos", "term"))


def read_as(config: str, frequent: tuple[str, ...]) -> str:
    """How a document's text was read, for its digest."""
    return " ".join([config, *frequent]) if frequent else config


def _tokens(batch: pa.RecordBatch, weights: list[str], config: str) -> tuple[pa.Array, np.ndarray]:
    """(terms in byte order, tokens) of a batch of documents. Tokens are rows of (term, weight, document,
    position), all but the position by number, field by field in the order of documents and positions.

    Positions are those of ``with_entries``: stop words leave a gap, and a later field continues after the
    last kept position of the earlier ones.
    """
    lists = [batch.column(f"words_{k}") for k in range(len(weights))]
    coded = pa.concat_arrays([words_of.flatten() for words_of in lists]).dictionary_encode()
    terms, at = coded.dictionary, coded.indices.to_numpy()
    kept = np.ones(len(at), bool)
    if config == "english":
        kept = ~pc.is_in(terms, value_set=pa.array(STOP_WORDS, terms.type)).to_numpy(zero_copy_only=False)[at]
        stems = pa.array([stem(w) for w in terms.to_pylist()], terms.type).dictionary_encode()
        terms, at = stems.dictionary, stems.indices.to_numpy()[at]
    order = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    documents, tokens, begin = np.arange(batch.num_rows), [], 0
    last = np.zeros(batch.num_rows, np.int64)
    for k, field in enumerate(lists):
        sizes = pc.list_value_length(field).to_numpy(zero_copy_only=False).astype(np.int64)
        end = begin + sizes.sum()
        here = kept[begin:end]
        row = np.repeat(documents, sizes)[here]
        pos = (np.arange(1, end - begin + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes))[here] + last[row]
        last[row] = pos  # of a document's positions the last one stays
        tokens.append(np.stack([place[at[begin:end][here]], np.full(len(row), k), row, pos]))
        begin = end
    return terms.take(pa.array(order)), np.concatenate(tokens, axis=1)


def _with_pairs(terms: pa.Array, tokens: np.ndarray, frequent: tuple[str, ...]) -> tuple[pa.Array, np.ndarray]:
    """Terms and tokens with the pairs of frequent words, which follow the other terms."""
    tokens = tokens[:, np.argsort(tokens[2], kind="stable")]
    known = pc.is_in(terms, value_set=pa.array(frequent, terms.type)).to_numpy(zero_copy_only=False)[tokens[0]]
    first, second = tokens[:, :-1], tokens[:, 1:]
    pair = known[:-1] & known[1:] & (first[2] == second[2]) & (first[3] + 1 == second[3])
    first, second = first[:, pair].copy(), second[0, pair]
    found, first[0] = np.unique(first[0] * len(terms) + second, return_inverse=True)
    first[0] += len(terms)
    both = [f"{terms[int(p) // len(terms)]} {terms[int(p) % len(terms)]}" for p in found]
    return pa.concat_arrays([terms, pa.array(both, terms.type)]), np.concatenate([tokens, first], axis=1)


def _grouped(batch: pa.RecordBatch, weights: list[str], config: str, frequent: tuple[str, ...]) -> pa.RecordBatch:
    """The postings of a batch of documents in the order of their terms, after the rows that stand for the
    documents themselves, if these were asked for."""
    terms, tokens = _tokens(batch, weights, config)
    if frequent:
        terms, tokens = _with_pairs(terms, tokens, frequent)
    labels, label = np.unique(weights, return_inverse=True)
    tokens[1] = label[tokens[1]]
    group = (tokens[0] * len(labels) + tokens[1]) * batch.num_rows + tokens[2]
    order = np.argsort(group, kind="stable")
    group, tokens = group[order], tokens[:, order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    term, weight, document, _ = tokens[:, starts]
    columns = [terms.take(pa.array(term)), pa.array(labels, pa.string()).take(pa.array(weight))]
    values, ends = pa.array(tokens[3], pa.int32()), np.append(starts, len(group))
    names, owner = set(batch.schema.names), document
    if "digest" in names:
        n, digests = batch.num_rows, batch.column("digest")
        own = digests.flatten()
        columns = [pa.concat_arrays([pa.array([same] * n, pa.string()), found.cast(pa.string())])
                   for same, found in zip((ANY_DOCUMENT, "D"), columns)]
        ends = np.concatenate([np.append(0, np.cumsum(pc.list_value_length(digests).to_numpy()))[:-1], ends + len(own)])
        values, owner = pa.concat_arrays([own.cast(pa.int32()), values]), np.append(np.arange(n), document)
    columns.insert(1, batch.column("doc_id").take(pa.array(owner)))
    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
    if "version" in names:
        own = np.arange(len(owner)) >= (batch.num_rows if "digest" in names else 0)
        columns.append(batch.column("version").take(pa.array(owner, mask=own)))
    return pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "weight", "positions", "version"][:len(columns)])


def frequent_terms(df: DataFrame, key: str, fields: list[tuple[str, str]], config: str = "english",
                   share: float = 0.1, most: int = 64) -> tuple[str, ...]:
    """The terms that at least a share of all documents have, the most frequent first, ``most`` at most.

    Terms are made distinct inside their row, so that only counts are shuffled. Rows that share a key are one
    document: where there are any, their terms are made distinct once more, by key.
    """
    entries = with_entries(df.select(key, *[name for name, _ in fields]), fields, config)
    terms = f"array_append(array_distinct(transform(entries, e -> e.term)), '{ANY_DOCUMENT}')"
    rows = entries.selectExpr(f"`{key}` as doc_id", f"explode({terms}) as term")
    if not df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        rows = rows.distinct()
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    documents = counts.where(f"term = '{ANY_DOCUMENT}'").select(F.col("n").alias("_all"))
    found = counts.where(f"term <> '{ANY_DOCUMENT}'").join(F.broadcast(documents)).where(F.col("n") >= share * F.col("_all"))
    return tuple(r["term"] for r in found.orderBy(F.desc("n"), "term").limit(most).collect())


def text_postings(df: DataFrame, key: str, fields: list[tuple[str, str]], config: str = "english",
                  with_documents: bool = False, version: str | None = None,
                  frequent: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, weight, positions) of weighted text fields, without a shuffle.

    ``with_documents`` adds the row that stands for the document itself, and ``version`` a column with
    the document's version in that row. Two words after each other that are both ``frequent`` also
    have postings together, as one term with a space, at the first one's position and weight.

    Words are found by Spark and grouped by an Arrow function, batch by batch. A batch's postings come in
    the order of their terms, whatever its documents, so that a sort by term finds long runs.
    """
    if config not in CONFIGS:
        raise ValueError(f"config must be one of {CONFIGS}, not {config!r}")
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    weights = [weight for _, weight in fields]
    given = [F.col(key).alias("doc_id"), *[F.expr(words(f"coalesce(`{name}`, '')")).alias(f"words_{k}")
                                           for k, (name, _) in enumerate(fields)]]
    if with_documents:
        given.append(F.expr(f"{document_entry(fields, read_as(config, frequent))}.positions").alias("digest"))
    schema = [T.StructField("term", T.StringType()), T.StructField("doc_id", df.schema[key].dataType),
              T.StructField("weight", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    if version is not None:
        given.append(F.col(version).alias("version"))
        schema.append(T.StructField("version", df.schema[version].dataType))
    return df.select(*given).mapInArrow(
        lambda batches: (_grouped(batch, weights, config, frequent) for batch in batches), T.StructType(schema))
