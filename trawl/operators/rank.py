"""Relevance of matched documents, from term occurrences already grouped by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.analysis import ANY_DOCUMENT, let
from trawl.operators.match import Lookup, Scan, matches
from trawl.plans.requests import Requests

# Fixed values of the ranking formula.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
HARMONIC = 1.64493406685
NEAR = 100
FAR_ROOT = 1e-15  # square root of the 1e-30 given to pairs further apart than NEAR
NO_PAIR = 1e-20


def ranked(requests: Requests, corpus: Scan | Lookup) -> DataFrame:
    """(query_id, doc_id, rank) of every match; adds no shuffle to matching.

    A term's score in a document is the same for all requests, so it is worked out once per
    document, before requests are paired with it. Pairs of terms are scored per request.
    """
    by_term, by_pairs, per_document = True, True, {}
    mean = f"{_sum(f'transform(wanted, word -> {_term_score()})')} / size(wanted)"
    if requests.small:
        alone = [op in ("or", "not") or len(set(terms) - {ANY_DOCUMENT}) < 2 for op, terms in
                 zip(requests.head["top_op"].to_pylist(), requests.head["terms"].to_pylist())]
        by_term, by_pairs = any(alone), not all(alone)
        if by_term:
            per_document["scores"] = f"""transform(here, word ->
                named_struct('term', word, 'score', {_term_score()}))"""
            asked = "filter(scores, s -> array_contains(wanted, s.term))"
            mean = f"{_sum(f'transform({asked}, s -> s.score)')} / size(wanted)"
    if by_term and by_pairs:
        mean = f"if(top_op in ('or', 'not') or size(wanted) < 2, {mean}, {_pair_score()})"
    score = let("wanted", f"array_remove(terms, '{ANY_DOCUMENT}')",
                mean if by_term else _pair_score())
    return matches(requests, corpus, detail=True, per_document=per_document).select(
        "query_id", "doc_id", F.expr(score).alias("rank"))


def best_first(scored: DataFrame) -> DataFrame:
    return scored.orderBy("query_id", F.desc("rank"), "doc_id")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each request, numbered from 1; ties go to the lower key.

    Each document-hash share of a request is cut to k first, so a request that matches most of
    the table never brings its matches into one task.
    """
    best = [F.desc("rank"), F.asc("doc_id")]
    shares = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares))
    place = F.row_number().over(Window.partitionBy("query_id", "_share").orderBy(*best))
    cut = (scored.withColumn("_share", share).withColumn("place", place)
              .where(F.col("place") <= k).drop("_share", "place"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return cut.withColumn("place", place).where(F.col("place") <= k)


def _occurrences(found: str) -> str:
    """``array<struct<pos, term, w>>`` in position order."""
    labels = " ".join(f"when '{label}' then {w}D" for label, w in WEIGHTS.items())
    return f"""sort_array(flatten(transform({found}, f -> transform(f.positions, p ->
        named_struct('pos', p, 'term', f.term, 'w', case f.weight {labels} end)))))"""


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (total, value) -> total + value)"


def _term_score() -> str:
    """A weighted, damped sum over the occurrences of the term ``word`` in a document."""
    weights = f"transform({_occurrences('filter(found, f -> f.term = word)')}, o -> o.w)"
    damped = _sum("transform(ws, (w, j) -> w / ((j + 1D) * (j + 1D)))")
    one = let("best", "array_max(ws)", f"""(best + {damped}
        - best / pow(array_position(ws, best), 2)) / {HARMONIC}D""")
    return let("ws", weights, f"if(size(ws) = 0, 0D, {one})")


def _pair_score() -> str:
    """1 - prod(1 - c) over pairs of occurrences of two different terms.

    c falls with the distance and is a constant times the weights' root beyond NEAR. Positions
    are unique within a document, so the near partners of an occurrence are among the next
    NEAR entries; all further pairs are summed in closed form from per-term totals.
    """
    zero = "named_struct('log', 0D, 'root', 0D)"
    near = f"""aggregate(
        filter(slice(occ, i + 2, {NEAR}), y -> y.term <> x.term and y.pos - x.pos <= {NEAR}), {zero},
        (sums, y) -> named_struct(
            'log', sums.log + log1p(-sqrt(x.w * y.w
                / (1.005D + 0.05D * exp((y.pos - x.pos) / 1.5D - 2D)))),
            'root', sums.root + sqrt(x.w * y.w)))"""
    pairs = f"""aggregate(transform(occ, (x, i) -> {near}), {zero}, (a, b) ->
        named_struct('log', a.log + b.log, 'root', a.root + b.root))"""
    totals = f"""transform(array_distinct(transform(occ, o -> o.term)), word ->
        {_sum("transform(filter(occ, o -> o.term = word), o -> sqrt(o.w))")})"""
    every_root = f"(pow({_sum('roots')}, 2) - {_sum('transform(roots, r -> r * r)')}) / 2"
    score = let("near", pairs, f"""-expm1(
        near.log - {FAR_ROOT}D * greatest({every_root} - near.root, 0D))""")
    scored = let("roots", totals, f"if(size(roots) < 2, {NO_PAIR}D, {score})")
    return let("occ", _occurrences(f"filter(found, f -> f.term <> '{ANY_DOCUMENT}')"), scored)
