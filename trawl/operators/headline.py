"""Excerpts of matched documents with the requested words marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.analysis import let, with_lexemes
from trawl.plans.requests import Requests
from trawl.session import rows_of, stored

WORD_AND_GAP = r"([\p{L}\p{N}]+)([^\p{L}\p{N}]*)"


def headlines(requests: Requests, matched: DataFrame, df: DataFrame, key: str, text: str,
              max_words: int = 15, min_words: int = 5, start: str = ">>>",
              stop: str = "<<<") -> DataFrame:
    """(query_id, doc_id, headline): the first window of ``max_words`` words that holds the
    most distinct request terms, or the first ``min_words`` words where none occurs.

    Only matched documents are taken up again, from the row groups that hold them where the table is
    clustered by its key, and each one's words stay within its row. The matches are stored first:
    their size then decides whether they are broadcast, instead of all texts being shuffled to meet
    a few matches.
    """
    matched = stored(matched.select("query_id", "doc_id"), "matched")
    docs = rows_of(df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "doc_id",
                   matched.select("doc_id"), "headline-keys")
    rows = matched.join(docs, "doc_id")
    asked = requests.rows.selectExpr("query_id", "terms as _terms")
    rows = rows.join(F.broadcast(asked) if requests.small else asked, "query_id")
    rows = rows.selectExpr(
        "query_id", "doc_id", "_terms",
        f"regexp_extract_all(coalesce(_text, ''), r'{WORD_AND_GAP}', 1) as _words",
        f"regexp_extract_all(coalesce(_text, ''), r'{WORD_AND_GAP}', 2) as _gaps")
    rows = with_lexemes(rows, "_words", requests.config, "_lexemes")
    excerpt = F.expr(_excerpt(max_words, min_words))
    marks = F.create_map(F.lit("start"), F.lit(start), F.lit("stop"), F.lit(stop))
    return rows.withColumn("_marks", marks).select("query_id", "doc_id", excerpt.alias("headline"))


def _excerpt(max_words: int, min_words: int) -> str:
    size = "size(_lexemes)"
    hits = f"""filter(if({size} > 0, sequence(0, {size} - 1), cast(array() as array<int>)),
        i -> array_contains(_terms, _lexemes[i]))"""
    richest = f"""array_max(transform({hits}, i -> named_struct('n', size(array_distinct(filter(
        slice(_lexemes, i + 1, {max_words}), t -> array_contains(_terms, t)))), 'at', -i)))"""
    # Near the end of a text the window starts earlier, to reach min_words.
    span = let("best", richest, f"""named_struct(
        'first', if(best is null, 0, greatest(least(-best.at, {size} - {min_words}), 0)),
        'words', if(best is null, {min_words}, {max_words}))""")
    window = let("span", span, f"sequence(span.first, least(span.first + span.words, {size}) - 1)")
    text = """array_join(transform(at, i -> concat(
        if(array_contains(_terms, _lexemes[i]),
           concat(_marks['start'], _words[i], _marks['stop']), _words[i]),
        if(i < try_element_at(at, -1), _gaps[i], ''))), '')"""
    return f"if({size} = 0, '', {let('at', window, text)})"
