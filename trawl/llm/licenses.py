"""Licence scan: canonical digests of whole texts, joined to the digests of known licences.

The canonical form lower-cases A to Z, drops copyright lines, makes each run of punctuation and
white space one space, and unites equivalent spellings. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import ascii_lower, quoted, text_or_empty
from trawl.llm.license_texts import NOTICES, SPELLINGS, TEXTS

# Optional comment marks, then a copyright sign or word with a sign, a year or a place for one.
COPYRIGHT = r"^[^a-z0-9\n]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|<year>|\[yyyy\])|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
# Letters and digits stay: ASCII, and all above Latin-1 punctuation but two blocks of punctuation.
PUNCTUATION = r"[^a-z0-9\n\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text that keeps its line breaks; words are padded with spaces."""
    plain = F.regexp_replace(ascii_lower(text), "(?md)" + COPYRIGHT, "")
    spaced = F.regexp_replace(plain, PUNCTUATION, "  ")
    form = F.concat(F.lit(" "), F.replace(spaced, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        old, new = (f" {x.replace(' ', '  ')} " for x in (old, new))
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def whole(lines: Column) -> Column:
    """The canonical form as one line."""
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, digest) of the known texts and notices: a few dozen rows, whatever is scanned."""
    rows = [*TEXTS.items(), *((name, text) for text, name in NOTICES.items())]
    texts = spark.createDataFrame(rows, "license string, text string")
    return texts.select("license", digest(whole(canonical_lines(F.col("text")))).alias("digest"))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with digest, license and line_licenses.

    ``license`` is the known licence whose canonical text the whole text is, else null;
    ``line_licenses`` lists, sorted and once each, the licences of which a whole line is the known
    text (null texts count as empty; an empty text has no licence). ``known`` has a few dozen
    rows of (license, digest) with one licence per digest; it is joined by hash for whole texts and
    looked up in a map for lines, so that rows never move. Columns with the names of the result's
    are replaced. Repeated rows stay; an empty table gives an empty result. Texts are hashed in whole,
    line by line and together, inside their row, however long they are.
    """
    listed = [(r["digest"], r["license"]) for r in known.distinct().collect()]
    by_digest = F.create_map(*(F.lit(x) for pair in listed for x in pair))
    given = quoted([c for c in docs.columns if c not in ("digest", "license", "line_licenses")])
    rows = docs.select(F.struct(*given).alias("_row"), canonical_lines(text_or_empty(text_col)).alias("_lines"))
    names = F.transform(F.split("_lines", "\n"), lambda line: F.try_element_at(
        by_digest, digest(F.btrim(F.regexp_replace(line, " +", " ")))))
    rows = rows.select("_row", digest(whole(F.col("_lines"))).alias("digest"),
                       F.array_sort(F.array_distinct(F.array_compact(names))).alias("line_licenses"))
    return rows.join(F.broadcast(known.distinct()), "digest", "left").select(
        "_row.*", "digest", "license", "line_licenses")
