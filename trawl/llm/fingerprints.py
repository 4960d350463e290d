"""Document fingerprints: bottom-k sketches of word-shingle hashes, with SQL functions only.

A sketch is the ascending array of the ``K`` smallest distinct 48-bit hashes of a text's shingles.
The sketch of a union of texts is the bottom k of the united sketches, so sketches merge across
parts. Shingles are five lower-cased words; a text with one to four words is one shingle, a text
without words (or null) has an empty sketch.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trawl.llm.common import BLANKS, text_or_empty
from trawl.session import stored

K = 256
WIDTH = 5
HASH_BITS = 48


def words(text: Column) -> Column:
    """Lower-cased runs of characters other than ASCII white space."""
    return F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\f\r"))), BLANKS)


def shingle_hashes(ws: Column) -> Column:
    """48-bit hash of each run of ``WIDTH`` words; ``ws`` should be a column that is evaluated."""
    def run(word: Column, at: Column) -> Column:
        return F.shiftrightunsigned(
            F.xxhash64(word, *(F.get(ws, at + i) for i in range(1, WIDTH))), 64 - HASH_BITS)

    whole = F.transform(F.slice(ws, 1, F.least(F.size(ws), F.lit(1))),
                        lambda _: F.shiftrightunsigned(F.xxhash64(ws), 64 - HASH_BITS))
    few = F.when(F.element_at(ws, 1) == "", F.array().cast("array<bigint>")).otherwise(whole)
    return F.when(F.size(ws) < WIDTH, few).otherwise(
        F.slice(F.transform(ws, run), 1, F.size(ws) - (WIDTH - 1)))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K) -> DataFrame:
    """Add the sketch of a text column."""
    return (df.withColumn("_words", words(text)).withColumn("_hashes", shingle_hashes(F.col("_words")))
            .withColumn(name, bottom(F.col("_hashes"), k)).drop("_words", "_hashes"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return bottom(F.concat(a, b), k)


def n_distinct(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than k."""
    top = F.element_at(sketch, -1)
    estimate = (k - 1) * F.lit(float(2**HASH_BITS)) / (top + 1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(estimate)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sets are alike (1), an empty and another not."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty set is contained in any."""
    share = resemblance(a, b, k) * n_distinct(merge(a, b, k), k) / n_distinct(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def text_form(sketch: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits per hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 12, "0")), ""))


def _longs(values: list[int]) -> str:
    """SQL for an array of bigint; the lowest one has no literal of its own."""
    return "array(" + ", ".join(f"bigint('{v}')" for v in values) + ")"


def in_ranges(docs: DataFrame, id_col: str, ties: list[str], per_partition: int = 4) -> tuple[DataFrame, WindowSpec]:
    """The rows dealt into ranges of the id, and the window in which each row's next one follows it.

    The order is by descending id; after the last row comes the first again. Ranges lie between
    quantiles of the id, which are ids themselves. A row at the upper end of a range is also sent to
    the range above, as a guest (``_guest`` = 1) that ends its list, so that no window holds more than
    one range. Null ids come last; rows with the same id follow each other in the order of ``ties``,
    but those of an id that more rows share than a range should have are dealt over several ranges and
    follow each other in no stated order. One row alone is its own next.
    """
    n = per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col), F.lit(-2**63).cast("long")))
    found = keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n + 1)], 20 * n).alias("q"),
                      F.max("_key").alias("top")).first()
    ends = sorted({*(found["q"] or []), found["top"] or 0})
    hot = {end: times for end, times in Counter(found["q"] or []).items() if times > 1}
    if hot:
        return _in_split_ranges(keyed, ties, ends, hot)
    ranged, at_end = _ranged(keyed, ends)
    own = F.struct(F.col("_range").alias("_range"), F.lit(0).alias("_guest"))
    above = F.struct(((F.col("_range") + 1) % len(ends)).alias("_range"), F.lit(1).alias("_guest"))
    copies = F.when(at_end, F.array(own, above)).otherwise(F.array(own))
    dealt = ranged.withColumn("_copy", F.explode(copies)).drop("_range").select("*", "_copy.*").drop("_copy")
    return dealt, Window.partitionBy("_range").orderBy("_guest", F.col("_key").desc(), *ties)


def _ranged(keyed: DataFrame, ends: list[int]) -> tuple[DataFrame, Column]:
    """The rows with ``_range``, the number of the first end that is not below their key, and whether
    the key is that end."""
    # Two levels of boundaries keep the search per row at the square root of their number.
    width = max(1, round(len(ends) ** 0.5))
    blocks = [ends[i:i + width] for i in range(0, len(ends), width)]
    lasts = F.expr(_longs([b[-1] for b in blocks]))
    inner = F.expr(f"array({', '.join(map(_longs, blocks))})")
    ranged = keyed.withColumn("_block", F.size(F.filter(lasts, lambda e: e < F.col("_key"))))
    at = F.size(F.filter(F.get(inner, F.col("_block")), lambda e: e < F.col("_key")))
    ranged = ranged.withColumn("_range", (F.col("_block") * width + at).cast("int"))
    last = F.get(F.expr(_longs(ends)), F.col("_range"))
    return ranged.drop("_block"), last == F.col("_key")


def _in_split_ranges(keyed: DataFrame, ties: list[str], ends: list[int],
                     hot: dict[int, int]) -> tuple[DataFrame, WindowSpec]:
    """As ``in_ranges``, with the rows of a hot id dealt over as many ranges as quantiles fell on it.

    The rows are stored first, as their numbers decide. Only the first row of a range goes to the
    range above as a guest.
    """
    spark = keyed.sparkSession
    rows = stored(keyed.withColumn("_salt", F.monotonically_increasing_id()).withColumn("_tie", F.xxhash64(*ties)), "hot-ids")
    ranged, at_end = _ranged(rows, ends)
    before = [sum(hot.get(e, 0) for e in ends[:i]) for i in range(len(ends))]
    shift = F.get(F.expr(_longs(before)), F.col("_range"))
    pieces = F.get(F.expr(_longs([hot.get(e, 0) for e in ends])), F.col("_range"))
    piece = F.when(at_end & (pieces > 0), 1 + F.pmod(F.xxhash64("_salt"), F.greatest(pieces, F.lit(1)))).otherwise(0)
    ranged = ranged.withColumn("_range", (F.col("_range") + shift + piece).cast("int"))
    first = F.min(F.struct(F.bitwise_not("_key").alias("k"), "_tie", "_salt")).alias("first")
    firsts = sorted((r["_range"], r["first"]["_salt"]) for r in ranged.groupBy("_range").agg(first).collect())
    above = [(salt, firsts[(i + 1) % len(firsts)][0]) for i, (_, salt) in enumerate(firsts)]
    guests = spark.createDataFrame(above, "_salt long, _above int")
    own = F.struct(F.col("_range").alias("_range"), F.lit(0).alias("_guest"))
    guest = F.struct(F.col("_above").alias("_range"), F.lit(1).alias("_guest"))
    copies = F.when(F.col("_above").isNotNull(), F.array(own, guest)).otherwise(F.array(own))
    dealt = ranged.join(F.broadcast(guests), "_salt", "left").withColumn("_copy", F.explode(copies)).drop(
        "_range", "_above").select("*", "_copy.*").drop("_copy")
    return dealt, Window.partitionBy("_range").orderBy("_guest", F.col("_key").desc(), "_tie", "_salt")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch next to that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document's, in descending id order, the first document following the last.
    Null texts count as empty; see ``in_ranges`` for ties and null ids; repeated rows are rows of their
    own. Whole texts are sketched, however long. Other columns are ignored, whatever their names. An
    empty table gives an empty result. Texts move through one shuffle, together with their neighbours.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    dealt, order = in_ranges(rows, "_id", ["_text"])
    here = with_sketch(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range"),
                       F.col("_text"), "_sketch")
    paired = here.withColumn("_next", F.lead("_text").over(order)).withColumn(
        "_next_sketch", F.lead("_sketch").over(order)).where("_guest = 0")
    n = F.length("_text")
    paired = paired.withColumn("_n", n.cast("long")).withColumn("_cut", F.floor(n / 3).cast("int"))
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("_n").cast("int") - F.col("_cut")),
                      F.substring(F.col("_next"), F.lit(1), F.col("_cut")))
    paired = with_sketch(paired.withColumn("_edited", edited), F.col("_edited"), "_edited_sketch")
    return paired.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("_sketch").alias("sketch"), F.col("_edited_sketch").alias("edited_sketch"),
        F.col("_next_sketch").alias("next_sketch"))
