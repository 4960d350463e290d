"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from trawl.session import ship_package, small_batches

# ASCII white space, as a Java regular expression; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Make a session ready for this package: its modules on the executors, and small batches."""
    ship_package(spark)
    small_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in a session that is made ready."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def with_computed(df: DataFrame, keep: list[str], inputs: list[Column], work: Callable, name: str,
                  kind: DataType) -> DataFrame:
    """The columns ``keep`` and one more that ``work`` makes of batches with these and the inputs.

    Columns go by number on the way, as mapInArrow does not take every name. ``work`` returns the
    kept columns, in their order, and the new one.
    """
    kept = [c.alias(f"c{i}") for i, c in enumerate(quoted(keep))]
    fields = df.select(*kept).schema.fields
    rows = df.select(*kept, *(c.alias(f"i{i}") for i, c in enumerate(inputs)))
    schema = StructType([*fields, StructField("made", kind)])
    return rows.mapInArrow(work, schema).toDF(*keep, name)


# Bits of the table that tells which rows may be wanted: a million bytes for any number of rows.
FILTER_BITS = 23


def maybe_wanted(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be among the one column of ``wanted``, in ``_maybe``.

    All rows stay; ``_maybe`` is false only for keys that are not wanted. A bit table of hashed keys,
    of at most 2^17 rows, is broadcast, so that a join for the wanted rows needs to move few others.
    With far more wanted keys than bits, it is true for most rows. Null is a key like any other.
    """
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))

    bits = wanted.select(place(quoted(wanted.columns)[0]).alias("_p")).select(
        F.shiftright("_p", 6).alias("_word"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("_bit"))
    words = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = df.withColumn("_p", place(key)).withColumn("_word", F.shiftright("_p", 6))
    hit = F.expr("coalesce(_bits & shiftleft(1L, cast(_p & 63 as int)), 0L) <> 0")
    return placed.join(F.broadcast(words), "_word", "left").withColumn("_maybe", hit).drop("_p", "_word", "_bits")


def first_by_hash(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """At most ``most`` of a table's ``n`` rows, those with the lowest hashes of a key.

    A hash share of about twice as many rows is taken first, as Spark brings the lowest rows of each
    partition to the driver.
    """
    share = max(1, n // (2 * most))
    some = df.where(F.pmod(F.xxhash64(key, F.lit(share)), F.lit(share)) == 0) if share > 1 else df
    return some.orderBy(F.xxhash64(key), key).limit(most)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    digits = F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(digits), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
