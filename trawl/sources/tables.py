"""Base tables: declared schemas, defaults and rejects, JSON parsing, repeatable loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.analysis import text_list
from trawl.functions.jsonb import parsed
from trawl.sources.buckets import one_per_key, path_exists

ARTICLES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType())])
PRODUCTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("attributes", T.VariantType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table, unless one is already there; existing data is never touched."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
    return read_table(spark, path, schema)


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Append a table to a target that has no rows yet; returns whether it was written."""
    spark = df.sparkSession
    if path_exists(spark, path) and not read_table(spark, path, df.schema).isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def load_new(df: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """Append the rows whose key the target does not have; null is a key like any other. Of new rows
    with the same key the last one by the column ``order`` is loaded; without one, such rows are
    refused."""
    spark = df.sparkSession
    if path_exists(spark, path):
        known = read_table(spark, path, df.schema).select(F.col(key).alias("_known"))
        df = df.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    one_per_key(df, key, order).write.mode("append").parquet(path)


def cluster_table(df: DataFrame, path: str, key: str) -> None:
    """Write a table in the order of its key, so that rows fetched by key are read from few row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def split_rejects(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the rows that lack one."""
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    return df.where(~missing), df.where(missing)


def json_value(text: str, default: str | None = None, strict: bool = True) -> Column:
    """A JSON text column as a variant. Text that is not one JSON value fails the job, or gives
    NULL when not strict; absent text takes the default.

    Of repeated keys the last one counts, once ``keep_last_key`` was called on the session.
    """
    given = f"`{text}`" if default is None else f"coalesce(`{text}`, {text_list([default])})"
    return F.expr(parsed(given, strict))


def keep_last_key(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def split_bad_json(df: DataFrame, text: str, to: str,
                   default: str = "{}") -> tuple[DataFrame, DataFrame]:
    """Rows with ``text`` parsed into ``to`` (absent text takes the default), and the rows whose
    text is not JSON, unchanged."""
    keep_last_key(df.sparkSession)
    parsed = df.withColumn(to, json_value(text, default, strict=False))
    return parsed.where(F.col(to).isNotNull()), parsed.where(F.col(to).isNull()).select(*df.columns)
