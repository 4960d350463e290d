"""Session-level helpers: the shared work folder and size-checked small tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A request set is fetched and sent to every executor only up to this many bytes and terms; the
# bytes are added up by Spark before any row is fetched.
SMALL_BYTES = 4 << 20
# More distinct terms than this are joined as a table instead of being written into the query.
SMALL_TERMS = 10_000

_made: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, inside the folder the cluster names.

    That is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given; it has to be reachable
    from every executor. A folder of this machine takes its place only on a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@lru_cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="trawl-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the work folder and read it back, which cuts its lineage."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete the work folders made so far. Call it once results are written: tables that were
    returned but not written yet may read from them."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, name: str) -> tuple[DataFrame, pa.Table | None]:
    """Evaluate a table that is expected to be small, once.

    The table is stored, and its rows are fetched when the written files, and so the rows that
    are sent on, are small. Otherwise no rows are returned, so that callers join it by shuffle.
    """
    table = stored(df, name)
    path = _made[-1]
    if folder_bytes(df.sparkSession, path) > SMALL_BYTES:
        return table, None
    head = table.toArrow()
    if head.nbytes > 8 * SMALL_BYTES:
        return table, None
    return df.sparkSession.createDataFrame(head, df.schema), head


def folder_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength()


def local_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A few values given on the driver, as a local relation."""
    return spark.createDataFrame(pa.table(columns))


def with_column(df: DataFrame, head: pa.Table, name: str, values: list) -> DataFrame:
    """A pinned table with one column replaced."""
    at = head.column_names.index(name)
    changed = head.set_column(at, name, pa.array(values, head.schema.field(name).type))
    return df.sparkSession.createDataFrame(changed, df.schema)


# Keys of wanted rows become so many ranges at most, which a table's files are pruned by.
MOST_RANGES = 64


def key_ranges(keys: pa.Array, most: int = MOST_RANGES) -> list[tuple]:
    """(first, last) of at most ``most`` ranges that hold all keys: parted at the widest gaps, or, where
    keys cannot be subtracted, into equal numbers of keys."""
    ordered = pc.unique(keys.drop_null())
    ordered = ordered.take(pc.sort_indices(ordered))
    n = len(ordered)
    if not n:
        return []
    if pa.types.is_integer(ordered.type):
        values = ordered.to_numpy()
        gaps = np.diff(values.astype(np.float64))
        cuts = np.sort(np.argsort(-gaps, kind="stable")[:most - 1]) + 1
    else:
        cuts = np.unique(np.linspace(0, n, min(most, n) + 1).astype(int))[1:-1]
    edges = [0, *cuts.tolist(), n]
    return [(ordered[a].as_py(), ordered[b - 1].as_py()) for a, b in zip(edges[:-1], edges[1:])]


def rows_of(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """The rows of a table whose key is among the one column of ``keys``.

    Few keys are fetched and become ranges, which Spark pushes into the files: of a table that is
    clustered by its key, only the row groups that hold them are read. The keys themselves then decide
    by a join, which broadcasts them where they are small.
    """
    wanted = keys.toDF("_wanted").distinct()
    table, head = pinned(wanted, name)
    if head is not None and head.num_rows:
        given = head.column(0).combine_chunks()
        tests = [F.col(key).between(a, b) for a, b in key_ranges(given)]
        tests += [F.col(key).isNull()] if given.null_count else []
        df = df.where(reduce(Column.__or__, tests))
    return df.join(table, F.col(key).eqNullSafe(F.col("_wanted")), "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table's rows out to all cores, for files that Spark reads in few splits.

    Row-wise text work is CPU bound, and a file with one row group is one task, however many splits
    its bytes make. Tables of many more splits than cores are left alone. The operators never move
    texts by themselves; this is for their callers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 4 * cores else df.repartition(cores)


# Rows of text in a batch that a Python worker gets, unless the session says otherwise.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large rows, so Spark's default of 10,000 rows to a batch is lowered for the
    session; another value than the default is left alone."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Arrow functions import it."""
    context = spark.sparkContext
    if getattr(context, "_trawl_shipped", False):
        return
    package = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="trawl-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._trawl_shipped = True
