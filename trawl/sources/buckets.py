"""Index tables: Parquet folders ``key_bucket=<k>/<bucket>=<b>/``, where the first is a hash of the key.

All rows of a key lie in one key bucket, and rows of an entry in one bucket of each. A lookup reads the
entry's bucket in every key bucket. A change rewrites the key buckets of the changed keys: their rows
without the old ones of these keys, and with the new ones, replace the touched folders by Spark's dynamic
partition overwrite. The new rows are staged first, and a change that was cut off after that is
finished by the next one, so a writer may die at any step and repeat its batch, which gives the same rows.
One writer at a time changes an index.

Changes of a large index are kept beside it first, one folder each: their rows, and then their keys, whose
being complete makes the change count. Readers take a key's rows from its newest change. When these folders
have grown to a multiple of the index, or are many, the next change brings them all in, so that what an index costs to
keep up does not grow with its size times the number of changes.

Rows whose entry is null stand for nothing: they let a folder be replaced that has no other rows left.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.session import folder_bytes, stored

# Keys are broadcast only when their rows were counted and measured to be at most so many bytes.
LEAD_BYTES = 16 << 20
# Smaller indexes are rewritten by every change. Beside larger ones so many changes are kept at most, up to so
# many times their size.
LARGE_BYTES = 4 << 20
MOST_RECENT, MOST_GROWTH = 64, 1
KEY_BUCKET = "key_bucket"


@dataclass(frozen=True)
class Layout:
    """Where an index is and how its rows are told apart.

    ``entry`` are the columns that rows are looked up by, and ``registry`` selects the one row that
    every key has, with its digest and version. With ``counted``, a table next to the rows holds how
    many of them each entry has, by key bucket.
    """

    path: str
    schema: T.StructType
    bucket: str
    buckets: int
    key_buckets: int
    key: str
    entry: tuple[str, ...]
    registry: str
    counted: bool = False

    @property
    def staged(self) -> str:
        return f"{self.path}/_staged"

    @property
    def counts(self) -> str:
        return f"{self.path}/_counts"

    @property
    def recent(self) -> str:
        return f"{self.path}/_recent"


# ---- files ------------------------------------------------------------------------------------

def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file(spark, path)
    return system.exists(target)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark wrote a table to its end."""
    return path_exists(spark, f"{path}/_SUCCESS")


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _file(spark, path)
    system.delete(target, True)


def _recent_changes(spark: SparkSession, at: Layout) -> list[int]:
    """Numbers of the complete changes that are kept beside the index."""
    path = f"{at.recent}/keys"
    system, target = _file(spark, path)
    found = [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []
    return sorted(int(name.removeprefix("change=")) for name in found if _complete(spark, f"{path}/{name}"))


# ---- writing ----------------------------------------------------------------------------------

def one_per_key(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """The newest row of each key, by the column ``order``; without one, keys have to be unique.

    Null is a key like any other. Only keys are compared to find out, and rows move only when a key
    occurs twice.
    """
    if df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return df
    if order is None:
        raise ValueError(f"{key!r} is not unique: name the column that orders its rows")
    newest = F.max_by(F.struct(*df.columns), F.struct(F.col(order).isNotNull(), order))
    return df.groupBy(key).agg(newest.alias("_row")).select("_row.*")


def version(df: DataFrame, order: str | None) -> Column:
    """The column that orders a key's rows as a whole number, null without one."""
    if order is None:
        return F.lit(None).cast("long")
    kind = df.schema[order].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(order).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    raise ValueError(f"{order!r} has to be a whole number, a date or a timestamp")


def bucket_of(columns: Iterable[str], buckets: int) -> str:
    """SQL for the bucket of an entry or key, given as column names."""
    return f"cast(pmod(xxhash64({', '.join(columns)}), {buckets}) as int)"


def _placed(rows: DataFrame, at: Layout) -> DataFrame:
    return rows.select(*[f.name for f in at.schema.fields]).withColumns({
        KEY_BUCKET: F.expr(bucket_of([at.key], at.key_buckets)), at.bucket: F.expr(bucket_of(at.entry, at.buckets))})


def _write(rows: DataFrame, at: Layout, path: str, dynamic: bool) -> None:
    """Write rows to their folders, sorted by entry; ``dynamic`` replaces only folders that have rows.
    Counts are few and have folders by key bucket only.

    The rebalance brings a folder's rows together to keep files few, and splits them again where a
    frequent entry makes them large, so no task or file grows with the frequency of one entry. What
    replaces rows was staged like that already and is not exchanged again.
    """
    order = [KEY_BUCKET, at.bucket, *at.entry, *([at.key] if at.key in rows.columns else [])]
    by = [KEY_BUCKET] if path == at.counts else [at.bucket] if path.startswith(at.recent) else [KEY_BUCKET, at.bucket]
    dealt = rows if dynamic and path == at.path else rows.hint("rebalance", *by)
    (dealt.sortWithinPartitions(*order)
     .write.partitionBy(*by).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path))


def _width(at: Layout, key: str) -> Column:
    """The bytes of the longest key of a group."""
    fixed = isinstance(at.schema[at.key].dataType, (T.LongType, T.IntegerType))
    return F.lit(8) if fixed else F.coalesce(F.max(F.octet_length(F.col(key).cast("string"))), F.lit(0))


def _counted(rows: DataFrame, at: Layout) -> DataFrame:
    """Of each key bucket and entry: its rows, and the bytes of the longest of their keys."""
    return rows.groupBy(KEY_BUCKET, at.bucket, *at.entry).agg(
        F.count("*").alias("n"), _width(at, at.key).alias("width"))


def is_built(spark: SparkSession, at: Layout) -> bool:
    return _complete(spark, at.path) and (not at.counted or _complete(spark, at.counts))


def _count(spark: SparkSession, at: Layout) -> None:
    if at.counted and not _complete(spark, at.counts):
        _write(_counted(_all(spark, at, at.path), at), at, at.counts, False)


def build_once(rows: DataFrame, at: Layout) -> None:
    """The full build; a complete one is left as it is, an unfinished one is written anew."""
    spark = rows.sparkSession
    if is_built(spark, at):
        return
    if not _complete(spark, at.path):
        _write(_placed(rows, at), at, at.path, False)
    _count(spark, at)


def finish(spark: SparkSession, at: Layout) -> None:
    """Bring in what a change has staged, or count a build that was cut off before. Doing it twice, or
    again after it was cut off, is harmless."""
    if _complete(spark, at.path):
        _count(spark, at)
    if not _complete(spark, at.staged):
        return
    staged = _all(spark, at, at.staged)
    _write(staged, at, at.path, True)
    if at.counted:
        _write(_counted(staged, at), at, at.counts, True)
    for path in (f"{at.recent}/keys", at.recent, at.staged):   # recent changes were staged as well
        _delete(spark, path)


def without(rows: DataFrame, keys: DataFrame, at: Layout, small: bool) -> DataFrame:
    """The rows of other keys than those (one column, ``_key``). Where these are ``small``, rows stay
    where they are, in the order they were read."""
    gone = F.broadcast(keys) if small else keys
    return rows.join(gone, F.col(at.key).eqNullSafe(F.col("_key")), "left_anti")


def replace(rows: DataFrame, keys: DataFrame, at: Layout) -> None:
    """Put ``rows`` in the place of all rows of the keys (one column, ``_key``); keys without rows go."""
    spark = rows.sparkSession
    finish(spark, at)
    changes_ = _recent_changes(spark, at)
    if _is_kept(spark, at, len(changes_)):
        number = max(changes_, default=0) + 1
        _write(_placed(rows, at), at, f"{at.recent}/rows/change={number}", False)
        keys.distinct().write.mode("overwrite").parquet(f"{at.recent}/keys/change={number}")
        return
    new = _placed(rows, at)
    if changes_:
        recent, newest = _recent(spark, at, changes_)
        new = new.unionByName(without(_newest(recent, newest, at), keys, at, False).drop("change"))
        keys = keys.unionByName(newest.select("_key")).distinct()
    touched = keys.groupBy(F.expr(bucket_of(["_key"], at.key_buckets)).alias("bucket")).agg(
        F.count("*").alias("n"), _width(at, "_key").alias("width")).collect()
    if not touched:
        return
    old = _all(spark, at, at.path).where(F.col(KEY_BUCKET).isin([r["bucket"] for r in touched]))
    counts = {r["bucket"]: r["n"] for r in touched}
    left = without(old, keys, at, few(counts, counts, max(r["width"] for r in touched)))
    folders = old.select(KEY_BUCKET, at.bucket).distinct()
    empty = folders.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in at.schema.fields], KEY_BUCKET, at.bucket)
    # Folders that have nothing but such a row keep it until the next full build.
    kept = left.where(F.col(at.entry[0]).isNotNull())
    _write(kept.unionByName(new).unionByName(empty), at, at.staged, False)
    finish(spark, at)


def _is_kept(spark: SparkSession, at: Layout, n: int) -> bool:
    """Whether a change is kept beside the index, which has n of them."""
    recent = folder_bytes(spark, at.recent) if n else 0
    size = folder_bytes(spark, at.path) - recent
    return size >= LARGE_BYTES and recent < MOST_GROWTH * size and n < MOST_RECENT


# ---- reading ----------------------------------------------------------------------------------

def _all(spark: SparkSession, at: Layout, path: str) -> DataFrame:
    if not _complete(spark, path):
        raise FileNotFoundError(f"no complete index at {path}")
    folders = [T.StructField(KEY_BUCKET, T.IntegerType()), T.StructField(at.bucket, T.IntegerType())]
    return spark.read.schema(T.StructType([*at.schema.fields, *folders])).parquet(path)


def _recent(spark: SparkSession, at: Layout, changes_: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows of recent changes, keys (``_key``) with the newest change of each)."""
    number = T.StructField("change", T.IntegerType())
    folders = [T.StructField(KEY_BUCKET, T.IntegerType()), T.StructField(at.bucket, T.IntegerType()), number]
    key = T.StructField("_key", at.schema[at.key].dataType)

    def read(kind: str, fields: list) -> DataFrame:
        path = f"{at.recent}/{kind}"
        return spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(
            *[f"{path}/change={n}" for n in changes_])

    newest = read("keys", [key, number]).groupBy("_key").agg(F.max("change").alias("_newest"))
    return read("rows", [*at.schema.fields, *folders]), newest


def _newest(rows: DataFrame, newest: DataFrame, at: Layout) -> DataFrame:
    """The rows of each key's newest change."""
    same = F.col(at.key).eqNullSafe(F.col("_key"))
    return rows.join(newest, same & (F.col("change") < F.col("_newest")), "left_anti")


def _live(spark: SparkSession, at: Layout) -> DataFrame:
    """The rows of the index with its recent changes."""
    rows = _all(spark, at, at.path)
    changes_ = _recent_changes(spark, at)
    if not changes_:
        return rows
    recent, newest = _recent(spark, at, changes_)
    return _newest(rows.withColumn("change", F.lit(0)).unionByName(recent), newest, at).drop("change")


def read_rows(spark: SparkSession, at: Layout, wanted: str | None = None) -> DataFrame:
    """All (wanted) rows."""
    rows = _live(spark, at).where(F.col(at.entry[0]).isNotNull())
    rows = rows if wanted is None else rows.where(wanted)
    return rows.select(*[f.name for f in at.schema.fields])


def read_counts(spark: SparkSession, at: Layout, wanted: str | None = None) -> DataFrame:
    """(entry, n, width) of all (wanted) entries: their rows and the longest of their keys.

    From the table of counts where there is one, else from the rows themselves. Rows that a recent change
    of a counted index has replaced still count.
    """
    if at.counted:
        fields = [at.schema[c] for c in at.entry] + [
            T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()),
            T.StructField(KEY_BUCKET, T.IntegerType()), T.StructField(at.bucket, T.IntegerType())]
        counts = spark.read.schema(T.StructType(fields)).parquet(at.counts)
        changes_ = _recent_changes(spark, at)
        if changes_:
            counts = counts.unionByName(_counted(_recent(spark, at, changes_)[0], at))
        counts = counts if wanted is None else counts.where(wanted)
    else:
        rows = _live(spark, at)
        counts = _counted(rows if wanted is None else rows.where(wanted), at)
    return counts.where(F.col(at.entry[0]).isNotNull()).groupBy(*at.entry).agg(
        F.sum("n").alias("n"), F.max("width").alias("width"))


def frequencies(spark: SparkSession, at: Layout, wanted: str) -> tuple[dict[tuple, int], int]:
    """(how many rows each wanted entry has, the most bytes of one of their keys).

    ``wanted`` has to be exact: then there are at most as many counts as entries asked for.
    """
    rows = read_counts(spark, at, wanted).collect()
    return {tuple(r[c] for c in at.entry): r["n"] for r in rows}, max((r["width"] or 0 for r in rows), default=0)


def few(entries: Iterable, counts: dict, width: int) -> bool:
    """Whether the keys of all rows of some entries are few enough to broadcast."""
    return sum(counts.get(e, 0) for e in entries) * (width + 16) <= LEAD_BYTES


def gather(spark: SparkSession, at: Layout, wanted: str | None, item: str, leads: str | None = None,
           narrow=None) -> DataFrame:
    """(key, items): the wanted rows of each key as an array of ``item`` (a SQL expression).

    Each row is shuffled once, by key, so a frequent entry is shared out. ``leads`` selects rows
    that a key must have one of, and that were counted to be few: the rows of frequent entries are
    cut down to their keys before the shuffle. ``narrow`` is another function that reduces the rows.
    """
    table = _live(spark, at).where(F.col(at.entry[0]).isNotNull())
    rows = table if wanted is None else table.where(wanted)
    if leads is not None:
        keys = table.where(leads).select(F.col(at.key).alias("_lead")).distinct()
        rows = rows.join(F.broadcast(keys), F.col(at.key).eqNullSafe(F.col("_lead")), "left_semi")
    if narrow is not None:
        rows = narrow(rows)
    return rows.selectExpr(at.key, f"{item} as item").repartition(at.key).groupBy(at.key).agg(
        F.collect_list("item").alias("items"))


# ---- changes ----------------------------------------------------------------------------------

def not_older(df: DataFrame, key: str, order: str | None, at: Layout) -> DataFrame:
    """The rows that are not older than what the index has of their keys, by the column ``order``."""
    if order is None:
        return df
    known = read_rows(df.sparkSession, at, at.registry).select(
        F.col(at.key).alias("_key"), F.col("version").alias("_known")).where("_known is not null")
    held = df.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
    now = F.coalesce(version(df, order), F.lit(-2**63).cast("long"))
    return held.where(F.col("_known").isNull() | (now >= F.col("_known"))).select(*df.columns)


def changes(df: DataFrame, key: str, digest: Column, known: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rows that are new or not as known, all keys that are new, changed or gone); None when
    nothing changed.

    ``known`` has (_known, _digest) of all keys as indexed. Keys and digests alone are compared; the
    changed rows are read in whole afterwards. Null is a key like any other.
    """
    now = df.select(F.col(key).alias("_key"), digest.alias("_now"))
    same = F.col("_key").eqNullSafe(F.col("_known"))
    changed = now.join(known, same & F.col("_now").eqNullSafe(F.col("_digest")), "left_anti").select("_key")
    gone = known.join(now, same, "left_anti").select(F.col("_known").alias("_key"))
    found = stored(changed.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True))), "changed")
    if found.isEmpty():
        return None
    new = found.where("not _gone").select("_key")
    return df.join(new, F.col(key).eqNullSafe(F.col("_key")), "left_semi"), found.select("_key")
