"""The inverted index over JSON paths, which serves containment and key requests alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.analysis import let, text_list
from trawl.functions.jsonpaths import entries
from trawl.session import local_table
from trawl.sources import buckets

BUCKET = "path_bucket"
ENTRY = ["path", "vtype", "value"]
# Type of the entry that stands for the row itself; its value is a hash of the row.
ROW = "row"
REGISTRY = f"path = '' and vtype = '{ROW}'"


@dataclass(frozen=True)
class PathIndex:
    path: str
    key: str
    column: str
    buckets: int = 64
    key_type: str = "bigint"
    key_buckets: int = 4

    @property
    def layout(self) -> buckets.Layout:
        schema = T.StructType.fromDDL("path string, vtype string, value string, ats array<array<int>>, "
                                      f"row_id {self.key_type}, version bigint")
        return buckets.Layout(self.path, schema, BUCKET, self.buckets, self.key_buckets, "row_id", tuple(ENTRY),
                              REGISTRY)


def _digest(column: str) -> str:
    return f"coalesce(cast(xxhash64(to_json(`{column}`)) as string), '')"


def path_entries(df: DataFrame, key: str, column: str, with_rows: bool = False,
                 version: str | None = None) -> DataFrame:
    """(path, vtype, value, ats, row_id): each entry once per row; ``with_rows`` adds the entry that
    stands for the row itself, and ``version`` a column with the row's version in that entry.

    ``ats`` are the positions of the array elements around each occurrence. An entry occurs several
    times in arrays only; a row's entries are together, so those are grouped there, by sorting, and
    nothing is exchanged. Paths show arrays, so entries outside them have no equal and are left as they are.
    """
    found = entries(f"`{column}`")
    if with_rows:
        row = f"named_struct('path', '', 'vtype', '{ROW}', 'value', {_digest(column)}, 'at', cast(array() as array<int>))"
        found = f"array_append({found}, {row})"
    starts = """filter(sequence(0, size(es) - 1), i -> i = 0 or es[i].path <> es[greatest(i - 1, 0)].path
        or es[i].vtype <> es[greatest(i - 1, 0)].vtype or es[i].value <> es[greatest(i - 1, 0)].value)"""
    runs = let("firsts", starts, """transform(firsts, (first, k) -> named_struct('path', es[first].path,
        'vtype', es[first].vtype, 'value', es[first].value, 'ats', array_distinct(transform(
            slice(es, first + 1, coalesce(get(firsts, k + 1), size(es)) - first), e -> e.at))))""")
    once = """transform(filter(found, e -> size(e.at) = 0), e ->
        named_struct('path', e.path, 'vtype', e.vtype, 'value', e.value, 'ats', array(e.at)))"""
    several = let("es", "sort_array(filter(found, e -> size(e.at) > 0))", f"""if(size(es) > 0, {runs},
        cast(array() as array<struct<path:string,vtype:string,value:string,ats:array<array<int>>>>))""")
    grouped = let("found", found, f"concat({once}, {several})")
    if version is None:
        return df.selectExpr(f"`{key}` as row_id", f"inline({grouped})").select(*ENTRY, "ats", "row_id")
    return df.selectExpr(f"`{key}` as row_id", f"`{version}` as _version", f"inline({grouped})").selectExpr(
        *ENTRY, "ats", "row_id", f"if({REGISTRY}, _version, null) as version")


def _rows(df: DataFrame, index: PathIndex, order: str | None) -> DataFrame:
    given = df.withColumn("_version", buckets.version(df, order))
    return path_entries(given, index.key, index.column, with_rows=True, version="_version")


def build_path_index(df: DataFrame, index: PathIndex, order: str | None = None) -> None:
    """Index all rows of a table, unless the index is already there. Of rows with the same key the
    last one by the column ``order`` counts; without one, such rows are refused."""
    if not buckets.is_built(df.sparkSession, index.layout):
        buckets.build_once(_rows(buckets.one_per_key(df, index.key, order), index, order), index.layout)


def refresh_path_index(changed: DataFrame, index: PathIndex, order: str | None = None) -> None:
    """Index new and changed rows; repeating it is harmless.

    Without ``order`` what comes later replaces what came before. With it, a row that is older than
    the indexed one of its key is left out, and of equally old ones the later one counts.
    """
    spark, at = changed.sparkSession, index.layout
    buckets.finish(spark, at)
    if not buckets.is_built(spark, at):
        build_path_index(changed, index, order)
        return
    new = buckets.not_older(buckets.one_per_key(changed, index.key, order), index.key, order, at)
    buckets.replace(_rows(new, index, order), new.select(F.col(index.key).alias("_key")), at)


def sync_path_index(df: DataFrame, index: PathIndex, order: str | None = None) -> bool:
    """Bring an index up to date with its table: index the rows that are new or whose value is
    not what was indexed, and take out those that are gone. Returns whether anything was written."""
    spark, at = df.sparkSession, index.layout
    buckets.finish(spark, at)
    if not buckets.is_built(spark, at):
        build_path_index(df, index, order)
        return True
    df = buckets.one_per_key(df, index.key, order)
    known = read_entries(spark, index, REGISTRY).select(
        F.col("row_id").alias("_known"), F.col("value").alias("_digest"))
    found = buckets.changes(df, index.key, F.expr(_digest(index.column)), known)
    if found is None:
        return False
    changed, keys = found
    buckets.replace(_rows(changed, index, order), keys, at)
    return True


def _entries(spark: SparkSession, index: PathIndex, wanted) -> str:
    """SQL for exactly the given entries. Their buckets, paths, types and values one by one are
    what the scan can use; the entry as one string decides."""
    if not wanted:
        return "false"
    columns = dict(zip(ENTRY, map(list, zip(*wanted))))
    found = local_table(spark, **columns).select(
        F.expr(buckets.bucket_of(ENTRY, index.buckets)).alias("b")).distinct().collect()
    tests = [f"{BUCKET} in ({', '.join(str(r['b']) for r in found)})"]
    tests += [f"{name} in ({text_list(sorted(set(values)))})" for name, values in columns.items()]
    return " and ".join(tests) + f" and {ENTRY_TEXT} in ({text_list(' '.join(e) for e in wanted)})"


ENTRY_TEXT = "concat(path, ' ', vtype, ' ', value)"


def read_entries(spark: SparkSession, index: PathIndex, wanted: str | None = None) -> DataFrame:
    """(path, vtype, value, row_id) of all rows as they are now."""
    return buckets.read_rows(spark, index.layout, wanted).select(*ENTRY, "row_id")


def entry_counts(spark: SparkSession, index: PathIndex, wanted) -> tuple[dict[tuple, int], int]:
    """(number of rows of each entry, the most bytes of a key)."""
    return buckets.frequencies(spark, index.layout, _entries(spark, index, wanted))


def find_entries(spark: SparkSession, index: PathIndex, wanted, leads, item: str, narrow=None) -> DataFrame:
    """(row_id, items) of the given entries, or of all entries when ``wanted`` is None, each as ``item``
    (SQL over an entry); with ``leads``, which have to be few, only of rows that have one of them."""
    keep = None if wanted is None else _entries(spark, index, wanted)
    leading = None if leads is None else _entries(spark, index, leads)
    return buckets.gather(spark, index.layout, keep, item, leading, narrow)


def compact_path_index(spark: SparkSession, index: PathIndex, target: PathIndex) -> None:
    """Write the rows of an index as the full build of a new one, which may have other buckets."""
    buckets.build_once(buckets.read_rows(spark, index.layout), target.layout)
