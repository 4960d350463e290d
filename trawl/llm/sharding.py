"""Vector bin packing of rows into shards by bytes, tokens and rows at once.

Groups of equal texts stay together. Groups with a share of at least ``1 / UNITS`` of the bytes,
tokens or rows are packing units of their own (there are at most ``3 * UNITS`` such groups at any
size of the table); all smaller groups are dealt by hash into ``UNITS`` bundles. The driver places
these few units, largest first, on the shard whose residual capacity has the highest dot product
with the unit's demand. Rows are then numbered inside cells of a bounded number of rows.

A group that alone is larger than a fair shard cannot be kept whole without breaking the balance;
its rows are dealt into pieces, and only such a group's are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import n_words, text_or_empty
from trawl.session import stored

UNITS = 4096
CELL_ROWS = 2_000
DEMANDS = ["size", "tokens", "n"]
# How much a resource counts in the dot product: bytes are to be nearest to equal.
EMPHASIS = np.array([16.0, 1.0, 1.0])


def place(demands: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; ``demands`` has one row per unit and one column per resource.

    Units go in descending order of their first resource (ties: earlier row first). A unit goes
    where the dot product of its demand with the residual capacity, weighted by ``EMPHASIS``, is
    highest (ties: lower shard).
    Capacity is an equal part of each resource.
    """
    shares = demands / np.maximum(demands.sum(axis=0, keepdims=True), 1e-300)
    emphasis = EMPHASIS[:shares.shape[1]]
    residual = np.full((shards, shares.shape[1]), 1.0 / shards)
    out = np.zeros(len(shares), dtype=np.int64)
    for unit in np.lexsort((np.arange(len(shares)), -shares[:, 0])):
        at = int(np.argmax(residual @ (emphasis * shares[unit])))
        out[unit] = at
        residual[at] -= shares[unit]
    return out


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, size, text_crc32, tokens, shard, slot).

    ``size`` is the text's UTF-8 bytes plus 1, null text counts as empty. ``slot`` numbers the rows
    of a shard from 0 without gaps, ordered by packing unit, in cells of a bounded number of rows, and
    then by id (null ids first, equal ids in no stated order). Ids do not decide where rows go, so
    null and repeated ones keep the balance. Repeated rows are rows of their own, and long texts are
    measured where they are. Columns of other names are ignored; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        n_words(text).alias("tokens"), F.monotonically_increasing_id().alias("_row")), "shard-rows")
    group = ["_hash", "text_crc32", "size"]
    totals = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                      F.count("*").alias("n")).first()
    if not totals["n"]:
        return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", "tokens",
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    units = _with_units(rows, group, totals, shards)
    demands = units.groupBy("_unit", "_piece").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"),
    ).orderBy("_unit", "_piece").toPandas()
    demands["shard"] = place(demands[DEMANDS].to_numpy(dtype=np.float64), shards).astype("int32")
    demands["_salts"] = np.maximum(1, np.ceil(demands["n"] / CELL_ROWS)).astype("int32")
    placed = docs.sparkSession.createDataFrame(demands[["_unit", "_piece", "shard", "_salts"]])
    salt = F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int")
    cell = ["shard", "_unit", "_piece", "_salt"]
    dealt = units.join(F.broadcast(placed), ["_unit", "_piece"]).withColumn("_salt", salt)
    before = Window.partitionBy("shard").orderBy("_unit", "_piece", "_salt").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*cell).agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_id", "_row")) - 1
    return dealt.withColumn("_at", inside).join(starts.drop("_n"), cell).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "tokens", "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"))


def _with_units(rows: DataFrame, group: list[str], totals, shards: int) -> DataFrame:
    """Rows with their packing unit, and the piece of a group larger than a shard."""
    def share(of: str) -> Column:
        return F.col(f"_{of}") / F.lit(float(max(1, totals[of])))

    groups = rows.groupBy(*group).agg(F.sum("size").alias("_size"), F.sum("tokens").alias("_tokens"),
                                      F.count("*").alias("_n"))
    largest = F.greatest(*(share(of) for of in DEMANDS))
    large = groups.where(largest >= 1.0 / UNITS).select(*group, largest.alias("_share"))
    known = large.orderBy(*group).toPandas()
    known["_large"] = np.arange(UNITS, UNITS + len(known), dtype=np.int64)
    known["_pieces"] = [math.ceil(x * UNITS) if x > 1.0 / shards else 1 for x in known.pop("_share")]
    schema = "_hash long, text_crc32 long, size long, _large long, _pieces long"
    table = rows.sparkSession.createDataFrame(known, schema)
    unit = F.coalesce("_large", F.pmod("_hash", F.lit(UNITS)).cast("long"))
    piece = F.pmod(F.xxhash64("_row", F.lit(1)), F.coalesce("_pieces", F.lit(1).cast("long")))
    return rows.join(F.broadcast(table), group, "left").select(
        *rows.columns, unit.alias("_unit"), piece.alias("_piece"))
