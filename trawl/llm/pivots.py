"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by the ordered list of its ``PREFIX`` nearest of ``m`` pivots. A pivot's inverted
list has the vectors that count it among their ``NEAREST`` first. A list of more than ``LARGE`` vectors is
also kept per second shared pivot, over whole prefixes, so that pairs with a pivot beyond the nearest meet as
well. All lists meet whole, however large: blocks bound the memory, and the work of a list grows with its
square. Each pair is decided once, in the first list that both are in, by its cosine in double precision.

Pivots are chosen, far apart, from a sample of ``SAMPLE`` vectors at most; every vector is indexed.
``m`` grows with the square root of the number of vectors and is at most ``MOST_PIVOTS``, so the
table of pivots that all tasks get is bounded. Lists are cut into blocks of about ``BLOCK`` members
and blocks meet pairwise. A meeting reports the number of links of each member and a spanning
forest, so its output grows with its members and not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.batches import sorted_groups
from trawl.llm.common import first_by_hash
from trawl.llm.components import components
from trawl.session import stored

SAMPLE = 8192
MOST_PIVOTS = 4096
PREFIX, NEAREST = 12, 8
LARGE = 16_384
BLOCK = 2048
PAIR_KEY = 20   # bits of the second pivot in the key of a list of two


def flat_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows are usable, the usable rows' components one after another, their lengths).

    A vector that is null, empty or zero, or holds null or non-finite components, is not usable.
    """
    fit = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    values = vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    known = np.isfinite(flat)
    if values.null_count:
        known &= values.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    fit &= (lengths > 0) & (np.bincount(row, weights=~known, minlength=len(lengths)) == 0)
    fit &= np.bincount(row, weights=flat != 0, minlength=len(lengths)) > 0
    return fit, flat[fit[row]], lengths[fit]


def units(flat: np.ndarray, lengths: np.ndarray, width: int | None = None) -> np.ndarray:
    """Unit vectors as rows, padded with zeros."""
    width = max(int(lengths.max(initial=1)), width or 1)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 5e-324)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 5e-324)


def far_apart(vectors: np.ndarray, m: int) -> np.ndarray:
    """Up to m rows, each the one least like those before it."""
    if not len(vectors):
        return vectors
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(m, len(vectors)):
        at = int(np.argmin(nearest))
        if nearest[at] >= 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, vectors @ vectors[at])
    return vectors[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    width = max(vectors.shape[1], pivots.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, pivots))
    like = a @ b.T
    n = min(PREFIX, len(pivots))
    top = np.argpartition(-like, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(like, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _digests(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, 64 bits of a digest, components as bytes) of each row; null where it is not usable."""
    for batch in batches:
        fit, flat, lengths = flat_rows(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw, sent = np.ascontiguousarray(flat), flat.astype(kind)
        nodes: list[int | None] = [None] * len(fit)
        parts: list[bytes | None] = [None] * len(fit)
        for k, i in enumerate(np.flatnonzero(fit).tolist()):
            a, b = ends[k], ends[k + 1]
            nodes[i] = int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
            parts[i] = sent[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(parts, pa.binary())],
                                         names=["_id", "node", "vector"])


def read_vectors(vectors: pa.Array, kind: str, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths) of components kept as bytes."""
    lengths = pc.binary_length(vectors).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = np.frombuffer(vectors.buffers()[1], dtype=np.int32)[vectors.offset:vectors.offset + len(vectors) + 1]
    data = vectors.buffers()[2]
    flat = np.frombuffer(data[int(offsets[0]):int(offsets[-1])] if data else b"", dtype=kind)
    return units(flat.astype(np.float64), lengths, width), lengths


def _described(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = nearest_pivots(read_vectors(batch.column(2), kind)[0], pivots)
        places = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(places), pa.array(near.ravel()))],
            names=["node", "copies", "vector", "pivots"])


MET = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _meetings(batches: Iterator[pa.RecordBatch], least: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Per meeting and linked member: its number of links there and the smallest member it reaches."""
    for (key, x, y), rows in sorted_groups(batches, 3):
        if rows.num_rows < 2:
            continue
        node = rows.column("node").to_numpy()
        copies, block = rows.column("copies").to_numpy(), rows.column("block").to_numpy()
        vectors, size = read_vectors(rows.column("vector"), kind)
        keys = rows.column("keys").combine_chunks()
        for width in np.unique(size):  # vectors of other lengths are never linked
            of = np.flatnonzero(size == width)
            left, right = (of, of) if x == y else (of[block[of] == x], of[block[of] == y])
            if len(left) and len(right):
                i, j = np.nonzero(vectors[left, :width] @ vectors[right, :width].T >= least)
                i, j = left[i], right[j]
                if x == y:
                    i, j = i[i < j], j[i < j]
                own = _decided_here(keys, i, j, key)
                i, j = i[own], j[own]
                if len(i):
                    yield _met(node, copies, i, j)


def _decided_here(keys: pa.ListArray, i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Which pairs have no list in common before this one; a member's lists are in order."""
    values, bounds = keys.flatten().to_numpy(), keys.offsets.to_numpy() - keys.offsets[0].as_py()
    before = np.array([np.searchsorted(values[a:b], key) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    width = max(1, int(before.max(initial=0)))
    earlier = np.full((len(before), width), -1, dtype=np.int64)
    earlier[np.arange(width) < before[:, None]] = np.concatenate(
        [values[a:a + n] for a, n in zip(bounds[:-1], before, strict=True)] or [values[:0]])
    out = np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 22) // width**2)
    for a in range(0, len(i), step):
        p, q = earlier[i[a:a + step]], earlier[j[a:a + step]]
        out[a:a + len(p)] = ~((p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def _met(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    counts = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(
        j, weights=copies[i], minlength=len(node))
    root = node.copy()
    while True:  # the smallest member passes along the links until nothing changes
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    linked = counts > 0
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(counts[linked].astype(np.int64)),
                                       pa.array(root[linked])], schema=MET)


def near_vectors(vectors: DataFrame, least: float, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept).

    Vectors are linked when their cosine is at least ``least``. ``n_links`` counts the other rows
    linked directly, equal vectors included; ``component_id`` is the smallest id reachable, itself
    included, and ``kept`` marks the row that has it. Vectors that are null, empty or zero or hold
    null or non-finite components are linked with nothing, and so are vectors of different
    lengths. Rows with equal ids are rows of their own; a null id is never the smallest and never
    kept. Of equally near pivots the one with the lower number comes first. Other columns are ignored,
    whatever their names. An empty table gives an empty result. Equal vectors are known by 64 bits of a
    digest.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("vector"))
    kind = "<f4" if given.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"
    rows = stored(given.mapInArrow(partial(_digests, kind=kind), "_id long, node long, vector binary"), "vector-rows")
    classes = stored(rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.first("vector").alias("vector")), "vector-classes")
    n = classes.count()
    sample = first_by_hash(classes, "node", n, SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    pivots = far_apart(read_vectors(sample, kind)[0], min(MOST_PIVOTS, max(64, int(2 * n**0.5)))) if n else []
    found = spark.createDataFrame([], "node long, n long, root long")
    if n:
        found = stored(_links(classes, np.vstack([pivots, -pivots]) if len(pivots) < 2 else pivots, least, kind),
                       "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    tagged = rows.select("_id", "node").join(classes.select("node", "copies"), "node", "left").join(
        counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tagged = stored(tagged, "vector-tagged")
    smallest = tagged.where("node is not null").groupBy("root").agg(F.min("_id").alias("least"))
    return tagged.join(smallest, "root", "left").select(
        F.col("_id").alias(id_col),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("least", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("least", "_id"), F.lit(False)).alias("kept"))


def _list_keys(large: list[int]) -> str:
    """SQL for its nearest pivots without a large list, and the pairs of pivots with one, in order."""
    one = f"slice(pivots, 1, {NEAREST})"
    if not large:
        return f"sort_array(transform({one}, p -> cast(p as long)))"
    hot = f"array({', '.join(map(str, large))})"
    single = f"transform(filter({one}, p -> not array_contains({hot}, p)), p -> cast(p as long))"
    pair = f"(shiftleft(cast(p + 1 as long), {PAIR_KEY}) + q)"
    pairs = f"""flatten(transform(pivots, p -> transform(filter(pivots, q -> q > p and (
        array_contains({hot}, p) or array_contains({hot}, q))), q -> {pair})))"""
    return f"sort_array(concat({single}, {pairs}))"


def _all_keys(large: list[int]) -> str:
    """SQL for all lists of a vector, in order: the large lists themselves come before the pairs with them."""
    if not large:
        return _list_keys(large)
    whole = f"filter(slice(pivots, 1, {NEAREST}), p -> array_contains(array({', '.join(map(str, large))}), p))"
    return f"sort_array(concat(transform({whole}, p -> cast(p as long)), {_list_keys(large)}))"


def _links(classes: DataFrame, pivots: np.ndarray, least: float, kind: str) -> DataFrame:
    """(node, n, root) for each meeting in which a class of equal vectors has links."""
    described = stored(classes.mapInArrow(partial(_described, pivots=pivots, kind=kind),
                                          "node long, copies long, vector binary, pivots array<int>"), "vector-described")
    sizes = described.select(F.explode(F.slice("pivots", 1, NEAREST)).alias("p")).groupBy("p").count()
    large = sorted(r["p"] for r in sizes.where(F.col("count") > LARGE).collect())
    described = described.withColumn("keys", F.expr(_all_keys(large)))
    entries = described.select("node", F.explode("keys").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = entries.join(lists, "key").withColumn("block", block).withColumn("_other", other).select(
        "key", F.least("block", "_other").cast("long").alias("x"), F.greatest("block", "_other").cast("long").alias("y"),
        "node", "block").join(described, "node")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = ["key", "x", "y"]
    met = met.select(*meeting, "block", "node", "copies", "keys", "vector").repartition(
        parts, *meeting).sortWithinPartitions(*meeting)
    return met.mapInArrow(partial(_meetings, least=least, kind=kind), "node long, n long, root long")
