"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives each document's set of shingles as a count, a digest, band hashes
   and a signature that keeps the low bits of the minima. Equal sets are one class from here on.
2. Classes that share a band hash are candidates. A bucket's centre is its class with most company in
   all buckets, which in a family of copies is the text they come from. All classes that meet in the
   buckets of one centre form its list: a family's many buckets give few lists.
3. A list is decided inside a task, without making its pairs: the centre is compared with all others,
   then each class that is still outside the largest component, until every class outside it has
   been compared with all. The signatures' bit counts, corrected for chance collisions, leave out
   pairs far below the threshold; the rest is confirmed on full shingle sets.
4. A list too large for a task is dealt into blocks, each decided together with the list's ``HUBS``
   classes of most company. Then the classes that are still outside the list's largest component
   meet all its blocks.
5. Components follow from the confirmed links by star steps.

Bands follow the threshold t: as many of ``rows`` minima that a pair at the threshold shares none with
probability (1 - t^rows)^bands = ``MISS`` at most. The signature of such a pair is below the margin by
more than six standard deviations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm import bytewords
from trawl.llm.batches import sorted_groups
from trawl.llm.common import maybe_wanted
from trawl.llm.components import components
from trawl.session import stored

MISS = 4.4e-7
MOST_MINIMA = 128   # and more only where bands of one minimum need them
MOST_ROWS = 5
BITS = 2
LANES = 32  # of two bits in a long
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1 << 20  # of a list that one task decides
HUBS = 64


@dataclass(frozen=True)
class Shape:
    """Number of bands and of minima in a band."""

    bands: int
    rows: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def signature(self) -> list[str]:
        """Names of the longs that hold the low bits of all minima."""
        return [f"s{i}" for i in range(-(-self.minima // LANES))]

    def margin(self, threshold: float) -> float:
        """How far below the threshold the estimate from a signature may lie: six standard deviations."""
        chance = 1 / 2**BITS
        same = threshold + (1 - threshold) * chance
        return 6 * math.sqrt(same * (1 - same) / self.minima) / (1 - chance)


def shape_for(percent: int) -> Shape:
    """The shape with the most minima in a band that misses a pair at the threshold with ``MISS`` at most."""
    threshold = percent / 100
    for rows in range(MOST_ROWS, 0, -1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))
        if bands * rows <= MOST_MINIMA or rows == 1:
            return Shape(bands, rows)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1,
            rng.integers(0, 2**32, n, dtype=np.uint32))


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n uint32 minima, one row per non-empty document and one column per permutation."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), n), dtype=np.uint32)
    if len(starts):
        for i, (a, b) in enumerate(zip(*_permutations(n), strict=True)):
            out[:, i] = np.minimum.reduceat(x * a + b, starts)
    return out


def band_hashes(mins: np.ndarray, shape: Shape) -> np.ndarray:
    """int64 hash of each band's minima, different for each band."""
    out = np.empty((len(mins), shape.bands), dtype=np.uint64)
    for band in range(shape.bands):
        h = np.full(len(mins), band + 1, dtype=np.uint64)
        for i in range(shape.rows):
            h = bytewords.mixed(h * np.uint64(0x9E3779B97F4A7C55) + mins[:, band * shape.rows + i])
        out[:, band] = h
    return out.view(np.int64)


def packed(mins: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, 32 to an int64."""
    width = -(-mins.shape[1] // LANES)
    lanes = np.zeros((len(mins), width * LANES), dtype=np.uint64)
    lanes[:, :mins.shape[1]] = mins & np.uint32(3)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    words = lanes.reshape(len(mins), width, LANES) << shifts
    return np.bitwise_or.reduce(words, axis=2).view(np.int64)


def document_sets(texts: pa.Array, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingle hashes of these documents one after another, bounds)."""
    for found in bytewords.words(texts):
        hashes, bounds = bytewords.shingles(found, width)
        sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum([len(s) for s in sets], out=sizes[1:])
        yield found.rows, np.concatenate(sets) if sets else hashes, sizes


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _profile(batches: Iterator[pa.RecordBatch], width: int, shape: Shape) -> Iterator[pa.RecordBatch]:
    names = shape.signature
    for batch in batches:
        for rows, hashes, bounds in document_sets(batch.column(1), width):
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            mins = minima(hashes, bounds, shape.minima)
            digests = [_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            signature = np.zeros((len(counts), len(names)), dtype=np.int64)
            signature[full] = packed(mins)
            places = np.zeros(len(counts) + 1, dtype=np.int32)
            np.cumsum(np.where(counts > 0, shape.bands, 0), out=places[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows.start:rows.stop], pa.array(counts),
                 pa.array(np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64)),
                 pa.ListArray.from_arrays(pa.array(places), pa.array(band_hashes(mins, shape).ravel())),
                 *(pa.array(signature[:, i]) for i in range(len(names)))],
                names=["_id", "n_shingles", "node", "bands", *names])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, hashes, bounds in document_sets(batch.column(1), width):
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            nodes = np.frombuffer(b"".join(_digest(s)[:8] for s in sets), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())],
                                             names=["node", "shingles"])


class _List:
    """Classes of one list, or of blocks of it, and the components found among them so far."""

    def __init__(self, rows: pa.Table, shape: Shape) -> None:
        self.shape = shape
        self.node = rows.column("node").to_numpy()
        self.size = rows.column("n_shingles").to_numpy()
        self.signature = np.stack([rows.column(s).to_numpy() for s in shape.signature], axis=1).view(np.uint64)
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column("shingles")]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.ids, self.marks = ids, np.zeros(int(ids.max()) + 1, dtype=bool)
        self.root = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        self.asked = np.zeros(len(self.node), dtype=bool)

    def likeness(self, x: int) -> np.ndarray:
        """Estimated Jaccard similarity to every class: equal lanes, less those equal by chance."""
        bits = self.signature ^ self.signature[x]
        lanes = (bits | bits >> np.uint64(1)) & np.uint64(0x5555555555555555)
        same, chance = 1 - np.bitwise_count(lanes).sum(axis=1) / self.shape.minima, 1 / 2**BITS
        return (same - chance) / (1 - chance)

    def ask(self, x: int, percent: int) -> list[int]:
        """Compare a class with all in other components; returns one linked class of each of these."""
        self.asked[x] = True
        n, size = self.size[x], self.size
        fits = (self.root != self.root[x]) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
        if not fits.any():
            return []
        others = np.flatnonzero(fits & (self.likeness(x) >= percent / 100 - self.shape.margin(percent / 100)))
        own = self.ids[self.starts[x]:self.starts[x + 1]]
        self.marks[own] = True
        common = np.array([np.count_nonzero(self.marks[self.ids[self.starts[y]:self.starts[y + 1]]])
                           for y in others], dtype=np.int64)
        self.marks[own] = False
        linked = others[100 * common >= percent * (n + size[others] - common)]
        roots, first = np.unique(self.root[linked], return_index=True)
        self.root[np.isin(self.root, roots)] = self.root[x]
        return linked[first].tolist()

    def links(self, percent: int, asking: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that join all components which a link joins and an ``asking`` class belongs to.

        Where all classes ask, those of the largest component need not: any other asks them.
        """
        waiting = np.flatnonzero(asking)[:1] if asking.all() else np.flatnonzero(asking)
        while len(waiting):
            for x in waiting:
                if not (self.asked.any() and asking.all() and self.root[x] == self._largest()):
                    yield from ((int(self.node[x]), int(self.node[y])) for y in self.ask(int(x), percent))
            waiting = np.flatnonzero(~self.asked & (self.root != self._largest())) if asking.all() else []

    def _largest(self) -> int:
        return int(np.bincount(self.root).argmax())


def _decided(batches: Iterator[pa.RecordBatch], percent: int, shape: Shape) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found within each list; rows come sorted by list, its classes by ``place``."""
    for _, rows in sorted_groups(batches, 3):
        if rows.num_rows > 1:
            found = _List(rows, shape)
            links = list(found.links(percent, rows.column("asking").to_numpy(zero_copy_only=False)))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["a", "b"])


def near_duplicates(docs: DataFrame, percent: int, width: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept).

    Documents are linked when 100 * intersection >= percent * union of their distinct ``width``-word
    shingles; a shorter text is one shingle of all its words. Null, empty and blank texts have no
    shingles and are linked with nothing. ``component_id`` is the smallest id reachable, ``kept``
    marks its row (of rows with equal ids and texts, all). Rows without an id are never the smallest
    and never kept. Whole texts are cut into shingles, however long. Of classes with equal company the
    one with the larger hash is a bucket's centre, which changes no result. Other columns are ignored,
    whatever their names. An empty table gives an empty result. Equal sets are known by 64 bits of
    their digest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    shape = shape_for(percent)
    signature = shape.signature
    fields = "_id long, n_shingles long, node long, bands array<long>, " + ", ".join(f"{s} long" for s in signature)
    profile = stored(rows.mapInArrow(partial(_profile, width=width, shape=shape), fields), "minhash-profiles")
    classes = profile.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.col("_id")).alias("least"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in signature))
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    entries = stored(entries.join(shared, "bucket"), "minhash-buckets")
    company = entries.groupBy("node").agg(F.sum("n").alias("company"))
    known = stored(classes.join(company, "node").select("node", "least", "company", "n_shingles", *signature),
                   "minhash-classes")
    lists = stored(_lists(entries, known), "minhash-lists")
    sets = stored(_whole_sets(rows, known, width), "minhash-sets")
    links = stored(_links(_blocks(lists), known, sets, percent, shape), "minhash-links")
    roots = stored(components(links), "minhash-roots")
    if not lists.where("blocks > 1").isEmpty():
        more = _links(_outsiders(lists, roots), known, sets, percent, shape)
        links = stored(roots.toDF("a", "b").union(more), "minhash-links")
        roots = stored(components(links), "minhash-roots")
    # By classes: a class of very many copies is one row here.
    tagged = profile.where("n_shingles > 0").groupBy("node").agg(F.min("_id").alias("least")).join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    found = tagged.join(smallest, "root").select("node", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return profile.select("_id", "n_shingles", "node").join(found, "node", "left").withColumn(
        "component_id", own).select(
        F.col("_id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _whole_sets(rows: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full set of one document of each class that has a candidate."""
    wanted = known.select(F.col("least").alias("_least")).distinct()
    some = maybe_wanted(rows, F.col("_id"), wanted).where("_maybe")
    one = some.join(wanted, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    found = one.select("_id", "_text").mapInArrow(partial(_sets, width=width), "node long, shingles binary")
    return found.join(known.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _lists(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(centre, node, company, blocks): who meets in the buckets of each centre."""
    met = entries.join(known.select("node", "company"), "node")
    centres = met.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("c"))
    listed = met.join(centres, "bucket").select(F.col("c.node").alias("centre"), "node", "company").distinct()
    sizes = listed.join(known.select("node", "n_shingles"), "node").groupBy("centre").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast(
            "int").alias("blocks"))
    return listed.join(sizes, "centre")


def _blocks(lists: DataFrame) -> DataFrame:
    """Every list in blocks, the hubs of a list with more than one in all of them."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    whole = lists.select("centre", block.alias("x"), F.lit(0).alias("y"), "node", "company")
    large = lists.where("blocks > 1")
    # Hubs are cut per hash share first, so that no task sorts a whole list.
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    first = Window.partitionBy("centre", share).orderBy(F.desc("company"), "node")
    then = Window.partitionBy("centre").orderBy(F.desc("company"), "node")
    hubs = large.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= HUBS).withColumn(
        "_at", F.row_number().over(then)).where(F.col("_at") <= HUBS)
    hubs = hubs.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "centre", "x", F.lit(0).alias("y"), "node", "company")
    return whole.union(hubs).distinct().select(
        "*", F.col("node").alias("root"), F.lit(True).alias("asking"))


def _outsiders(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes outside the largest component of a list with many blocks, with each of its blocks."""
    tagged = lists.where("blocks > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = tagged.groupBy("centre", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("centre").agg(F.max(F.struct("n", "root")).alias("m"))
    tagged = tagged.join(largest.select("centre", F.col("m.root").alias("main")), "centre")
    out = tagged.where("root <> main")
    shares = out.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("node", F.lit(2)), F.col("shares")).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    every_share = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    columns = ["centre", "x", "y", "node", "company", "root", "asking"]
    asking = out.join(shares, "centre").withColumn("x", share).withColumn("y", every_block).withColumn(
        "asking", F.lit(True)).select(*columns)
    asked = tagged.join(shares, "centre").withColumn("y", block).withColumn("x", every_share).withColumn(
        "asking", F.lit(False)).select(*columns)
    return asking.union(asked).groupBy("centre", "x", "y", "node", "company", "root").agg(
        F.max("asking").alias("asking"))


def _links(dealt: DataFrame, known: DataFrame, sets: DataFrame, percent: int, shape: Shape) -> DataFrame:
    """Links found in the lists' parts (centre, x, y), each decided in one task."""
    signature = shape.signature
    whole = dealt.join(known.select("node", "n_shingles", *signature), "node").join(sets, "node")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = whole.select("centre", "x", "y", "node", "company", "root", "asking", "n_shingles", *signature,
                         "shingles").repartition(parts, "centre", "x", "y")
    whole = whole.sortWithinPartitions("centre", "x", "y", F.desc("company"), "node")
    return whole.mapInArrow(partial(_decided, percent=percent, shape=shape), "a long, b long")
