"""Token ids in fixed-width bit-packed blocks, with numpy unpacking and random access.

A table of encoded texts is a folder of Parquet files, one row per block, in ascending id order:

    part, block      number of the id range, and of the block in it
    bits             bits per id: the fewest that hold the vocabulary
    n_ids            ids in the block
    doc_ids, counts  the block's documents and the ids of each, end id included
    payload          the ids, lowest bit first, padded to a whole byte

A document never spans blocks, and a block closes at ``BLOCK_IDS`` ids, so one longer text is a
block of its own. The i-th id starts at bit ``i * bits`` of the payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import bytewords
from trawl.llm.common import text_or_empty
from trawl.llm.memo import Memo
from trawl.session import work_folder

BLOCK_IDS = 1 << 18
# Words whose ids a Python worker keeps, over all its tasks; with more it starts again.
KNOWN_WORDS = 1 << 21
SCHEMA = "part int, block int, bits int, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


@dataclass(frozen=True)
class Encoding:
    """How texts become ids: a tokenizer file, the id that ends a document, the vocabulary's size."""

    tokenizer: str
    end_id: int
    vocabulary: int

    @property
    def bits(self) -> int:
        return max(1, (max(self.vocabulary, self.end_id + 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32 bits) in ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    every = (ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(every, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` up to ``stop`` of a payload; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-stop * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    skip = start * bits - low * 8
    every = raw[skip:skip + (stop - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (every << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class WordEncoder:
    """Ids of texts, encoding each distinct blank-free word only once.

    Right for tokenizers whose ids of a text are those of its words (parted at ASCII white space) one
    after another: white space is dropped and no rule, merge or special token reaches across it. Where
    it lower-cases texts, so do words here, but in batches in which a special token may stand.
    """

    def __init__(self, tokenizer: str) -> None:
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Memo(KNOWN_WORDS)

    def _of_words(self, found: bytewords.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of the words numbered ``at``."""
        data = found.data.tobytes()
        texts = [data[s:e].decode(errors="replace")
                 for s, e in zip(found.starts[at].tolist(), found.ends[at].tolist(), strict=True)]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return counts, np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(counts.sum()))

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, ids of these rows one after another with the end id, number of ids per row)."""
        raw, offsets = bytewords.buffers(texts)
        data = raw[offsets[0]:offsets[-1]].tobytes().lower() if self.lowers else b""
        lower = self.lowers and not any(token.lower() in data for token in self.special)
        for found in bytewords.words(texts, lower=lower):
            counts, ids = self.known.runs(found.hashes, lambda at, _, found=found: self._of_words(found, at))
            docs = len(found.counts)
            whole = np.concatenate([[0], np.cumsum(counts)])[found.bounds]
            out = np.empty(len(ids) + docs, dtype=np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(whole))] = ids
            out[whole[1:] + np.arange(docs)] = end_id
            yield found.rows, out, np.diff(whole) + 1


@lru_cache(maxsize=1)
def worker_encoder(tokenizer: str) -> WordEncoder:
    """The encoder that this Python worker's tasks share."""
    return WordEncoder(tokenizer)


def _blocks(batches: Iterator[pa.RecordBatch], encoding: Encoding) -> Iterator[pa.RecordBatch]:
    part, block = TaskContext.get().partitionId(), 0
    encoder, held, docs, counts, size = worker_encoder(encoding.tokenizer), [], [], [], 0

    def closed():
        ids = np.concatenate(held)
        return pa.RecordBatch.from_pylist([{
            "part": part, "block": block, "bits": encoding.bits, "n_ids": len(ids), "doc_ids": docs,
            "counts": counts, "payload": pack(ids, encoding.bits)}], schema=ARROW)

    for batch in batches:
        for rows, ids, n in encoder.encode(batch.column(1), encoding.end_id):
            ids_of = batch.column(0)[rows.start:rows.stop].to_pylist()
            at = np.concatenate([[0], np.cumsum(n)])
            for d, doc_id in enumerate(ids_of):
                if docs and size + int(n[d]) > BLOCK_IDS:
                    yield closed()
                    block, held, docs, counts, size = block + 1, [], [], [], 0
                held.append(ids[at[d]:at[d + 1]])
                docs.append(doc_id)
                counts.append(int(n[d]))
                size += int(n[d])
    if docs:
        yield closed()


ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
                   ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                   ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, encoding: Encoding, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encode all texts and write their blocks in ascending id order.

    Null texts count as empty and give the end id alone; null ids come first. Rows with the same
    id follow each other by a hash of the text, and may lie in several ranges. An empty table writes no
    block. Other columns are left out.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    # Bounds of ranges are sampled, so that no text is part of them; an id that many rows share is split.
    order = ["_id", "_hash", "_row"]
    keyed = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_text")
    ordered.mapInArrow(partial(_blocks, encoding=encoding), SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written blocks.

    ``start`` is the number of ids of all documents before. Blocks are counted per part first, so
    that only the parts (as many as tasks wrote) are summed up in one place.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    heads = blocks.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("_block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(
        F.broadcast(parts), "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("start"))
    read = blocks.mapInArrow(_documents, "doc_id long, part int, block int, offset long, n_tokens long, "
                                         "ids_crc32 long")
    return read.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.array(row["counts"], dtype=np.int64)
            ends = np.cumsum(counts)
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, counts, strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                 pa.array([row["block"]] * n, pa.int32()), pa.array(ends - counts), pa.array(counts),
                 pa.array(sums, pa.int64())],
                names=["doc_id", "part", "block", "offset", "n_tokens", "ids_crc32"])


def encoded(docs: DataFrame, encoding: Encoding, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts' ids to a new folder below the shared one and read the documents back."""
    path = work_folder(docs.sparkSession, "token-ids")
    write_ids(docs, path, encoding, id_col, text_col)
    return read_documents(docs.sparkSession, path)
