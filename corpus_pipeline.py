"""The corpus pipeline: documents in, mixed and encoded training text out.

1. quality: documents that the classifier, learnt from ``labels``, scores below 0.3 go.
2. near_duplicates: one document stays of each group linked at 0.8 on five-word shingles, that with
   the smallest id. Rows with equal ids and texts count as one; rows without an id all stay.
3. mixing: sources are mixed by temperature so that no source is repeated more than twice and every
   document is used; rows come in the mixture's order, and a repeated document is repeated rows.
4. pieces: merge-dropout piece ids of each text.

Null and empty texts pass through all stages as empty texts; an empty table gives an empty result. Texts
are read in whole, however long, and repeated rows without an id are rows of their own. Of documents in
a group the smallest id stays; rows of the mixture with equal places come in no stated order. Other
columns of ``documents`` are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import minhash, mixing, pieces, quality
from trawl.llm.common import maybe_wanted, prepare, quoted, table
from trawl.llm.queries import LEAST_QUALITY, MOST_REPEATS, PIECES_MODEL
from trawl.session import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, forest).where(F.col("quality_score") >= LEAST_QUALITY).select(*quoted(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = minhash.near_duplicates(docs, percent=80, width=5).select(F.col("doc_id").alias("_id"), "kept")
    ids = found.where("_id is not null").groupBy("_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    dropped = ids.where("not kept").select("_id")
    # Few rows are dropped; only they, and rows that look like them, move to meet the list.
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("_row"), F.col("doc_id").alias("_id"))
    marked = maybe_wanted(rows, F.col("_id"), dropped)
    left = marked.where("not _maybe").select("_id", "_row").unionByName(
        marked.where("_maybe").join(dropped, "_id", "left_anti").select("_id", "_row"))
    if not ids.where("n > 1").isEmpty():
        once = left.where("_id is not null").withColumn("_text", F.col("_row.text")).dropDuplicates(["_id", "_text"])
        left = once.drop("_text").unionByName(left.where("_id is null"))
    return left.select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.mix(docs, most_repeats=MOST_REPEATS).rows
    return rows.repartitionByRange("mix_place").sortWithinPartitions("mix_place").select(*quoted(docs.columns))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = pieces.encode(docs, PIECES_MODEL, keep=["doc_id", "source"])
    return found.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("mixing", mix_sources),
          ("pieces", to_pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each one's rows written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
