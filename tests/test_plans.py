"""Plan display and dealing out rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from trawl.operators import match
from trawl.plans.display import plan_scans
from trawl.session import key_ranges, spread
from trawl.sources import tables


def test_scans_show_pruned_folders_and_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 5 as part", "id % 7 as x").write.partitionBy("part").parquet(path)
    found = spark.read.schema("id long, x long, part int").parquet(path).where("part = 3 and x = 2").select("id")
    rows = plan_scans(found).collect()
    assert len(rows) == 1
    assert "part" in rows[0].partition_filters and "EqualTo(x,2)" in rows[0].pushed_filters
    assert rows[0].read_columns == "struct<id:bigint,x:bigint>" and path in rows[0].location
    assert plan_scans(spark.range(3)).isEmpty()


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4000).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:  # several splits of bytes, but only one of them has the row group
        dealt = spread(spark.read.parquet(path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 1500
    many = spark.range(0, 100, numPartitions=17)
    assert spread(many) is many


def test_key_ranges_hold_all_keys_and_part_at_the_widest_gaps():
    keys = pa.array([900, 5, 6, 7, None, 100, 101, 5])
    assert key_ranges(keys, 3) == [(5, 7), (100, 101), (900, 900)]
    assert key_ranges(keys, 1) == [(5, 900)] and key_ranges(pa.array([], pa.int64())) == []
    assert key_ranges(pa.array(["b", "a", "d", "c"]), 2) == [("a", "b"), ("c", "d")]
    assert key_ranges(pa.array([-2**63, 2**63 - 1]), 5) == [(-2**63, -2**63), (2**63 - 1, 2**63 - 1)]


def test_matched_rows_are_read_from_the_row_groups_that_hold_them(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id) as text").unionByName(
        spark.sql("select cast(null as bigint) as id, 'none' as text"))
    tables.cluster_table(rows.repartition(7), path, "id")
    held = tables.read_table(spark, path, rows.schema)
    matched = spark.createDataFrame([(1, 17), (2, 17), (1, 19_990), (1, None)], "query_id long, doc_id long")
    found = match.matching_rows(held, "id", matched)
    pushed = plan_scans(found).where("location like '%/t]'").first().pushed_filters
    assert "GreaterThanOrEqual(id,17)" in pushed and "LessThanOrEqual(id,17)" in pushed and "IsNull(id)" in pushed
    assert sorted(map(str, (r.id for r in found.collect()))) == ["17", "19990", "None"]
    assert match.matching_rows(held, "id", matched.where("query_id > 5")).count() == 0
