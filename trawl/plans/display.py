"""What a query's plan reads, as rows: the checkable part of Spark's plan display."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

SCANS = "scan int, location string, partition_filters string, pushed_filters string, read_columns string"
FACTS = {"location": "Location", "partition_filters": "PartitionFilters", "pushed_filters": "PushedFilters",
         "read_columns": "ReadSchema"}


def plan_text(df: DataFrame) -> str:
    """The plan as ``explain("formatted")`` prints it."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def plan_scans(df: DataFrame) -> DataFrame:
    """One row per file scan of a query's plan: where it reads, the filters that prune folders, those
    that are pushed into the files, and the columns that are read. Nothing is run."""
    rows = []
    for part in re.split(r"\n\n+", plan_text(df)):
        head = re.match(r"\((\d+)\) Scan parquet", part)
        if head:
            found = {name: re.search(rf"^{label}: (.*)$", part, re.M) for name, label in FACTS.items()}
            rows.append((int(head[1]), *(m[1] if m else "" for m in found.values())))
    return df.sparkSession.createDataFrame(rows, SCANS)
