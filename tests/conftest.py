import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def no_broadcast(monkeypatch):
    """Treat every request set as too large to collect or broadcast."""
    monkeypatch.setattr("trawl.session.SMALL_BYTES", 0)


def by_query(rows, value):
    found = {}
    for row in rows:
        found.setdefault(row["query_id"], []).append(row[value])
    return {q: sorted(ids, key=lambda v: (v is not None, v)) for q, ids in found.items()}
