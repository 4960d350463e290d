import pytest

import __spark_entry__ as entry
from check_oracle import compare

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(">>>" in r["headline"] or r["rank"] >= 0 for r in rows)


@pytest.mark.parametrize("name", entry._search_queries())
def test_query_equals_its_sql(spark, name):
    rows, same = compare(spark, SF, name)
    assert same is not False


def test_every_query_has_sql():
    assert set(entry._search_sql()) == set(entry._search_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
