"""Bring requests and rows together on lead entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.analysis import text_list
from trawl.session import stored

# A row may hold several leads of a request; the pair is taken at the first of them.
FIRST_LEAD = "lead = get(filter(leads, t -> array_contains(here, t)), 0)"


def pairs(requests, rows: DataFrame, key: str) -> DataFrame:
    """Rows joined with the requests that have a lead among the row's ``here`` array.

    ``requests`` has ``rows`` (query_id, leads array, ...), and ``leads``, the set of all leads,
    or None when there are too many requests to broadcast. Only leads are compared, so a row and
    a request that share frequent entries alone are never brought together.
    """
    by_lead = requests.rows.withColumn("lead", F.explode("leads"))
    if requests.small:
        leads = F.expr(f"explode(filter(here, t -> t in ({text_list(requests.leads)})))") \
            if requests.leads else F.expr("explode(cast(array() as array<string>))")
        return rows.withColumn("lead", leads).join(F.broadcast(by_lead), "lead").where(FIRST_LEAD)
    # Pair the keys alone first, each pair once, then bring both sides in. Rows hold requested
    # entries only; a frequent lead, or a row that many requests want, is split by Spark.
    rows = stored(rows, "rows")
    keys = rows.select(key, F.explode("here").alias("lead")).join(
        by_lead.select("lead", "query_id"), "lead").select(key, "query_id").distinct()
    return keys.join(rows, key).join(requests.rows, "query_id")
