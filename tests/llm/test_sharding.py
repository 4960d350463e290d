import zlib

import numpy as np
import pytest

from trawl.llm import sharding

SCHEMA = "doc_id long, text string, size int, shard string, _unit int, n int"


def rows(n=900):
    rng = np.random.default_rng(6)
    texts = [" ".join(["word"] * int(k)) for k in rng.integers(0, 40, n)]
    texts += ["the same é text"] * 60 + [None, "", None, "long " * 20_000]
    return [(i, t, 1, "s", 2, 3) for i, t in enumerate(texts)]


def checked(found, given, shards):
    assert len(found) == len(given)
    by_id = {r["doc_id"]: r for r in found}
    shard_of = {}
    for doc_id, text, *_ in given:
        raw = (text or "").encode()
        assert (by_id[doc_id]["size"], by_id[doc_id]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        shard_of.setdefault(text or "", set()).add(by_id[doc_id]["shard"])
    for shard in range(shards):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    return shard_of


@pytest.mark.parametrize("cell", [2_000, 7])
def test_balance_groups_and_slots(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    given = [r for r in rows() if not (r[1] or "").startswith("long")]
    found = sharding.shard_rows(spark.createDataFrame(given, SCHEMA).repartition(5), 4).collect()
    shard_of = checked(found, given, 4)
    assert all(len(s) == 1 for s in shard_of.values())   # equal texts stay together
    for what in (lambda r: r["size"], lambda r: r["tokens"], lambda r: 1):
        sums = [sum(what(r) for r in found if r["shard"] == s) for s in range(4)]
        assert max(sums) - min(sums) < 0.12 * max(sums)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 0.04 * max(sizes)


def test_a_group_larger_than_a_shard_is_split(spark):
    given = [(i, "hot text of many rows", 1, "s", 2, 3) for i in range(800)] + [
        (800 + r[0], r[1], *r[2:]) for r in rows(300)[:300]]
    found = sharding.shard_rows(spark.createDataFrame(given, SCHEMA), 4).collect()
    shard_of = checked(found, given, 4)
    assert len(shard_of["hot text of many rows"]) == 4
    counts = np.bincount([r["shard"] for r in found])
    assert counts.max() - counts.min() < 0.1 * counts.max()


def test_placing_follows_residual_capacity():
    demands = np.array([[8, 1], [8, 1], [1, 8], [1, 8], [1, 1], [1, 1]], dtype=float)
    shards = sharding.place(demands, 2)
    loads = np.array([demands[shards == s].sum(axis=0) for s in (0, 1)])
    assert (loads[0] == loads[1]).all()


def test_few_rows_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None)], "doc_id long, text string")
    found = sharding.shard_rows(df, 8).collect()
    assert len(found) == 4
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(df.limit(0), 8).count() == 0


def test_one_null_id_and_text_in_half_of_the_rows(spark):
    given = [(None, "the same text", 1, "s", 2, 3)] * 2000 + [(i, f"text {i} of its own", 1, "s", 2, 3) for i in range(2000)]
    found = sharding.shard_rows(spark.createDataFrame(given, SCHEMA).repartition(5), 8).collect()
    assert len(found) == 4000
    sums = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 8 + 40
    for s in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_one_hot_id_is_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    given = [(7, f"text {i}", 1, "s", 2, 3) for i in range(3000)]
    found = sharding.shard_rows(spark.createDataFrame(given, SCHEMA), 4).collect()
    sums = [sum(r["size"] for r in found if r["shard"] == s) for s in range(4)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 4 + 20


def plain_placement(demands, shards):
    """Largest first by bytes; the shard with the highest weighted dot product of demand and what is left."""
    totals = [sum(d[k] for d in demands) for k in range(3)]
    left = [[1 / shards] * 3 for _ in range(shards)]
    out = [0] * len(demands)
    for u in sorted(range(len(demands)), key=lambda u: (-demands[u][0] / totals[0], u)):
        share = [demands[u][k] / totals[k] for k in range(3)]
        dots = [sum(e * a * b for e, a, b in zip((16, 1, 1), share, row)) for row in left]
        out[u] = max(range(shards), key=lambda s: (round(dots[s], 12), -s))
        left[out[u]] = [a - b for a, b in zip(left[out[u]], share)]
    return out


def test_packing_is_that_of_a_plain_loop():
    rng = np.random.default_rng(4)
    for n, shards in ((40, 3), (200, 8), (5, 8)):
        demands = rng.integers(1, 1000, (n, 3)).astype(float)
        assert sharding.place(demands, shards).tolist() == plain_placement(demands.tolist(), shards)
