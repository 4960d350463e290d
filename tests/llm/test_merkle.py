"""The Merkle manifest against a plain one, and the numbering under it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trawl.llm import merkle
from trawl.llm.ordering import numbered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lowered=False):
    out = []
    for name in FIELDS:
        value = row[name]
        if name == "text" and lowered and value is not None:
            value = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*out)


def up(digests):
    """(root, for each leaf the siblings left and right of its way, level by level)."""
    ways = [[] for _ in digests]
    owners = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(a, min(a + 16, len(digests))) for a in range(0, len(digests), 16)]
        for run in runs:
            for at in run:
                for i in owners[at]:
                    ways[i].append((digests[run.start:at], digests[at + 1:run.stop]))
        owners = [[i for at in run for i in owners[at]] for run in runs]
        digests = [h(*(digests[at] for at in run)) for run in runs]
    return digests[0], ways


def brute(rows, tampered):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: up([leaf(r) for r in groups[s]]) for s in names}
    root, above = up([below[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for r, way in zip(groups[s], below[s][1]):
            folded = leaf(r, tampered(r))
            for left, right in way + top:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in way + top for x in left + right))
            out.append((r["doc_id"], leaf(r), below[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(df, tampered=None):
    rows = merkle.manifest(df, FIELDS, tampered=tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


def of(n, source, first=0):
    return [(first + i, f"Text {i} é", "en", source, 8 + i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    of(1, "one"), of(16, "a"), of(17, None), of(5, "a") + of(1, "b", 100) + of(300, None, 200) + of(33, "é", 900),
    [r for i in range(20) for r in of(1 + i % 3, f"s{i}", 10 * i)],
    [(None, None, None, None, None), (None, "A", None, "", 0), (3, "", "en", None, None), (3, "", "en", None, None),
     (3, "X", "en", None, 1), (4, "Long " * 200_000, "en", "z", 10**6)]])
def test_manifest_is_the_plain_one(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = brute(df.collect(), lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0)
    assert found(df.repartition(3), F.col("doc_id") % 3 == 0) == wanted


def test_untampered_rows_are_verified_and_tampered_are_not(spark):
    df = spark.createDataFrame(of(40, "a") + [(99, "no capitals", "en", "a", 1)], SCHEMA)
    assert all(r[-1] for r in found(df))
    assert {r[0] for r in found(df, F.lit(True)) if r[-1]} == {99}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    df = spark.createDataFrame(of(20, "a"), SCHEMA)
    odd = df.withColumns({c: F.lit(7) for c in ("tree", "level", "place", "n", "digest", "kids", "path", "_row", "_part",
                                               "_id", "_group", "a`b")}).withColumnRenamed("a`b", "a.b")
    assert found(odd) == found(df)


def test_rows_are_numbered_in_order_whatever_they_share(spark):
    rows = [(1, "x")] * 700 + [(i % 7, str(i % 5)) for i in range(300)] + [(None, "y")] * 50
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = sorted(map(tuple, numbered(df, ["a", "b"], "at", "numbers").collect()), key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(len(rows)))
    assert [r[:2] for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_one_key_is_dealt_over_many_ranges(spark):
    from trawl.llm.ordering import dealt
    rows = spark.range(4000).select(F.lit(1).alias("a"))
    sizes = [r["count"] for r in dealt(rows, ["a"], "dealt").groupBy("_part").count().collect()]
    assert max(sizes) < 2 * 4000 / 4
