"""Hard negatives against brute force, and what the spanning tree's bounds spare."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=5, n_positives=5, n_negatives=3):
    fit = []
    for vec_id, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.append((vec_id, label, [max(-2**26, min(2**26, math.floor(256 * float(np.float32(x))))) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def first(found, k):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]

    out = []
    for anchor, label, v in fit:
        if anchor is None or anchor % every:
            continue
        mine = [(score(v, w), i) for i, other, w in fit if other == label and i != anchor]
        others = [(score(v, w), i) for i, other, w in fit if other != label]
        for p, positive in first(mine, n_positives):
            some = [r for r in others if 50 * p <= 100 * r[0] <= 95 * p]
            out += [(anchor, positive, k, i, p, s) for k, (s, i) in enumerate(first(some, n_negatives), 1)]
    return sorted(out, key=str)


def found(spark, rows, every=5, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = hardneg.hard_negatives(df, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=str)


def clustered(n, dims, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    v = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int(label), [float(x) for x in row]) for i, (label, row) in enumerate(zip(rng.integers(0, 3, n), v))]


@pytest.mark.parametrize("block,anchors", [(512, 16_384), (7, 16_384), (7, 21), (1, 16_384)])
def test_results_are_those_of_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    rows = clustered(300, 12, 0.2)
    wanted = brute(rows)
    assert wanted and found(spark, rows) == wanted


def test_odd_rows_and_ties(spark):
    rows = clustered(60, 4, 0.5) + [
        (100, None, [1.0, 0.0, 0.0, 0.0]), (105, 1, None), (110, 1, [1.0, None, 0.0, 0.0]), (115, 1, [float("nan"), 0.0, 0.0, 0.0]),
        (120, 1, [float("inf"), 0.0, 0.0, 0.0]), (125, 1, [0.0, 0.0, 0.0, 0.0]), (None, 1, [0.5, 0.5, 0.5, 0.5]),
        (None, 2, [0.5, 0.5, 0.5, 0.5]), (130, 1, [0.5, 0.5, 0.5, 0.5]), (130, 1, [0.5, 0.5, 0.5, 0.5]),
        (135, 2, [0.4, 0.5, 0.5, 0.5]), (136, 2, [0.4, 0.5, 0.5, 0.5]), (137, 2, [0.4, 0.5, 0.5, 0.5]),
        (138, 2, [0.4, 0.5, 0.5, 0.5]), (140, 1, []), (145, 1, [0.9]), (150, 3, [-0.5, -0.5, -0.5, -0.5]),
        (155, 3, [0.5, 0.5, 0.5, 0.5])]
    assert found(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-10**5, 3 * 10**5, 6)]) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_no_anchors_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = clustered(30, 4, 0.3)
    assert found(spark, rows[1:4]) == []
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.withColumns({c: F.lit(1) for c in ("_id", "score", "window", "code", "number", "block", "rank", "vector")})
    got = hardneg.hard_negatives(odd, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = clustered(120, 8, 0.3)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]
    assert found(spark, rows, parts=9) == brute(rows)


def test_tree_is_minimal_and_bounds_spare_most_scores():
    rng = np.random.default_rng(2)
    centres = 100 * rng.standard_normal((5, 16))
    v = np.round(centres[rng.integers(0, 5, 200)] + rng.standard_normal((200, 16)))
    order, parent, edge = hardneg.spanning_tree(v)
    assert sorted(order) == list(range(200)) and all(parent[1:] < np.arange(1, 200))
    apart = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < 200:
        rest = [i for i in range(200) if i not in joined]
        best = min(((apart[i, list(joined)].min(), i) for i in rest))
        total += best[0]
        joined.add(best[1])
    assert edge.sum() == pytest.approx(total)
    depth = np.zeros(200, dtype=int)
    for i in range(1, 200):
        depth[i] = depth[parent[i]] + 1
    by = np.lexsort((np.arange(200), depth))
    new = np.argsort(by)
    labels = rng.integers(0, 2, 200)
    tree = hardneg.Tree(np.arange(200), order[by], labels[order][by], v[order][by],
                        np.where(parent < 0, -1, new[parent])[by], edge[by], depth[by])
    at = np.arange(200)
    search = hardneg.Search(tree, hardneg.Windows(at, at, np.full(200, -np.inf), np.full(200, np.inf)), True, 5)
    for a in range(0, 200, 50):
        search.add(at[a:a + 50], labels[a:a + 50], v[a:a + 50])
    assert search.rescored < 0.3 * search.met
