import numpy as np
import pytest

from trawl.llm import pivots

EXTRA = "vec_id long, embedding array<float>, node int, root string, n int"


def vectors():
    rng = np.random.default_rng(8)
    out = []
    for _ in range(6):  # families around 0.9, some links and some not
        base = rng.normal(size=24)
        out += [base + rng.normal(size=24) * s for s in rng.uniform(0, 0.4, 25)]
    out += list(rng.normal(size=(80, 24)))
    out += [out[0], out[0], 3 * out[1]]
    return [np.asarray(v, dtype=np.float32).tolist() for v in out]


def brute(rows, least):
    fit = [v is not None and None not in v and len(v) > 0 and bool(np.isfinite(v).all()) and any(v) for v in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and len(rows[i]) == len(rows[j]):
                a, b = (np.array(x, dtype=np.float64) for x in (rows[i], rows[j]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return links, root


@pytest.mark.parametrize("block,large", [(2048, 16_384), (7, 16_384), (7, 30), (2048, 1)])
def test_against_brute_force(spark, monkeypatch, block, large):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "LARGE", large)
    rows = vectors() + [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [0.0] * 23,
                        [1.0, 2.0], [1.0, 2.1], [1e-30] * 24, [1e30] * 24]
    df = spark.createDataFrame([(i, v, 1, "r", 2) for i, v in enumerate(rows)], EXTRA).repartition(5)
    found = sorted(pivots.near_vectors(df, 0.9).collect())
    links, roots = brute(rows, 0.9)
    wanted, got = np.array(links), np.array([r["n_links"] for r in found])
    assert (got <= wanted).all()
    assert got.sum() >= 0.98 * wanted.sum()  # recall of the index
    assert np.mean([r["component_id"] == x for r, x in zip(found, roots, strict=True)]) > 0.97
    assert [r["component_id"] for r in found[-8:]] == roots[-8:]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_few_rows_repeated_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [2.0, 0.0]), (None, [1.0, 0.0])], schema)
    found = sorted(map(tuple, pivots.near_vectors(same, 0.9).collect()), key=str)
    assert found == sorted([(3, 3, 1, False), (3, 3, 1, False), (1, 3, 1, True), (None, 3, 1, False)], key=str)
    assert pivots.near_vectors(same.limit(0), 0.9).count() == 0
    one = pivots.near_vectors(same.where("vec_id = 1"), 0.9).collect()
    assert list(map(tuple, one)) == [(1, 0, 1, True)]


@pytest.mark.parametrize("m", [2000, 4096])
@pytest.mark.parametrize("dims", [16, 64])
def test_pairs_at_the_threshold_meet_however_many_pivots(m, dims):
    """Recall of one pair at cosine 0.9, in lists of one pivot and in lists of two."""
    rng = np.random.default_rng(m + dims)

    def units(n):
        v = rng.standard_normal((n, dims))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    chosen = pivots.far_apart(units(8192), m)
    a, u = units(1500), units(1500)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + (1 - 0.81) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    p, q = pivots.nearest_pivots(a, chosen), pivots.nearest_pivots(b, chosen)
    n = pivots.NEAREST
    assert (p[:, :n, None] == q[:, None, :n]).any(axis=(1, 2)).mean() >= 0.98
    assert ((p[:, :, None] == q[:, None, :]).any(axis=2).sum(axis=1) >= 2).mean() >= 0.98


def test_lists_of_a_vector_are_pivots_or_pairs_with_a_large_list(spark):
    rows = spark.createDataFrame([([5, 3, 9, 1, 7, 2, 8, 4, 6, 0],)], "pivots array<int>")
    found = rows.selectExpr(pivots._list_keys([9, 0])).first()[0]
    pairs = {(min(p, q) + 1 << pivots.PAIR_KEY) + max(p, q) for p in (9, 0) for q in range(10) if p != q}
    assert found == sorted({5, 3, 1, 7, 2, 8, 4} | pairs)
    assert rows.selectExpr(pivots._list_keys([])).first()[0] == [1, 2, 3, 4, 5, 7, 8, 9]


def test_large_lists_keep_pairs_that_share_only_their_pivot(spark, monkeypatch):
    """With prefixes of one pivot no pair of vectors shares a second one."""
    monkeypatch.setattr(pivots, "PREFIX", 1)
    monkeypatch.setattr(pivots, "NEAREST", 1)
    monkeypatch.setattr(pivots, "BLOCK", 7)
    df = spark.createDataFrame([(i, v, 1, "r", 2) for i, v in enumerate(vectors())], EXTRA)
    whole = sorted(pivots.near_vectors(df, 0.9).collect())
    assert sum(r["n_links"] for r in whole) > 100
    for large in (1, 5):
        monkeypatch.setattr(pivots, "LARGE", large)
        assert sorted(pivots.near_vectors(df, 0.9).collect()) == whole
