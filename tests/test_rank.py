import math
import random

import pytest

from trawl.operators import match, rank
from trawl.plans import requests as ask

W = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def _scores(spark, requests, rows, fields, config="simple"):
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} string" for f, _ in fields))
    scored = rank.ranked(ask.strict(spark, requests, config), match.Scan(df, "id", fields))
    return {(r["query_id"], r["doc_id"]): r["rank"] for r in scored.collect()}


def test_published_single_values(spark):
    got = _scores(spark, {"one": "cat", "near": "cat & dog", "or": "cat | dog", "not": "cat & !x"},
                  [(1, "cat dog")], [("t", "D")])
    assert got["one", 1] == pytest.approx(0.0607927, abs=1e-6)
    assert got["near", 1] == pytest.approx(0.0991032, abs=1e-4)
    assert got["or", 1] == pytest.approx(0.0607927, abs=1e-6)
    assert got["not", 1] == 1e-20


def _by_hand(occurrences, terms, pairs):
    """The formula written out over all pairs, ``occurrences``: term -> [(pos, weight)]."""
    if not pairs:
        total = 0.0
        for term in terms:
            ws = [w for _, w in sorted(occurrences.get(term, []))]
            if ws:
                best, first = max(ws), ws.index(max(ws)) + 1
                total += (best + sum(w / j ** 2 for j, w in enumerate(ws, 1))
                          - best / first ** 2) / 1.64493406685
        return total / len(terms)
    flat = [(p, w, t) for t in terms for p, w in occurrences.get(t, [])]
    if len({t for _, _, t in flat}) < 2:
        return 1e-20
    log = 0.0
    for i, (p, w, t) in enumerate(flat):
        for q, v, u in flat[:i]:
            if t != u:
                d = abs(p - q)
                g = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                log += math.log1p(-math.sqrt(w * v * g))
    return -math.expm1(log)


def test_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = ["aa", "bb", "cc"] + [f"x{n}" for n in range(40)]
    rows, occurrences = [], {}
    for n in range(40):
        title, body = ([rng.choice(vocabulary) for _ in range(rng.randint(0, k))] for k in (6, 700))
        rows.append((n, " ".join(title), " ".join(body)))
        for pos, word in enumerate(title + body, 1):
            weight = W["A"] if pos <= len(title) else W["B"]
            occurrences.setdefault(n, {}).setdefault(word, []).append((pos, weight))
    # A document whose two terms are far apart only.
    rows.append((99, "aa", " ".join(["x1"] * 150 + ["bb"])))
    occurrences[99] = {"aa": [(1, 1.0)], "bb": [(152, 0.4)]}
    asked = {"or": ("aa | bb | zz", False), "and": ("aa & bb", True), "one": ("aa", False),
             "three": ("aa & (bb | cc)", True), "top_or": ("aa & bb | cc", False),
             "not": ("!cc", False)}
    got = _scores(spark, {q: r for q, (r, _) in asked.items()}, rows,
                  [("title", "A"), ("body", "B")])
    checked = 0
    for (query, doc), value in got.items():
        request, pairs = asked[query]
        terms = [t for t in ("aa", "bb", "cc", "zz") if t in request]
        want = _by_hand(occurrences[doc], terms, pairs)
        assert value == pytest.approx(want, rel=1e-9, abs=1e-25), (query, doc)
        checked += 1
    assert checked > 150
    assert 1e-17 < got["and", 99] < 1e-14


def test_top_k_numbers_and_ties(spark):
    scored = spark.createDataFrame(
        [("q", n, float(n % 3)) for n in range(200)] + [("r", 5, 0.1)],
        "query_id string, doc_id long, rank double")
    rows = rank.top_k(scored, 3).collect()
    assert sorted((r.query_id, r.place, r.doc_id) for r in rows) == [
        ("q", 1, 2), ("q", 2, 5), ("q", 3, 8), ("r", 1, 5)]
