import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, token long, n int, _row int"


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")] + [None]


def corpus():
    rng = np.random.default_rng(4)
    subjects, verbs = ["cats", "dogs", "birds"], ["eat", "see", "like"]
    texts = []
    for _ in range(400):
        s, v = rng.integers(0, 3, 2)
        texts.append(f"the {subjects[s]} {verbs[s]} a Thing{rng.integers(0, 400)} and {verbs[v]} it")
    return texts + [None, "", " \n", "unseen zzz", "the", "long " * 70_000]


@pytest.mark.parametrize("held", [lm.HELD, 12])
def test_counts_and_base_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)  # 12: nearly all tokens go through the join
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    found = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") % 3 == 0).collect()}
    train = [words(t) for i, t in enumerate(texts) if i % 3]
    counts = collections.Counter(w for ws in train for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ws, row = words(t), found[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (
            i % 3 == 0, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
    better = [found[i]["score"] > found[i]["base_score"] for i in range(0, 400, 3)]
    assert np.mean(better) > 0.9


@pytest.fixture(scope="module")
def small(spark):
    """A vocabulary, successor weights and hashed weights, and texts of its words and of unseen ones."""
    rng = np.random.default_rng(1)
    names = [f"w{n}{'abcdefg'[n % 7]}" for n in range(120)]
    found = next(lm.tokens(pa.array([" ".join(names)])))
    counts = spark.createDataFrame(
        [(int(h), int(f), 1 + i % 9) for i, (h, f) in enumerate(zip(found.hashes[:-1], found.suffixes[:-1]))] + [(lm.END, 0, 40)],
        "token long, suffix long, n long")
    vocabulary, _, _ = lm._vocabulary(counts)
    n = len(vocabulary.tokens)
    keys = np.unique(rng.integers(0, n + 1, 900).astype(np.uint64) << np.uint64(32) | rng.integers(0, n, 900).astype(np.uint64))
    pairs = lm.successors(keys, rng.normal(0, 2, len(keys)).astype(np.float32), vocabulary)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    texts = [" ".join(rng.choice([*names, "zz", "new"], 12)) for _ in range(30)] + ["", names[3]]
    return names, vocabulary, pairs, weights, texts


def plain_logs(vocabulary, pairs, weights, found):
    """log10 P of each token of one text but for its count, from the definition."""
    held = {int(t): i for i, t in enumerate(vocabulary.tokens)}
    weight = {int(k): float(w) for k, w in zip(pairs.pairs.keys, pairs.weights)}
    kinds, _ = lm.classes(found, vocabulary)
    rows = lm.features(found, kinds)
    within = {c: [i for i, k in enumerate(vocabulary.classes) if k == c] for c in range(lm.CLASSES)}
    out, before = [], vocabulary.start
    for j, token in enumerate(found.hashes.tolist()):
        def extra(i):
            return math.exp(weight.get(before << 32 | i, 0.0)) if before is not None else 1.0

        added = {c: 1 + sum((vocabulary.counts[i] + 1) / 10 ** vocabulary.logs[c] * (extra(i) - 1) for i in within[c])
                 for c in range(lm.CLASSES)}
        scores = [math.exp(float(weights[rows[j], c].sum()) + float(vocabulary.prior[c])) * added[c] for c in range(lm.CLASSES)]
        at, c = held.get(token), kinds[j]
        share = scores[c] / sum(scores) / added[c] / 10 ** vocabulary.logs[c] * (extra(at) if at is not None else 1)
        out.append(math.log10(share))
        before = at
    return out


def test_scores_are_those_of_the_definition(small):
    _, vocabulary, pairs, weights, texts = small
    for text in texts:
        found = next(lm.tokens(pa.array([text])))
        kinds, at = lm.classes(found, vocabulary)
        got = lm.token_logs(found, kinds, at, vocabulary, pairs, weights)
        assert got == pytest.approx(plain_logs(vocabulary, pairs, weights, found), abs=1e-4)


def test_probabilities_sum_to_one(small):
    """Over every known word, the end and one unseen word per suffix class, after several histories."""
    names, vocabulary, pairs, weights, _ = small
    for history in ("", names[5], f"{names[7]} {names[11]} zz {names[20]}"):
        whole = 0.0
        for word in [*names, None]:
            found = next(lm.tokens(pa.array([" ".join(filter(None, [history, word]))])))
            kinds, at = lm.classes(found, vocabulary)
            place = len(history.split())
            log = lm.token_logs(found, kinds, at, vocabulary, pairs, weights)[place]
            whole += 10 ** log * (vocabulary.counts[at[place]] + 1)
        unseen = {}
        for n in range(3000):
            found = next(lm.tokens(pa.array([f"{history} x{n}".strip()])))
            kinds, at = lm.classes(found, vocabulary)
            if kinds[-2] not in unseen and at[-2] < 0:
                unseen[kinds[-2]] = 10 ** lm.token_logs(found, kinds, at, vocabulary, pairs, weights)[-2]
            if len(unseen) == lm.SUFFIXES:
                break
        assert whole + sum(unseen.values()) == pytest.approx(1, abs=1e-4)


def test_successor_weights_climb_to_the_top(small):
    """No small change of a weight gives a better sum of log likelihood and log prior."""
    _, vocabulary, _, _, _ = small
    rng = np.random.default_rng(5)
    n = len(vocabulary.tokens)
    keys = np.unique(rng.integers(0, 9, 60).astype(np.uint64) << np.uint64(32) | rng.integers(0, n, 60).astype(np.uint64))
    before = (keys >> np.uint64(32)).astype(int)
    place = np.arange(len(keys)) - np.searchsorted(before, before)
    keys = keys[2 * place < vocabulary.counts[before]]   # no more pairs than half of the uses
    seen = np.ones(len(keys), dtype=np.int64)
    weight = lm.successor_weights(keys, seen, vocabulary).astype(float)

    def total(w):
        out = 0.0
        for g in np.unique(keys >> np.uint64(32)):
            rows = (keys >> np.uint64(32)) == g
            share = vocabulary.counts[(keys[rows] & np.uint64(0xFFFFFFFF)).astype(int)] / vocabulary.total
            whole = math.log(1 + (share * np.expm1(w[rows])).sum())
            out += (seen[rows] * w[rows]).sum() - vocabulary.counts[int(g)] * whole
        return out - (w ** 2).sum() / 2 / lm.SPREAD ** 2

    best = total(weight)
    for i in range(len(keys)):
        for change in (-0.3, 0.3):
            other = weight.copy()
            other[i] += change
            assert total(other) < best + 1e-4


def test_held_out_texts_beat_an_interpolated_bigram(spark):
    from trawl.llm import queries
    rows = queries.op2_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    uni, pairs, uses, test = (collections.Counter() for _ in range(4))
    test = []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        ws = words(r["text"])
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2:
            test.append(ws)
            continue
        uni.update(ws)
        pairs.update(zip(["<s>", *ws], ws))
        uses.update(["<s>", *ws[:-1]])
    total, n = sum(uni.values()), sum(map(len, test))
    for share in (0.3, 0.5, 0.7):
        log = 0.0
        for ws in test:
            for before, w in zip(["<s>", *ws], ws):
                p = (uni[w] + 1) / (total + len(uni) + 1)
                log += math.log10(share * pairs[before, w] / uses[before] + (1 - share) * p if uses[before] else p)
        assert rows[0] / rows[1] > log / n


def test_pairs_that_are_not_held_count_as_well(spark, monkeypatch):
    """What is sent to every task decides about memory, not about scores."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(n)}" for n in rng.zipf(1.5, 30) % 300) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string").repartition(3)

    def scores():
        return {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score(df, F.col("doc_id") % 5 == 0).collect()}

    whole = scores()
    for held in (lm.HELD, 20):   # 20: most words share their features
        monkeypatch.setattr(lm, "HELD", held)
        monkeypatch.setattr(lm, "PAIRS", 1 << 21)
        monkeypatch.setattr(lm, "HELD_FROM", 1)
        most = scores()
        monkeypatch.setattr(lm, "PAIRS", 1)
        few = scores()
        for i, (score, base) in most.items():
            assert few[i] == (pytest.approx(score, abs=2e-3), pytest.approx(base, rel=1e-9))
        if held != 20:
            assert whole == {i: pytest.approx(x, abs=2e-3) for i, x in most.items()}
    again = np.mean([whole[i][0] - whole[i][1] for i in range(200, 220) if i % 5 and (i - 200) % 5])
    once = np.mean([whole[i][0] - whole[i][1] for i in range(20, 200) if i % 5])
    assert again > once + 1     # texts that occur twice have pairs that do


def test_probabilities_sum_to_one_with_shared_features(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 40)
    names = [f"w{n}{'abcdefg'[n % 7]}" for n in range(60)]
    found = next(lm.tokens(pa.array([" ".join(names)])))
    times = {w: max(1, i - 20) for i, w in enumerate(names)}
    counts = spark.createDataFrame([(int(h), int(f), times[w]) for w, h, f in zip(names, found.hashes, found.suffixes)]
                                   + [(lm.END, 0, 40)], "token long, suffix long, n long")
    vocabulary, _, _ = lm._vocabulary(counts)
    assert lm.FREQUENT < len(vocabulary.tokens) < 45
    rng = np.random.default_rng(3)
    known = np.flatnonzero(vocabulary.uses)
    keys = np.unique(lm.pair_keys(rng.choice(known, 900), rng.choice(known[known != vocabulary.start], 900)))
    pairs = lm.successors(keys, rng.normal(0, 2, len(keys)).astype(np.float32), vocabulary)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)

    def logs(text, place):
        found = next(lm.tokens(pa.array([text])))
        kinds, at = lm.classes(found, vocabulary)
        number = lm.numbers(found, at, vocabulary)
        weight = pairs.of_pairs(lm.words_before(found, number, vocabulary), number)[0][place]
        log = lm.token_logs(found, kinds, at, vocabulary, pairs, weights)[place]
        return log, weight / np.log(10) if at[place] < 0 else 0, kinds[place], at[place]

    for history in ("", names[0], f"{names[55]} {names[1]}"):
        place = len(history.split())
        whole = 10 ** logs(history, place)[0] * 41
        for word in names:
            log, weight, _, _ = logs(f"{history} {word}", place)
            whole += 10 ** (log + weight) * (times[word] + 1)
        unseen = {}
        for n in range(3000):
            log, _, kind, _ = logs(f"{history} x{n}", place)
            unseen.setdefault(kind, 10 ** log)
            if len(unseen) == lm.SUFFIXES:
                break
        assert whole + sum(unseen.values()) == pytest.approx(1, abs=1e-4)


def test_group_sums():
    rng = np.random.default_rng(2)
    values, groups = rng.normal(size=(500, 3)).astype(np.float32), rng.integers(0, 40, 500)
    groups[:200] = 7
    which, n, sums = lm.group_sums(values, groups)
    assert which.tolist() == sorted(set(groups.tolist()))
    for g, k, s in zip(which, n, sums, strict=True):
        assert k == (groups == g).sum()
        assert s == pytest.approx(values[groups == g].sum(axis=0), abs=1e-4)


def test_repeated_rows_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    found = lm.score(df, F.lit(None).cast("boolean")).collect()
    assert len(found) == 3 and not any(r["held_out"] for r in found)
    none = lm.score(df, F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in none] == [(0, 0, 0.0)] * 3
    assert all(r["score"] <= 0 for r in none)
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
