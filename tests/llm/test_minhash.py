import random
import re

import pytest

from trawl.llm import components, minhash

EXTRA = "doc_id long, text string, node long, bands int, n_shingles string"


def sets_of(texts, width):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
        out.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(texts, percent, width):
    sets = sets_of(texts, width)
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [len(s) for s in sets], root


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def family(rng):
    """A text, many copies with a few words changed, chains of copies of copies, and strangers."""
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [base] + [edited(rng, base, rng.randrange(1, 14)) for _ in range(70)]
    chain = [f"c{rng.randrange(5000)}" for _ in range(200)]
    for _ in range(25):
        texts.append(chain)
        chain = edited(rng, chain, 4)
    texts += [[f"s{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60))] for _ in range(30)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


ODD = [None, "", " \n", "one", "One", "two words", "two  WORDS", "É é", "é É", "a b c", "a\tb\x0bc", "a b c",
       " ".join(f"v{i % 977}x{i % 1009}" for i in range(60_000))]


@pytest.mark.parametrize("percent,width,blocks", [(85, 3, None), (80, 5, None), (85, 3, 8)])
def test_against_brute_force(spark, monkeypatch, percent, width, blocks):
    if blocks:  # lists in many blocks, with few hubs
        monkeypatch.setattr(minhash, "BLOCK_CLASSES", blocks)
        monkeypatch.setattr(minhash, "HUBS", 1)
    texts = ODD + family(random.Random(percent + width))
    rows = [(i, t, 1, 2, "z") for i, t in enumerate(texts)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, EXTRA).repartition(5), percent, width)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted(found.collect())
    sizes, roots = brute(texts, percent, width)
    assert [r["n_shingles"] for r in found] == sizes
    assert [r["component_id"] for r in found] == roots
    assert [r["kept"] for r in found] == [i == r for i, r in enumerate(roots)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (2, "a b c d"), (None, "alone in here now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, minhash.near_duplicates(df, 85, 3).collect()), key=str)
    assert found == sorted([(4, 2, 2, False), (4, 2, 2, False), (None, 2, 2, False), (2, 2, 2, True),
                            (None, 2, None, False), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(df.limit(0), 85, 3).count() == 0


def test_no_duplicates_at_all(spark):
    df = spark.createDataFrame([(i, f"t{i} u{i} v{i} w{i}") for i in range(20)], "doc_id long, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(df, 85, 3).collect())


def test_likeness_is_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    other = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    hashes = np.concatenate([common, common[:4000], other])
    mins = minhash.minima(hashes, np.array([0, 6000, 14000]), 125)
    signature = minhash.packed(mins).view(np.uint64)
    bits = signature[0] ^ signature[1]
    lanes = (bits | bits >> np.uint64(1)) & np.uint64(0x5555555555555555)
    same = 1 - np.bitwise_count(lanes).sum() / 125
    assert (same - 0.25) / 0.75 == pytest.approx(4000 / 10000, abs=0.15)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (160, 100)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 260))} | {5: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_follow_the_threshold():
    assert minhash.shape_for(85) == minhash.Shape(25, 5)
    for percent in (10, 30, 50, 70, 80, 85, 90, 99, 100):
        shape = minhash.shape_for(percent)
        assert (1 - (percent / 100) ** shape.rows) ** shape.bands <= minhash.MISS
        assert shape.minima <= minhash.MOST_MINIMA or shape.rows == 1
    assert minhash.shape_for(80).minima <= 125


def test_a_very_long_text_and_its_near_copy_are_linked(spark):
    words = [f"w{n}" for n in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1000])), (3, " ".join(words[::-1]))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}
