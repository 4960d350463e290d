import collections
import math

import pytest
from pyspark.sql import functions as F

from trawl.llm import mixing

SCHEMA = "doc_id long, text string, source string, _blocks int, `a.b` int, mix_old int"


def docs(spark, sizes, seed=0):
    rows = []
    for source, lengths in sizes.items():
        rows += [(len(rows) + i, " ".join(["w"] * n) if n is not None else None, source, 1, 2, 3)
                 for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


SIZES = {"big": [50] * 400 + [5000], "middle": [30] * 100, "small": [20] * 21, None: [10] * 30, "blank": [0, None]}


def test_exponent_meets_its_targets():
    tokens = {"a": 90_000, "b": 9_000, "c": 1_000}
    flat = mixing.exponent_for(tokens, target_entropy=0.8)
    assert mixing.entropy(mixing.weights(tokens, flat)) == pytest.approx(0.8, abs=1e-6)
    assert mixing.entropy(mixing.weights(tokens, 1.0)) < 0.8
    limited = mixing.exponent_for(tokens, most_repeats=3)
    shares = mixing.weights(tokens, limited)
    assert mixing.repeats(tokens, shares, None) == pytest.approx(3, abs=1e-6)
    assert mixing.exponent_for(tokens, target_entropy=0.1) == pytest.approx(1.0)
    assert mixing.exponent_for(tokens, target_entropy=0.8, most_repeats=1.5) > flat
    assert mixing.exponent_for(tokens, most_repeats=1000) == 0.0
    assert mixing.weights({"x": 0}, 0.5) == {"x": 0.0} and mixing.exponent_for({}, most_repeats=2) == 0.0


@pytest.mark.parametrize("block", [mixing.BLOCK_TOKENS, 300])
def test_every_row_once_and_sources_at_their_budgets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    mixture = mixing.mix(docs(spark, SIZES), most_repeats=2.5)
    found = mixture.rows.collect()
    assert mixture.rows.columns == ["doc_id", "text", "source", "_blocks", "a.b", "mix_tokens", "mix_epoch", "mix_place"]
    tokens = {s: sum(n or 0 for n in lengths) for s, lengths in SIZES.items()}
    shares = {s: (n / sum(tokens.values())) ** mixture.exponent for s, n in tokens.items() if n}
    spent, times, epochs = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in found:
        spent[r["source"]] += r["mix_tokens"]
        times[r["doc_id"]] += 1
        epochs[r["doc_id"]].add(r["mix_epoch"])
        assert 0 <= r["mix_place"] <= 1
    assert set(times) == set(range(sum(map(len, SIZES.values()))))          # nothing is dropped
    assert all(epochs[d] == set(range(times[d])) for d in times)           # whole epochs, then a part of one
    assert max(times.values()) <= math.ceil(2.5)
    for s, share in shares.items():
        budget = mixture.budgets[s]
        assert mixture.weights[s] == pytest.approx(share / sum(shares.values()))
        assert budget <= spent[s] + 1e-6 <= budget + max(n or 0 for n in SIZES[s]) + 1e-6


def test_a_budget_smaller_than_a_source_takes_a_part_of_it(spark):
    mixture = mixing.mix(docs(spark, SIZES), target_entropy=0.9, budget=2000)
    found = mixture.rows.collect()
    assert sum(r["mix_tokens"] for r in found if r["source"] != "big") < 2200
    assert len({(r["doc_id"], r["mix_epoch"]) for r in found}) == len(found)
    again = mixing.mix(docs(spark, SIZES).repartition(5), target_entropy=0.9, budget=2000).rows.collect()
    assert sorted(r["doc_id"] for r in again) == sorted(r["doc_id"] for r in found)


def test_places_hold_the_sources_in_their_weights(spark):
    sizes = {"x": [10] * 3000, "y": [10] * 1000}
    rows = sorted(mixing.mix(docs(spark, sizes)).rows.collect(), key=lambda r: r["mix_place"])
    for a in range(0, 4000, 1000):
        assert sum(r["source"] == "x" for r in rows[a:a + 1000]) == pytest.approx(750, abs=60)


def test_rows_without_words_are_never_lost(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5)  # many blocks, some of blank rows only
    sizes = {"x": [3] * 30 + [0] * 40, "y": [2] * 5 + [None] * 9, "z": [0]}
    found = mixing.mix(docs(spark, sizes), most_repeats=2).rows.collect()
    assert {r["doc_id"] for r in found} == set(range(sum(map(len, sizes.values()))))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert mixing.mix(df, most_repeats=1).rows.count() == 3
    assert mixing.mix(df.limit(0), most_repeats=2).rows.count() == 0


def test_many_sources_stay_a_table(spark, monkeypatch):
    sizes = {f"s{n}": [5] * (1 + n % 4) for n in range(60)}
    few = mixing.mix(docs(spark, sizes), most_repeats=1.5)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    many = mixing.mix(docs(spark, sizes), most_repeats=1.5)
    assert many.weights == {} and many.exponent == few.exponent
    assert {r["_source"]: r["_weight"] for r in many.sources.collect()} == few.weights
    tokens = {s: sum(n) for s, n in sizes.items()}
    assert few.exponent == pytest.approx(mixing.exponent_for(tokens, most_repeats=1.5))
    assert few.weights == pytest.approx(mixing.weights(tokens, few.exponent))

    def placed(m):
        return sorted((r["doc_id"], r["mix_epoch"], r["mix_place"]) for r in m.rows.collect())

    assert placed(many) == placed(few)


def test_rows_of_one_id_are_dealt_into_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)
    rows = [(None, f"a{n} b c d", "s") for n in range(400)]
    mixture = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mixture.rows.collect()
    assert sorted(r["text"] for r in found) == sorted(t for _, t, _ in rows)
    assert len({round(r["mix_place"], 6) for r in found}) > 390


def plain_mix(spark, rows, budgets, block_tokens, seed=7):
    """The mixture by plain loops; only the seeded hashes are Spark's."""
    def hashes(values, schema, *columns):
        df = spark.createDataFrame(values, schema)
        return [r[0] for r in df.select(F.xxhash64(*columns)).collect()]

    out = []
    for source in {s for _, _, s in rows}:
        mine = [(i, t or "") for i, t, s in rows if s == source]
        size = [len(t.split()) for _, t in mine]
        total, budget = sum(size), budgets[source]
        n_blocks = max(1, math.ceil(total / block_tokens))
        text = hashes([(t,) for _, t in mine], "t string", "t")
        keys = hashes([(i, h) for (i, _), h in zip(mine, text)], "i long, h long", "i", "h", F.lit(seed))
        of = [k % n_blocks for k in keys]
        spent, epoch = 0, 0
        while spent < budget - 1e-9 * budget or epoch == 0:
            order = hashes([(b, epoch) for b in range(n_blocks)], "b int, e int", "b", "e", F.lit(seed))
            key = hashes([(i, h, epoch) for (i, _), h in zip(mine, text)], "i long, h long, e int", "i", "h", "e", F.lit(seed))
            for b in sorted(range(n_blocks), key=lambda b: (order[b], b)):
                inside = [k for k in range(len(mine)) if of[k] == b]
                n = sum(size[k] for k in inside)
                spare = 1e-9 * budget
                if not inside or not (spent < budget - spare or n == 0 and spent <= budget + spare):
                    continue
                at = spent
                for k in sorted(inside, key=lambda k: (key[k], mine[k][0], text[k])):
                    if spent + n <= budget + spare:
                        out.append((mine[k][0], epoch, (spent + n * (key[k] / 2**64 + 0.5)) / max(budget, 1)))
                    elif at < budget - spare:
                        out.append((mine[k][0], epoch, at / max(budget, 1)))
                    at += size[k]
                spent += n
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize("options", [{"most_repeats": 2.5}, {"target_entropy": 0.95, "budget": 900}, {}])
def test_blocks_epochs_and_places_are_those_of_plain_loops(spark, monkeypatch, options):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 70)
    rows = [(len(s) * 1000 + n, " ".join(["w"] * (n % 13)), s) for s, m in (("a", 150), ("bb", 40), ("ccc", 9)) for n in range(m)]
    mixture = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), **options)
    found = sorted((r["doc_id"], r["mix_epoch"], r["mix_place"]) for r in mixture.rows.collect())
    wanted = plain_mix(spark, rows, mixture.budgets, 70)
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in wanted])
