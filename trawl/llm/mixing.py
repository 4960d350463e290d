"""Mixing sources to target weights.

A source's weight is its share of tokens to the power of an exponent between 0 and 1, normalised.
The exponent is bisected: to the largest at which the weights still have a target entropy, or to the
smallest at which no source is repeated more often than a limit. The weights are then realised:
every source gets a budget of tokens and spends it on seeded permutations of its blocks, one
permutation per epoch. A block is a hash share of a source's rows with about ``BLOCK_TOKENS`` tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import n_words, quoted, text_or_empty
from trawl.session import stored

BLOCK_TOKENS = 1 << 18
BISECTIONS = 60
# The tables of so many sources are broadcast and given as dicts; larger ones stay tables.
FEW_SOURCES = 100_000


def weights(tokens: dict, exponent: float, times: dict | None = None) -> dict:
    """Shares to the power of ``exponent``, normalised; a source without tokens has weight 0.

    Sources of equal size may be given once, with their number in ``times``; so in the functions below.
    """
    times = times or dict.fromkeys(tokens, 1)
    total = sum(n * times[s] for s, n in tokens.items())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()} if total else {}
    whole = sum(x * times[s] for s, x in raw.items())
    return {s: x / whole for s, x in raw.items()} if whole else dict.fromkeys(tokens, 0.0)


def entropy(shares: dict, times: dict | None = None) -> float:
    """Natural-log entropy divided by its largest possible value, 0 to 1."""
    times = times or dict.fromkeys(shares, 1)
    some = [(x, times[s]) for s, x in shares.items() if x > 0]
    n = sum(t for _, t in some)
    return -sum(t * x * math.log(x) for x, t in some) / math.log(n) if n > 1 else 1.0


def repeats(tokens: dict, shares: dict, budget: float | None) -> float:
    """Most epochs of any source; without a budget, that at which every source is used in full."""
    budget = whole_budget(tokens, shares) if budget is None else budget
    return max((budget * shares[s] / n for s, n in tokens.items() if n), default=0.0)


def whole_budget(tokens: dict, shares: dict) -> float:
    """The smallest budget that gives every source one epoch at least."""
    return max((n / shares[s] for s, n in tokens.items() if n), default=0.0)


def exponent_for(tokens: dict, target_entropy: float | None = None, most_repeats: float | None = None,
                 budget: float | None = None, times: dict | None = None) -> float:
    """The largest exponent with at least the target entropy, or the smallest within the limit.

    With both, the limit comes first. 1 keeps the sources' own shares, 0 makes all equal.
    """
    def bisect(fits) -> float:
        low, high = 0.0, 1.0   # ``fits`` is false from some exponent downwards
        if fits(low):
            return low
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        return high

    if target_entropy is None and most_repeats is None:
        return 1.0
    if target_entropy is None:
        return bisect(lambda x: repeats(tokens, weights(tokens, x, times), budget) <= most_repeats)
    flat = 1.0 if entropy(weights(tokens, 1.0, times), times) >= target_entropy else 1.0 - bisect(
        lambda y: entropy(weights(tokens, 1.0 - y, times), times) >= target_entropy)
    if most_repeats is None:
        return flat
    return max(flat, exponent_for(tokens, most_repeats=most_repeats, budget=budget, times=times))


@dataclass
class Mixture:
    """The realised mixture: the exponent, a table (_source, _total, _blocks, _weight, _budget) of all
    sources, the rows, and the weights and budgets as dicts, empty for more than ``FEW_SOURCES``."""

    exponent: float
    sources: DataFrame
    rows: DataFrame
    weights: dict
    budgets: dict


def mix(docs: DataFrame, target_entropy: float | None = None, most_repeats: float | None = None,
        budget: float | None = None, source_col: str = "source", id_col: str = "doc_id",
        text_col: str = "text", seed: int = 7) -> Mixture:
    """Rows of the mixture: the columns of ``docs`` with mix_tokens, mix_epoch and mix_place.

    A token is a word. ``budget`` is the mixture's number of tokens; by default the smallest that uses
    every row. A source with budget B spends it on whole epochs first; in the last epoch whole blocks
    are taken in their seeded order, then rows of the next block in theirs, as long as the tokens
    before a row are fewer than what is left. ``mix_place`` (0 to 1) is the row's place in its source's
    budget: ordered by it, every stretch holds the sources in their weights.

    Null sources are one source of their own. Rows without words (null or empty text) cost nothing:
    they are in every epoch whose blocks they belong to, and a source of only such rows is used
    once. A text is counted and moved in whole, however long; one longer than a block makes its block
    longer. Rows are dealt into blocks by id and text, so rows that share an id, or have none, are dealt
    like others; repeated rows are rows of their own and lie in one block. Of rows in a cut block with
    equal ids that with the smaller text hash comes first. Columns named mix_* are replaced. An empty
    table gives an empty result.
    """
    given = quoted([c for c in docs.columns if not c.startswith("mix_")])
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*given).alias("_row"), F.col(source_col).cast("string").alias("_s"),
                       F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), n_words(text).alias("mix_tokens"))
    found = stored(rows.groupBy(F.col("_s").alias("_source")).agg(F.sum("mix_tokens").alias("_total")), "mix-sources")
    # Sources of one size have one weight; there are far fewer sizes than sources.
    sizes = {r["_total"]: r["count"] for r in found.groupBy("_total").count().collect()}
    tokens = {n: n for n in sizes}
    exponent = exponent_for(tokens, target_entropy, most_repeats, budget, sizes)
    shares = weights(tokens, exponent, sizes)
    total = whole_budget(tokens, shares) if budget is None else budget
    plan = docs.sparkSession.createDataFrame(
        [(int(n), max(1, math.ceil(n / BLOCK_TOKENS)), float(w), float(total * w)) for n, w in shares.items()],
        "_total long, _blocks int, _weight double, _budget double")
    plan = stored(found.join(F.broadcast(plan), "_total").select(
        "_source", "_total", "_blocks", "_weight", "_budget"), "mix-plan")
    few = sum(sizes.values()) <= FEW_SOURCES
    listed = plan.collect() if few else []
    return Mixture(exponent, plan, _realised(rows, F.broadcast(plan) if few else plan, seed),
                   {r["_source"]: r["_weight"] for r in listed}, {r["_source"]: r["_budget"] for r in listed})


def _realised(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    blocked = rows.join(plan, F.col("_s").eqNullSafe(F.col("_source"))).withColumn(
        "_block", F.pmod(F.xxhash64("_id", "_hash", F.lit(seed)), F.col("_blocks")).cast("int"))
    blocks = stored(blocked.groupBy("_source", "_block", "_total", "_budget").agg(
        F.sum("mix_tokens").alias("_n")), "mix-blocks")
    spare = 1e-9 * F.col("_budget")  # rounding must not ask for a row more than whole epochs
    last = F.greatest(F.lit(1), F.ceil((F.col("_budget") - spare) / F.greatest("_total", F.lit(1)))).cast("int")
    turns = blocks.withColumn("_epoch", F.explode(F.sequence(F.lit(0), last - 1)))
    order = Window.partitionBy("_source", "_epoch").orderBy(
        F.xxhash64("_block", "_epoch", F.lit(seed)), "_block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_epoch") * F.col("_total") + F.coalesce(F.sum("_n").over(order), F.lit(0))
    free = (F.col("_n") == 0) & (F.col("_start") <= F.col("_budget") + spare)  # a block without words
    turns = turns.withColumn("_start", start).where((F.col("_start") < F.col("_budget") - spare) | free)
    # A block that the budget cuts is the last of its source; only its rows are put in order.
    whole = F.col("_start") + F.col("_n") <= F.col("_budget") + spare
    use = turns.select("_source", "_block", "_epoch", "_start", "_n", "_budget", whole.alias("_whole"))
    placed = blocked.drop("_budget").withColumnRenamed("_source", "_from").withColumnRenamed("_block", "_in").join(
        use, (F.col("_from").eqNullSafe(F.col("_source"))) & (F.col("_in") == F.col("_block")))
    key = F.xxhash64("_id", "_hash", F.col("_epoch"), F.lit(seed))
    size = F.greatest("_budget", F.lit(1.0))
    taken = placed.where("_whole").select(
        "_row.*", "mix_tokens", F.col("_epoch").alias("mix_epoch"),
        ((F.col("_start") + F.col("_n") * (key / F.lit(2.0**64) + 0.5)) / size).alias("mix_place"))
    inside = Window.partitionBy("_from", "_in").orderBy(key, "_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("not _whole").withColumn(
        "_at", F.col("_start") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)))
    cut = cut.where(F.col("_at") < F.col("_budget") - spare).select(
        "_row.*", "mix_tokens", F.col("_epoch").alias("mix_epoch"), (F.col("_at") / size).alias("mix_place"))
    return taken.unionByName(cut)
