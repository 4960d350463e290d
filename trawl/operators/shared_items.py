"""Large request sets: each distinct word or phrase is decided once per document, then requests fold.

Items (words and phrases) that several requests share are one row. A phrase meets the documents that have
its first words after each other: every document makes these sequences of its own words, once per shape
(the distances of the words) that phrases have, and an equi-join finds them, so the work grows with the
words and the matches. Other items start from the postings of their rarest term, and their other terms,
rarest first, cut these candidates down by equi-joins on document and term. Requests then meet the
documents of their rarest item, and look up their other items there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.analysis import ANY_DOCUMENT
from trawl.session import stored

ANY_ITEM = -1
# So many first words of a phrase are looked for in one, and so many shapes of them, the most frequent
# ones; phrases of other shapes start from their rarest term.
SEED = 4
MOST_SHAPES = 32


def steps_hold(steps: str, present: str) -> str:
    """SQL for whether a request's postfix steps hold, given the ids of its items that are present."""
    last = "slice(stack, size(stack) - s.n + 1, s.n)"
    return f"""aggregate({steps}, cast(array() as array<boolean>), (stack, s) -> case s.op
        when 'item' then array_append(stack, array_contains({present}, s.n))
        else array_append(slice(stack, 1, size(stack) - s.n), case s.op
            when 'not' then not stack[size(stack) - 1]
            when 'and' then forall({last}, x -> x) else exists({last}, x -> x) end) end,
        stack -> stack[0])"""


def _spelled(terms: str) -> str:
    return f"array_join(transform({terms}, t -> concat(t.offset, ' ', t.term)), ' ')"


def decided(rows: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the requests ``rows`` and the documents they hold for.

    ``postings`` (term, doc_id, positions) has all requested terms, written, one row per document and
    term; ``counts`` (term, n) tells how many documents have a term.
    """
    any_item = f"""if(exists(groups, g -> array_contains(g, {ANY_ITEM})), array(named_struct('item_id', {ANY_ITEM},
        'terms', array(named_struct('offset', 0, 'term', '{ANY_DOCUMENT}')))), array())"""
    items = rows.selectExpr("query_id", f"inline(concat(items, {any_item}))").selectExpr(
        "query_id", "item_id", "terms", f"{_spelled('terms')} as item")
    items = stored(items, "items")
    hits = stored(_hits(items.select("item", "terms").dropDuplicates(["item"]), postings, counts), "hits")
    return _folded(rows, items.drop("terms"), hits)


def _hits(items: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, doc_id): every item and the documents that have it."""
    seeds = items.where("size(terms) > 1 and size(array_distinct(transform(terms, t -> t.offset))) = size(terms)").selectExpr(
        "item", "terms", f"transform(slice(terms, 1, {SEED}), t -> t.offset) as shape",
        f"{_spelled(f'slice(terms, 1, {SEED})')} as seed")
    shapes = [list(r["shape"]) for r in seeds.groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(MOST_SHAPES).collect()]
    if not shapes:
        return _term_hits(items, postings, counts)
    seeds = stored(seeds.where(F.col("shape").isin([F.lit(x) for x in shapes])), "seeds")
    texts = stored(_texts(postings), "requested-texts")
    met = stored(_sequences(texts.where("not twice"), shapes).join(seeds, "seed").select("item", "doc_id", "terms"), "seed-hits")
    found = met.where(f"size(terms) <= {SEED}").select("item", "doc_id")
    long = met.where(f"size(terms) > {SEED}")
    if not long.isEmpty():
        found = found.unionByName(_long_hits(long, postings))
    others = items.join(seeds.select("item"), "item", "left_anti")
    found = found.unionByName(_term_hits(others, postings, counts))
    twice = texts.where("twice").select("doc_id")
    if not twice.isEmpty():  # rows that share a key have several words at a place
        found = found.unionByName(_term_hits(seeds.select("item", "terms"), postings.join(twice, "doc_id", "left_semi"), counts))
    return found


def _texts(postings: DataFrame) -> DataFrame:
    """(doc_id, places, twice): each document's requested words by position, null for others between them."""
    words = "flatten(collect_list(transform(positions, p -> named_struct('pos', p, 'term', term))))"
    texts = postings.where(F.col("doc_id").isNotNull() & (F.col("term") != ANY_DOCUMENT)).groupBy("doc_id").agg(
        F.expr(f"sort_array({words})").alias("ws")).withColumn("twice", F.expr(
            "exists(sequence(1, size(ws)), i -> i < size(ws) and ws[greatest(i - 1, 0)].pos = ws[least(i, size(ws) - 1)].pos)"))
    gap = "w.pos - if(i = 0, w.pos, ws[greatest(i - 1, 0)].pos + 1)"
    places = f"flatten(transform(ws, (w, i) -> array_append(array_repeat(cast(null as string), {gap}), w.term)))"
    return texts.withColumn("places", F.expr(f"if(twice, null, {places})")).select("doc_id", "places", "twice")


def _sequences(texts: DataFrame, shapes: list[list[int]]) -> DataFrame:
    """(seed, doc_id): the words of each document that stand in one of the shapes, once per document."""
    def at(shape: list[int]) -> str:
        words = ", ' ', ".join(f"'{o} ', get(places, i + {o})" for o in shape)
        return f"array_distinct(array_compact(transform(places, (w, i) -> concat({words}))))"

    return texts.select("doc_id", F.explode(F.expr(f"flatten(array({', '.join(map(at, shapes))}))")).alias("seed"))


def _long_hits(met: DataFrame, postings: DataFrame) -> DataFrame:
    """(item, doc_id) of phrases longer than a seed, of documents that have their first words."""
    size = met.agg(F.max(F.size("terms"))).first()[0]
    starts = "transform(positions, p -> p - terms[{0}].offset)"
    open_ = met.withColumn("starts", F.lit(None).cast("array<int>"))
    done = None
    for k in range(size):
        held = open_.withColumn("term", F.expr(f"terms[{k}].term")).join(postings, ["doc_id", "term"]).selectExpr(
            "item", "doc_id", "terms", f"if(starts is null, {starts.format(k)}, array_intersect(starts, {starts.format(k)})) as starts")
        held = stored(held.where("size(starts) > 0"), "item-hits")
        ready = held.where(f"size(terms) = {k + 1}").select("item", "doc_id")
        done = ready if done is None else done.unionByName(ready)
        open_ = held.where(f"size(terms) > {k + 1}")
    return done


def _term_hits(items: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``_hits``, each item from the postings of its rarest term."""
    places = items.selectExpr("item", "inline(terms)").join(counts, "term").groupBy("item", "offset").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_set("term")).alias("terms"))
    order = F.expr("sort_array(collect_list(struct(n, offset, terms)))").alias("todo")
    # An item with a place whose words no document has lacks it after the join with the counts.
    known = places.groupBy("item").agg(order).join(items.selectExpr(
        "item", "size(array_distinct(transform(terms, t -> t.offset))) as _size"), "item").where("size(todo) = _size")
    known = stored(known.drop("_size"), "item-places")
    size = known.agg(F.coalesce(F.max(F.size("todo")), F.lit(0)), F.coalesce(F.max(F.expr(
        "exists(todo, t -> size(t.terms) > 1)")), F.lit(False))).first()
    starts = "transform(positions, p -> p - todo[{0}].offset)"
    found = known.withColumn("term", F.expr("explode(todo[0].terms)")).join(postings, "term").selectExpr(
        "item", "doc_id", "todo", f"{starts.format(0)} as starts")
    done = found.where("size(todo) = 1").select("item", "doc_id")
    open_ = found.where("size(todo) > 1")
    for k in range(1, size[0]):
        met = open_.withColumn("term", F.expr(f"explode(todo[{k}].terms)")).join(postings, ["doc_id", "term"]).selectExpr(
            "item", "doc_id", "todo", f"array_intersect(starts, {starts.format(k)}) as starts").where("size(starts) > 0")
        met = stored(met, "item-hits")
        done = done.unionByName(met.where(f"size(todo) = {k + 1}").select("item", "doc_id"))
        open_ = met.where(f"size(todo) > {k + 1}")
    return done.distinct() if size[1] else done


def _folded(rows: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests meet the documents of the rarest item of each of their groups, and are decided there."""
    n_hits = hits.groupBy("item").agg(F.count("*").alias("n"))
    counted = items.join(n_hits, "item", "left")
    groups = rows.selectExpr("query_id", "posexplode(groups) as (_group, g)").selectExpr(
        "query_id", "_group", "explode(g) as item_id")
    leads = groups.join(counted, ["query_id", "item_id"]).groupBy("query_id", "_group").agg(
        F.expr("min_by(item, struct(coalesce(n, 0) as n, item))").alias("item"))
    pairs = leads.select("query_id", "item").distinct().join(hits, "item").select("query_id", "doc_id").distinct()
    alone = rows.selectExpr("query_id", "size(items) = 1 and not exists(steps, s -> s.op = 'not') as _alone", "steps")
    met = stored(pairs.join(alone, "query_id"), "request-pairs")
    probes = met.where("not _alone").select("query_id", "doc_id").join(items, "query_id").join(
        hits.withColumn("_hit", F.lit(True)), ["item", "doc_id"], "left")
    present = probes.groupBy("query_id", "doc_id").agg(F.expr("collect_list(if(_hit, item_id, null))").alias("present"))
    folded = present.join(alone.select("query_id", "steps"), "query_id").where(steps_hold("steps", "present"))
    return met.where("_alone").select("query_id", "doc_id").unionByName(folded.select("query_id", "doc_id"))
