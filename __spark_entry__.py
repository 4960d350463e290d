
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trawl.functions import jsonb  # noqa: E402
from trawl.functions.analysis import STOP_WORDS  # noqa: E402
from trawl.operators import headline, json_search, match, postings, rank  # noqa: E402
from trawl.plans import display  # noqa: E402
from trawl.plans import requests as ask  # noqa: E402
from trawl.session import ship_package, spread, stored, work_folder  # noqa: E402
from trawl.sources import path_index, tables, term_index  # noqa: E402
from trawl.streaming.upkeep import keep_index  # noqa: E402

try:  # these two come and go together
    import corpus_pipeline
    from trawl.llm import queries as text_prep
except ImportError:
    corpus_pipeline = text_prep = None

TEXT = [("text", "D")]
TITLE_BODY = [("title", "A"), ("body", "B")]


# ---- inputs ---------------------------------------------------------------------------------

def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _arriving(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them: a stream takes a
    single file only as a pattern. Rows are dealt out to all cores, as ``spread`` does."""
    schema = _table(spark, sf, name).schema
    arriving = spark.readStream.schema(schema).options(**options).parquet(f"{sf}/{name}.parque[t]")
    return arriving.repartition(spark.sparkContext.defaultParallelism)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_table(spark, sf, "documents"))


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the first line as title and the rest as body."""
    title = F.substring_index("text", "\n", 1)
    return _docs(spark, sf).select(
        "doc_id", title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as semi-structured rows: (p_partkey, p_name, attrs)."""
    size = F.col("p_size")
    document = F.struct(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.when(size % 3 == 0, F.col("p_type")).alias("subcategory"),
        F.split("p_name", " ").alias("tags"),
        F.struct(size.alias("size"), F.col("p_retailprice").alias("price")).alias("specs"),
        (size > 25).alias("in_stock"),
        F.array(F.struct(F.lit("size").alias("k"), size.alias("n")),
                F.struct(F.lit("stars").alias("k"), (size % 5).alias("n"))).alias("marks"))
    return spread(_table(spark, sf, "part")).select(
        "p_partkey", "p_name", F.parse_json(F.to_json(document)).alias("attrs"))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as JSON in which an absent price is an explicit null."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    document = F.struct(F.struct(price.alias("price"), F.col("o_orderpriority").alias("level"))
                        .alias("terms"))
    text = F.to_json(document, {"ignoreNullFields": "false"})
    return spread(_table(spark, sf, "orders")).select("o_orderkey", F.parse_json(text).alias("v"))


def _ids(requests: ask.Requests, df: DataFrame, fields=TEXT) -> DataFrame:
    return match.matches(requests, match.Scan(df, "doc_id", fields))


def _search(kind, requests: dict, config: str = "simple") -> Callable:
    return lambda spark, sf: _ids(kind(spark, requests, config), _docs(spark, sf))


def _index(spark: SparkSession, df: DataFrame, fields=TEXT, config="simple"):
    index = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(fields), config, 16)
    term_index.build_term_index(df, index)
    return index


# ---- text -----------------------------------------------------------------------------------

STRICT_AND = {"and": "worthless & the"}
STRICT_OR = {"or": "worthless | pathetic | ingre"}
STRICT_NOT = {"not": "worthless & !pathetic", "pure": "!the", "neither": "!(the | la)"}
PHRASE = {"two": "thintion <-> ofonrereer", "common": "of <-> the", "word_twice": "the <-> the",
          "hyphen": "by-nc"}
NESTED = {"nested": "(worthless | pathetic) & !(ingre & the)",
          "phrase_or": "license <-> (version | agreement) | worthless <-> ingre"}
ALTERNATIVES = {"two": "(thintion | worthless) <-> (ofonrereer | ingre | the)", "three": "of <->\n(the | and) <-> (to | ingre)",
                "not": "license & !(under <-> (the | a))"}
PLAIN = {"plain": "Ingre, onanshat!", "hot": "the of and to"}
WEB = {"web": '"thintion ofonrereer" the', "exclude": "license -version -\"under the\"",
       "either": "worthless OR ingre the"}
ENGLISH = {"family": "license & !worthless", "stop": "the & handing", "phrase": "licensed <-> versions",
           "either": "hands | thanes"}
RANK_OR = {"r1": "worthless | license | ingre", "r2": "the"}
RANK_AND = {"r1": "license & version", "r2": "ingre & onanshat & the", "r3": "worthless & !ingre"}
HEADLINE = {"h1": "worthless OR license", "h2": "ingre onanshat"}


def _index_counts(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, _docs(spark, sf))
    return term_index.read_postings(spark, index).where("term <> ''").select(
        "term", "doc_id", F.concat_ws(",", "positions").alias("positions"))


def _postings_two_fields(spark: SparkSession, sf: str) -> DataFrame:
    return postings.text_postings(_articles(spark, sf), "doc_id", TITLE_BODY, "simple").select(
        "term", "doc_id", "weight", F.concat_ws(",", "positions").alias("positions"))


def _benchmark_requests(spark: SparkSession, sf: str) -> ask.Requests:
    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ask.plain(spark, items, "simple")


def _search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(_benchmark_requests(spark, sf), _docs(spark, sf))


def _search_counts(spark: SparkSession, sf: str) -> DataFrame:
    return match.counts(_benchmark_requests(spark, sf), _search_batch(spark, sf))


def _search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    requests = ask.web(spark, WEB, "simple")
    index = _index(spark, _docs(spark, sf))
    return match.matches(requests, match.Lookup(index))


def _search_two_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase may run from the last word of the title into the body."""
    return _ids(ask.strict(spark, PHRASE, "simple"), _articles(spark, sf), TITLE_BODY)


def _matching_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    found = _ids(ask.plain(spark, PLAIN, "simple"), docs)
    return match.matching_rows(docs, "doc_id", found).select("doc_id", "lang", "n_chars")


def _phrase_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of frequent words, from an index that has postings of pairs of these."""
    docs = _docs(spark, sf)
    frequent = postings.frequent_terms(docs, "doc_id", TEXT, "simple")
    index = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(TEXT), "simple", 16, frequent=frequent)
    term_index.build_term_index(docs, index)
    return match.matches(ask.strict(spark, PHRASE, "simple"), match.Lookup(index))


def _clustered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Matched rows with headlines out of a table that is clustered by its key."""
    path = work_folder(spark, "clustered")
    docs = _docs(spark, sf)
    tables.cluster_table(docs, path, "doc_id")
    held = tables.read_table(spark, path, docs.schema)
    requests = ask.web(spark, HEADLINE, "simple")
    found = match.matches(requests, match.Lookup(_index(spark, held)))
    shown = headline.headlines(requests, found, held, "doc_id", "text")
    rows = match.matching_rows(held, "doc_id", found).select("doc_id", "lang", "n_chars")
    return shown.join(rows, "doc_id").select("query_id", "doc_id", "lang", "n_chars", "headline")


def _english_indexed(spark: SparkSession, sf: str) -> DataFrame:
    requests = ask.strict(spark, ENGLISH, "english")
    index = _index(spark, _docs(spark, sf), config="english")
    return match.matches(requests, match.Lookup(index))


def _ranked(spark: SparkSession, sf: str, requests: dict) -> DataFrame:
    asked = ask.strict(spark, requests, "simple")
    corpus = match.Scan(_articles(spark, sf), "doc_id", TITLE_BODY)
    return rank.ranked(asked, corpus).withColumn("rank", F.round("rank", 6))


def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_k(_ranked(spark, sf, RANK_OR), 10).select(
        "query_id", "doc_id", "rank", F.col("place").cast("long").alias("place"))


def _best_first(spark: SparkSession, sf: str) -> DataFrame:
    """Search results as shown: id, title and rank to four places, best first."""
    scored = _ranked(spark, sf, RANK_AND)
    titled = scored.join(_articles(spark, sf).select("doc_id", "title"), "doc_id")
    return rank.best_first(titled).select(
        "query_id", "doc_id", "title", F.round("rank", 4).alias("rank"))


def _headline(spark: SparkSession, sf: str) -> DataFrame:
    requests, docs = ask.web(spark, HEADLINE, "simple"), _docs(spark, sf)
    return headline.headlines(requests, _ids(requests, docs), docs, "doc_id", "text")


# ---- JSON -----------------------------------------------------------------------------------

def _where(test: Callable, source: Callable = _products, key: str = "p_partkey",
           column: str = "attrs") -> Callable:
    return lambda spark, sf: source(spark, sf).where(test(column)).select(key).orderBy(key)


def _has(pattern) -> Callable:
    return _where(lambda v: jsonb.contains(v, pattern))


WITHIN = {"brand": "Brand#2", "category": "ECONOMY", "subcategory": "ECONOMY",
          "tags": ["ring", "red", "small"], "specs": {"size": 11, "price": 900, "weight": 1},
          "in_stock": False, "marks": [{"k": "stars", "n": 1}, {"k": "size", "n": 11.0}], "x": []}


WITHIN_SMALL = {"category": "ECONOMY", "tags": ["ring", "red", "small", "blue", "widget"],
                "marks": [{"k": "stars", "n": 1}, {"k": "stars", "n": 3.0}], "x": 1}


def _small_products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with few fields, so that a document contains several of them."""
    document = F.struct(F.col("p_type").alias("category"), F.split("p_name", " ").alias("tags"),
                        F.array(F.struct(F.lit("stars").alias("k"), (F.col("p_size") % 5).alias("n"))).alias("marks"))
    return spread(_table(spark, sf, "part")).select("p_partkey", F.parse_json(F.to_json(document)).alias("attrs"))


def _text_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes that are text in small parts and numbers in the others."""
    text = """concat('{"specs":{"size":', if(p_type = 'SMALL', concat('"', p_size, '"'), string(p_size)), '}}')"""
    return _table(spark, sf, "part").selectExpr("p_partkey", f"parse_json({text}) as attrs")


PATTERNS = {
    "brand": '{"brand":"Brand#2"}', "stock": '{"in_stock":true}', "number": '{"specs":{"size":11.0}}',
    "text_number": '{"specs":{"size":"11"}}', "tags": '{"tags":["red","bolt"]}',
    "one_element": '{"marks":[{"k":"stars","n":4}]}', "all": '{}', "array": "[]",
    "two": '{"category":"SMALL","tags":["red"],"in_stock":false}', "no_tags": '{"tags":[]}',
}


def _event_number(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = tables.split_bad_json(_table(spark, sf, "events"), "props", "v")
    return good.where(jsonb.contains("v", {"k": 69})).select("event_id")


def _json_reject(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties are JSON; documents are prose, also where they begin with a number."""
    texts = _table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text")).unionByName(
        _docs(spark, sf).select(F.col("doc_id").alias("id"), "text"))
    good, bad = tables.split_bad_json(texts, "text", "v")
    return good.select("id", F.lit("parsed").alias("outcome")).unionByName(
        bad.select("id", F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"))


def _load_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Loading with a default for absent JSON and rejects for rows that lack a required field."""
    events = _table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("props"))
    good, bad = tables.split_rejects(events, ["event_id", "kind"])
    read, broken = tables.split_bad_json(good, "props", "v", default='{"k": -1}')
    loaded = read.select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"), F.lit("loaded").alias("outcome"))
    return loaded.unionByName(bad.unionByName(broken).select(
        "event_id", F.lit(None).cast("long").alias("k"), F.lit("rejected").alias("outcome")))


def _stored_products(spark: SparkSession, sf: str) -> DataFrame:
    """The products in a declared table of variants, loaded once."""
    products = _products(spark, sf).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("attrs").alias("attributes"))
    target = work_folder(spark, "products")
    tables.create_table(spark, target, tables.PRODUCTS)
    tables.load_if_empty(products, target)
    return tables.read_table(spark, target, tables.PRODUCTS)


def _json_stored(spark: SparkSession, sf: str) -> DataFrame:
    stored_rows, v = _stored_products(spark, sf), "attributes"
    tests = {"scalar": jsonb.contains(v, {"brand": "Brand#2"}), "nested": jsonb.contains(v, {"specs": {"size": 11}}),
             "array": jsonb.contains(v, {"tags": ["red", "bolt"]}), "key": jsonb.has_key(v, "subcategory"),
             "keys": jsonb.has_all_keys(v, ["subcategory", "brand"]), "within": jsonb.contained_by(v, WITHIN)}
    found = [stored_rows.where(test).select(F.lit(name).alias("test"), "id") for name, test in tests.items()]
    return reduce(DataFrame.unionByName, found)


def _json_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Values under 70 levels of arrays, by pattern in a scan and in an index."""
    rows = spread(_table(spark, sf, "part")).selectExpr(
        "p_partkey", "parse_json(concat(repeat('[', 70), p_size, repeat(']', 70))) as v")
    wanted = json_search.patterns(spark, {str(n): "[" * 70 + str(n) + "]" * 70 for n in (3, 11, 99)})
    index = path_index.PathIndex(work_folder(spark, "deep"), "p_partkey", "v", 4)
    path_index.build_path_index(rows, index)
    scanned = json_search.json_matches(wanted, json_search.JsonScan(rows, "p_partkey", "v"))
    looked_up = json_search.json_matches(wanted, json_search.JsonLookup(index, rows))
    return scanned.withColumn("by", F.lit("scan")).unionByName(looked_up.withColumn("by", F.lit("index")))


LONG = "123456789012345678901234567890123456789012"


def _long_products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with an array of objects, one of them with a number of 42 digits."""
    text = f"""concat('{{"marks":[{{"k":"size","n":', p_size, '}},{{"k":"stars","n":', p_size % 5,
        '}},{{"k":"long","n":', if(p_size % 2 = 0, '{LONG}', '{LONG}0'), ',"tag":"', p_type, '"}}]}}')"""
    return spread(_table(spark, sf, "part")).selectExpr("p_partkey", f"parse_json({text}) as v")


OBJECTS = {
    "stars": '{"marks":[{"k":"stars","n":4}]}', "size": '{"marks":[{"n":11.0,"k":"size"}]}',
    "crossed": '{"marks":[{"k":"stars","n":11}]}', "both": '{"marks":[{"k":"size","n":11},{"k":"stars","n":1}]}',
    "long": f'{{"marks":[{{"k":"long","n":{LONG}}}]}}', "long_tag": f'{{"marks":[{{"n":{LONG}0,"tag":"SMALL"}}]}}',
}


def _json_batch_objects(spark: SparkSession, sf: str) -> DataFrame:
    products, wanted = _long_products(spark, sf), json_search.patterns(spark, OBJECTS)
    index = path_index.PathIndex(work_folder(spark, "marks"), "p_partkey", "v", 8)
    path_index.build_path_index(products, index)
    scanned = json_search.json_matches(wanted, json_search.JsonScan(products, "p_partkey", "v"))
    looked_up = json_search.json_matches(wanted, json_search.JsonLookup(index, products))
    return scanned.withColumn("by", F.lit("scan")).unionByName(looked_up.withColumn("by", F.lit("index")))


def _json_contained_by(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).where(jsonb.contained_by("v", {
        "terms": {"price": None, "level": "1-URGENT"}, "other": 1})).select("o_orderkey")


def _json_contained_by_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders within one document, through the path index."""
    orders = _priced(spark, sf)
    index = path_index.PathIndex(work_folder(spark, "orders"), "o_orderkey", "v", 8)
    path_index.build_path_index(orders, index)
    outer = json_search.containers(spark, {"urgent": '{"terms":{"price":null,"level":"1-URGENT"},"other":1}'})
    return json_search.json_matches(outer, json_search.JsonLookup(index, orders))


def _json_contained_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One document for each category found in the table, by scan and by index."""
    products = _small_products(spark, sf)
    kinds = _table(spark, sf, "part").select(F.col("p_type").alias("query_id")).distinct()
    marks = F.expr("""array(named_struct('k', 'stars', 'n', 1), named_struct('k', 'stars', 'n', 3))""")
    outer = kinds.select("query_id", F.to_json(F.struct(
        F.col("query_id").alias("category"), F.array(*map(F.lit, WITHIN_SMALL["tags"])).alias("tags"),
        marks.alias("marks"), F.lit(1).alias("x"))).alias("pattern"))
    index = path_index.PathIndex(work_folder(spark, "small"), "p_partkey", "attrs", 8)
    path_index.build_path_index(products, index)
    asked = json_search.containers(spark, outer)
    scanned = json_search.json_matches(asked, json_search.JsonScan(products, "p_partkey", "attrs"))
    looked_up = json_search.json_matches(asked, json_search.JsonLookup(index, products))
    return scanned.withColumn("by", F.lit("scan")).unionByName(looked_up.withColumn("by", F.lit("index")))


def _path_index(spark: SparkSession, products: DataFrame) -> path_index.PathIndex:
    index = path_index.PathIndex(work_folder(spark, "paths"), "p_partkey", "attrs", 16)
    path_index.build_path_index(products, index)
    return index


def _json_path_index(spark: SparkSession, sf: str) -> DataFrame:
    index = _path_index(spark, _products(spark, sf))
    return path_index.read_entries(spark, index).where("path <> ''").groupBy(
        "path", "vtype", "value").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("rows"))


def _json_batch(indexed: bool) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        products = _products(spark, sf)
        wanted = json_search.patterns(spark, PATTERNS)
        corpus = json_search.JsonScan(products, "p_partkey", "attrs")
        if indexed:
            corpus = json_search.JsonLookup(_path_index(spark, products), products)
        return json_search.json_matches(wanted, corpus)

    return run


def _json_batch_table(spark: SparkSession, sf: str) -> DataFrame:
    """One pattern per (brand, category) found in the table."""
    pairs = _table(spark, sf, "part").select("p_brand", "p_type").distinct().select(
        F.concat_ws("/", "p_brand", "p_type").alias("query_id"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")))
        .alias("pattern"))
    products = _products(spark, sf)
    return json_search.json_matches(json_search.patterns(spark, pairs),
                                    json_search.JsonScan(products, "p_partkey", "attrs"))


def _json_keys(spark: SparkSession, sf: str) -> DataFrame:
    products = _products(spark, sf)
    corpus = json_search.JsonLookup(_path_index(spark, products), products)
    found = [json_search.json_matches(json_search.keys(
        spark, {name: ["subcategory", "brand"], f"{name}_rare": ["subcategory", "absent"]},
        all_of), corpus) for name, all_of in (("any", False), ("all", True))]
    return found[0].unionByName(found[1])


def _json_fields(spark: SparkSession, sf: str) -> DataFrame:
    v = "attrs"
    return _products(spark, sf).select(
        "p_partkey", jsonb.field(v, "brand").alias("brand"),
        jsonb.field(v, "subcategory").alias("subcategory"),
        jsonb.mark(v, "in_stock").alias("stock"), jsonb.mark(v, "absent").alias("absent"))


def _json_names(spark: SparkSession, sf: str) -> DataFrame:
    products = _products(spark, sf)
    wanted = json_search.patterns(spark, PATTERNS)
    found = json_search.json_matches(wanted, json_search.JsonScan(products, "p_partkey", "attrs"))
    lists = json_search.name_lists(found, products, "p_partkey", "p_name", 500)
    return lists.select("query_id", "chunk", F.concat_ws(",", "names").alias("names"))


def _json_name_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each pattern's rows as one list."""
    products = _products(spark, sf)
    found = json_search.json_matches(json_search.patterns(spark, PATTERNS),
                                     json_search.JsonScan(products, "p_partkey", "attrs"))
    lists = json_search.name_lists(found, products, "p_partkey", "p_name")
    return lists.select("query_id", F.concat_ws(",", "names").alias("names"))


def _plan_facts(plan: DataFrame, name: str, bucket: str) -> DataFrame:
    """Whether an index is read by its buckets, with the entry filter pushed into the files."""
    return display.plan_scans(plan).select(
        F.lit(name).alias("plan"), F.col("partition_filters").contains(bucket).alias("buckets_pruned"),
        F.col("pushed_filters").rlike("(In|EqualTo)\\((term|path),").alias("entry_pushed")).where(
        "buckets_pruned").distinct()


def _plan_display(spark: SparkSession, sf: str) -> DataFrame:
    """What the plans of a text and of a JSON lookup read."""
    terms = match.matches(ask.plain(spark, {"one": "worthless"}, "simple"), match.Lookup(_index(spark, _docs(spark, sf))))
    products = _products(spark, sf)
    paths = json_search.json_matches(json_search.patterns(spark, {"one": '{"brand":"Brand#2"}'}),
                                     json_search.JsonLookup(_path_index(spark, products), products))
    return _plan_facts(terms, "terms", "term_bucket").unionByName(_plan_facts(paths, "paths", "path_bucket"))


# ---- loading and upkeep ---------------------------------------------------------------------

def _load_new(spark: SparkSession, sf: str) -> DataFrame:
    orders, target = _table(spark, sf, "orders"), work_folder(spark, "orders")
    tables.load_new(orders.where("o_orderstatus = 'O'"), target, "o_orderkey")
    tables.load_new(orders, target, "o_orderkey")
    return tables.read_table(spark, target, orders.schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


def _load_if_empty(spark: SparkSession, sf: str) -> DataFrame:
    part, target = _table(spark, sf, "part"), work_folder(spark, "part")
    tables.create_table(spark, target, part.schema)
    tables.load_if_empty(part, target)
    tables.load_if_empty(part, target)
    return tables.read_table(spark, target, part.schema).groupBy("p_brand").agg(
        F.count("*").alias("n"))


def _index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """French texts change and German ones arrive after the first build."""
    docs = _docs(spark, sf)
    old = docs.where("lang <> 'de'").withColumn(
        "text", F.when(F.col("lang") == "fr", F.upper("source")).otherwise(F.col("text")))
    index = _index(spark, old)
    term_index.refresh_term_index(docs.where("lang = 'fr'"), index)
    term_index.refresh_term_index(docs.where("lang = 'de'"), index)
    requests = ask.strict(spark, {"fr": "la & des", "de": "der & die", "src": "src0 | src3",
                                  "not": "!la"}, "simple")
    return match.matches(requests, match.Lookup(index))


def _index_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as a stream and are searched in the index it keeps."""
    stream = _arriving(spark, sf, "documents")
    index = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(TEXT), "simple", 16)
    keep_index(stream, index, work_folder(spark, "stream"), availableNow=True).awaitTermination()
    requests = ask.plain(spark, PLAIN, "simple")
    return match.matches(requests, match.Lookup(index))


def _sync(spark: SparkSession, sf: str, compacted: bool = False) -> DataFrame:
    """Titles and bodies change, move and arrive, a source goes, and the index is brought up to date."""
    now = _articles(spark, sf)
    old = _docs(spark, sf).where("lang <> 'de'").select("doc_id", "lang", "source").join(now, "doc_id").select(
        "doc_id", F.when(F.col("lang") == "fr", F.col("source")).when(F.col("lang") == "es", F.col("body"))
        .otherwise(F.col("title")).alias("title"),
        F.when(F.col("lang") != "es", F.col("body")).alias("body"))
    kept = now.join(_docs(spark, sf).where("source <> 'src7'").select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("title")).alias("title"),
        F.when(F.col("lang") == "es", F.concat_ws(" ", "title", "body")).otherwise(F.col("body")).alias("body"))
    index = _index(spark, old, TITLE_BODY)
    term_index.sync_term_index(kept, index)
    if compacted:
        target = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(TITLE_BODY), "simple", 8)
        term_index.compact_term_index(spark, index, target)
        index = target
    return match.matches(ask.strict(spark, SYNC, "simple"), match.Lookup(index))


SYNC = {"fr": "la & des", "de": "der & die", "es": "que | de", "src": "src0 | src3", "not": "!la & !of"}


def _updates(sf: str, spark: SparkSession, files: int):
    """Documents as a stream with two versions of each in one batch, the older one last."""
    stream = _arriving(spark, sf, "documents", maxFilesPerTrigger=files)
    versions = F.array(F.struct(F.lit(2).alias("version"), F.col("text").alias("t")),
                       F.struct(F.lit(1).alias("version"), F.col("source").alias("t")))
    return stream.select("doc_id", "lang", "source", F.explode(versions).alias("v")).select(
        "doc_id", "lang", "source", F.col("v.version").alias("version"), F.col("v.t").alias("text"))


def _index_stream_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams keep one index: all documents, then newer French ones with their source as text."""
    index = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(TEXT), "simple", 16)
    first, second = _updates(sf, spark, 1), _updates(sf, spark, 1).where("lang = 'fr'").withColumn(
        "version", 5 - F.col("version"))
    for stream in (first, second):
        keep_index(stream, index, work_folder(spark, "stream"), "version", availableNow=True).awaitTermination()
    return match.matches(ask.strict(spark, {"fr": "la & des", "de": "der & die", "src": "src0 | src3",
                                            "not": "!la"}, "simple"), match.Lookup(index))


def _index_stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Old versions of all documents come late, and newer ones of the French."""
    index = term_index.TermIndex(work_folder(spark, "terms"), "doc_id", tuple(TEXT), "simple", 16)
    docs = _docs(spark, sf).withColumn("version", F.lit(2))
    term_index.build_term_index(docs, index, "version")
    late = _arriving(spark, sf, "documents").withColumn("version", F.when(F.col("lang") == "fr", 3).otherwise(1)).withColumn("text", F.col("source"))
    keep_index(late, index, work_folder(spark, "stream"), "version", availableNow=True).awaitTermination()
    return match.matches(ask.strict(spark, {"fr": "la & des", "de": "der & die", "src": "src0 | src3",
                                            "not": "!la"}, "simple"), match.Lookup(index))


def _path_upkeep(stream: bool) -> Callable:
    """Orders change their price, arrive and go in a path index."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        now = _priced(spark, sf)
        orders = _table(spark, sf, "orders")
        index = path_index.PathIndex(work_folder(spark, "orders"), "o_orderkey", "v", 8)
        status = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
        before = now.join(status.where("o_orderstatus <> 'O'"), "o_orderkey").withColumn("v", F.expr(
            "if(o_orderstatus = 'F', parse_json('{\"terms\":{\"level\":\"old\"}}'), v)")).select("o_orderkey", "v")
        path_index.build_path_index(before, index)
        if stream:
            rows = _arriving(spark, sf, "orders")
            document = F.struct(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
                                         F.col("o_orderpriority").alias("level")).alias("terms"))
            changed = rows.where("o_orderstatus <> 'P'").select("o_orderkey", F.parse_json(F.to_json(
                document, {"ignoreNullFields": "false"})).alias("v"))
            keep_index(changed, index, work_folder(spark, "stream"), availableNow=True).awaitTermination()
        else:
            arrived, kept = (status.where(test).select("o_orderkey") for test in (
                "o_orderstatus = 'O'", "o_orderpriority <> '5-LOW'"))
            path_index.refresh_path_index(now.join(arrived, "o_orderkey", "left_semi"), index)
            path_index.sync_path_index(now.join(kept, "o_orderkey", "left_semi"), index)
        wanted = json_search.patterns(spark, {"urgent": '{"terms":{"level":"1-URGENT"}}', "old": '{"terms":{"level":"old"}}',
                                              "low": '{"terms":{"level":"5-LOW"}}',
                                              "none": '{"terms":{"price":null,"level":"2-HIGH"}}'})
        return json_search.json_matches(wanted, json_search.JsonLookup(index, now))

    return run


def _rank_indexed(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, _articles(spark, sf), TITLE_BODY)
    scored = rank.ranked(ask.strict(spark, RANK_OR, "simple"), match.Lookup(index))
    return scored.withColumn("rank", F.round("rank", 6))


WEB_RANKED = {"family": "licensing OR worthless", "named": "licenses the"}


def _web_ranked_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The main search: a stored English index of titles and bodies, ranked, with headlines."""
    articles = _articles(spark, sf)
    index = _index(spark, articles, TITLE_BODY, "english")
    requests = ask.web(spark, WEB_RANKED, "english")
    scored = stored(rank.ranked(requests, match.Lookup(index)).withColumn("rank", F.round("rank", 6)), "scored")
    shown = headline.headlines(requests, scored, articles, "doc_id", "body")
    return scored.join(shown, ["query_id", "doc_id"]).join(articles.select("doc_id", "title"), "doc_id").select(
        "query_id", "doc_id", "title", "rank", "headline")


def _postings_english(spark: SparkSession, sf: str) -> DataFrame:
    """English postings of the license family: stop words leave gaps, the body goes on after the title."""
    found = postings.text_postings(_articles(spark, sf), "doc_id", TITLE_BODY, "english")
    return found.where("term in ('licens', 'version')").select(
        "term", "doc_id", "weight", F.concat_ws(",", "positions").alias("positions"))


def _postings_english_all(spark: SparkSession, sf: str) -> DataFrame:
    """All English postings of titles and bodies; without SQL, as SQL has no stems."""
    found = postings.text_postings(_articles(spark, sf), "doc_id", TITLE_BODY, "english")
    return found.select("term", "doc_id", "weight", F.concat_ws(",", "positions").alias("positions"))


def _positions_english(spark: SparkSession, sf: str) -> DataFrame:
    """Where English postings of all titles and bodies are, whatever their stems."""
    found = postings.text_postings(_articles(spark, sf), "doc_id", TITLE_BODY, "english")
    return found.select("doc_id", "weight", F.explode("positions").alias("pos"))


def _phrase_requests(spark: SparkSession, sf: str) -> ask.Requests:
    """Ten phrases of three words out of every document: many thousands of requests."""
    words = F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)")
    starts = F.explode(F.expr("transform(sequence(0, 9), k -> 5 * k)"))
    phrases = _docs(spark, sf).select(words.alias("ws")).select("ws", starts.alias("at")).where(
        "at + 2 < size(ws)").select(F.expr("concat(ws[at], ' ', ws[at + 1], ' ', ws[at + 2])").alias("query_id")).distinct()
    return ask.web(spark, phrases.select("query_id", F.expr("""concat('"', query_id, '"')""").alias("text")), "simple")


def _search_batch_large(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(_phrase_requests(spark, sf), _docs(spark, sf))


def _json_batch_large(spark: SparkSession, sf: str) -> DataFrame:
    """One pattern for the customer and price of every order that has a price."""
    orders = _table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    document = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.struct(
        F.col("o_totalprice").alias("price")).alias("terms")))
    wanted = orders.select(F.col("o_orderkey").alias("query_id"), document.alias("pattern"))
    rows = _table(spark, sf, "orders").select("o_orderkey", F.parse_json(document).alias("v"))
    return json_search.json_matches(json_search.patterns(spark, wanted),
                                    json_search.JsonScan(rows, "o_orderkey", "v"))


def _search_strict_table(spark: SparkSession, sf: str) -> DataFrame:
    """Strict requests made of benchmark items: the first word, with the second or without the third."""
    items = _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)").alias("ws"))
    asked = items.where("size(ws) > 2").select(
        "query_id", F.expr("concat(ws[0], ' & (', ws[1], ' | !', ws[2], ')')").alias("text"))
    return _ids(ask.strict(spark, asked, "simple"), _docs(spark, sf))


def _json_keys_table(spark: SparkSession, sf: str) -> DataFrame:
    """Key requests from a table: for every brand, keys that depend on its number."""
    brands = _table(spark, sf, "part").select("p_brand").distinct()
    asked = brands.select(F.col("p_brand").alias("query_id"), F.expr(
        "if(length(p_brand) > 7, array('subcategory', 'brand'), array('absent', 'tags'))").alias("keys"))
    products = _products(spark, sf)
    return json_search.json_matches(json_search.keys(spark, asked, True),
                                    json_search.JsonScan(products, "p_partkey", "attrs"))


# ---- contract -------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Web-style requests over whole articles, ranked, the best ten each with a headline."""
    sf = "/root/testdata/sf0.001"
    requests, articles = ask.web(spark, WEB | HEADLINE, "english"), _articles(spark, sf)
    corpus = match.Scan(articles, "doc_id", TITLE_BODY)
    best = rank.top_k(rank.ranked(requests, corpus), 10)
    shown = headline.headlines(requests, best, articles, "doc_id", "body")
    return best.join(shown, ["query_id", "doc_id"]).join(
        articles.select("doc_id", "title"), "doc_id").select(
        "query_id", "place", "doc_id", "title", F.round("rank", 4).alias("rank"), "headline")


def _search_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "text_tokens": lambda spark, sf: postings.text_tokens(_docs(spark, sf), "doc_id", "text"),
        "text_postings_two_fields": _postings_two_fields,
        "term_index": _index_counts,
        "search_and": _search(ask.strict, STRICT_AND),
        "search_or": _search(ask.strict, STRICT_OR),
        "search_not": _search(ask.strict, STRICT_NOT),
        "search_phrase": _search(ask.strict, PHRASE),
        "search_strict": _search(ask.strict, NESTED),
        "search_plain": _search(ask.plain, PLAIN),
        "search_web": _search(ask.web, WEB),
        "search_two_fields": _search_two_fields,
        "search_batch": _search_batch,
        "search_counts": _search_counts,
        "search_indexed": _search_indexed,
        "search_rows": _matching_rows,
        "search_english": _search(ask.strict, ENGLISH, "english"),
        "search_english_indexed": _english_indexed,
        "rank_or": lambda spark, sf: _ranked(spark, sf, RANK_OR),
        "rank_and": lambda spark, sf: _ranked(spark, sf, RANK_AND),
        "rank_order": _best_first,
        "topk": _top_k,
        "headline": _headline,
        "json_scalar": _has({"brand": "Brand#2"}),
        "json_bool": _has({"in_stock": False}),
        "json_number": _has({"specs": {"size": 11}}),
        "json_number_text": _where(lambda v: jsonb.contains(v, {"specs": {"size": "11"}}), _text_sizes),
        "json_null": _where(lambda v: jsonb.contains(v, '{"terms":{"price":null}}'), _priced,
                            "o_orderkey", "v"),
        "json_multi": _has({"brand": "Brand#2", "category": "SMALL"}),
        "json_nested": _has({"category": "SMALL", "specs": {"size": 30}}),
        "json_array": _has({"tags": ["red"]}),
        "json_array_all": _has({"tags": ["bolt", "red"]}),
        "json_array_objects": _has({"marks": [{"k": "stars", "n": 4}]}),
        "json_event_number": _event_number,
        "json_reject": _json_reject,
        "json_key": _where(lambda v: jsonb.has_key(v, "subcategory")),
        "json_key_any": _where(lambda v: jsonb.has_any_key(v, ["subcategory", "absent"])),
        "json_key_all": _where(lambda v: jsonb.has_all_keys(v, ["brand", "subcategory"])),
        "json_contained_by": _json_contained_by,
        "json_contained_by_parts": _where(lambda v: jsonb.contained_by(v, WITHIN_SMALL), _small_products),
        "json_path_index": _json_path_index,
        "json_batch": _json_batch(False),
        "json_batch_indexed": _json_batch(True),
        "json_batch_table": _json_batch_table,
        "json_keys_indexed": _json_keys,
        "json_fields": _json_fields,
        "json_names": _json_names,
        "load_new": _load_new,
        "load_if_empty": _load_if_empty,
        "index_refresh": _index_refresh,
        "index_stream": _index_stream,
        "index_sync": _sync,
        "index_compacted": lambda spark, sf: _sync(spark, sf, compacted=True),
        "index_stream_updates": _index_stream_updates,
        "path_index_refresh": _path_upkeep(stream=False),
        "path_index_stream": _path_upkeep(stream=True),
        "rank_indexed": _rank_indexed,
        "search_web_ranked_indexed": _web_ranked_indexed,
        "text_postings_english": _postings_english,
        "search_batch_large": _search_batch_large,
        "json_batch_large": _json_batch_large,
        "search_strict_table": _search_strict_table,
        "json_keys_table": _json_keys_table,
        "load_rejects": _load_rejects,
        "json_stored": _json_stored,
        "json_deep": _json_deep,
        "json_batch_objects": _json_batch_objects,
        "json_contained_by_indexed": _json_contained_by_indexed,
        "json_contained_by_batch": _json_contained_by_batch,
        "json_name_lists": _json_name_lists,
        "index_stream_late": _index_stream_late,
        "text_positions_english": _positions_english,
        "plan_display": _plan_display,
        "search_rows_clustered": _clustered_rows,
        "search_phrase_pairs": _phrase_pairs,
        "search_alternatives": _search(ask.strict, ALTERNATIVES),
    }


def _word_list(text: str) -> str:
    return (f"flatten(list_transform(regexp_extract_all(lower({text}), "
            r"'[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'), lambda w: CASE WHEN contains(w, '-') "
            "THEN list_concat([w], string_split(w, '-')) ELSE [w] END))")


# Each document's words, and the words one per row.
WORDS = f"words AS (SELECT doc_id, {_word_list('text')} AS ws FROM documents)"
TOKENS = f"""{WORDS}, tokens AS (
    SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM words)"""
SPLIT = r"""articles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)"""
WEIGHTED = f"""{SPLIT}, words AS (SELECT doc_id, {_word_list('title')} AS tw,
    {_word_list('body')} AS bw FROM articles), tokens AS (
    SELECT doc_id, unnest(tw) AS term, generate_subscripts(tw, 1) AS pos, 'A' AS weight,
        1.0::DOUBLE AS w FROM words UNION ALL
    SELECT doc_id, unnest(bw), len(tw) + generate_subscripts(bw, 1), 'B', 0.4::DOUBLE
        FROM words)"""


def _any_of(tests: dict[str, str], source: str = "words") -> str:
    return " UNION ALL ".join(
        f"SELECT '{q}' AS query_id, doc_id FROM {source} WHERE {test}" for q, test in tests.items())


def _has_word(*words: str) -> str:
    return " AND ".join(f"list_contains(ws, '{w}')" for w in words)


def _has_phrase(*words: str) -> str:
    joins = "".join(f" JOIN tokens t{n} ON t{n}.doc_id = t0.doc_id AND t{n}.pos = t0.pos + {n} "
                    f"AND t{n}.term = '{w}'" for n, w in enumerate(words) if n)
    return f"doc_id IN (SELECT t0.doc_id FROM tokens t0{joins} WHERE t0.term = '{words[0]}')"


def _family(*forms: str) -> str:
    return f"list_has_any(ws, [{', '.join(repr(f) for f in forms)}])"


# Texts after the sync: Spanish titles have moved into the body, one source is gone.
SYNCED = f"""words AS (SELECT doc_id, {_word_list('text')} AS ws FROM documents WHERE source <> 'src7')"""
SYNC_SQL = {"fr": _has_word("la", "des"), "de": _has_word("der", "die"), "es": "list_has_any(ws, ['que', 'de'])",
            "src": "list_has_any(ws, ['src0', 'src3'])", "not": f"NOT {_has_word('la')} AND NOT {_has_word('of')}"}
STREAMED = f"""words AS (SELECT doc_id, {_word_list("CASE WHEN lang = 'fr' THEN source ELSE text END")} AS ws
    FROM documents)"""
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
# English tokens: positions count stop words, a body goes on after its title's last kept word.
ENGLISH_TOKENS = f"""{SPLIT}, words AS (SELECT doc_id, {_word_list('title')} AS tw, {_word_list('body')} AS bw
        FROM articles), titles AS (SELECT doc_id, unnest(tw) AS raw, generate_subscripts(tw, 1) AS pos FROM words),
    kept AS (SELECT * FROM titles WHERE raw NOT IN ({STOPS})),
    ends AS (SELECT doc_id, max(pos) AS title_end FROM kept GROUP BY doc_id),
    bodies AS (SELECT words.doc_id, unnest(bw) AS raw,
        generate_subscripts(bw, 1) AS body_pos FROM words),
    raws AS (SELECT doc_id, raw, pos, 'A' AS weight, 1.0::DOUBLE AS w FROM kept UNION ALL
        SELECT doc_id, raw, body_pos + coalesce(title_end, 0), 'B', 0.4::DOUBLE
        FROM bodies LEFT JOIN ends USING (doc_id) WHERE raw NOT IN ({STOPS})),
    tokens AS (SELECT doc_id, pos, weight, w, CASE WHEN raw IN ('license', 'licenses', 'licensed', 'licensing')
        THEN 'licens' WHEN raw IN ('version', 'versions') THEN 'version'
        WHEN raw IN ('worthless', 'worthlessly') THEN 'worthless' ELSE '' END AS term FROM raws)"""

PLAIN_SQL = {"plain": _has_word("ingre", "onanshat"), "hot": _has_word("the", "of", "and", "to")}
WEB_SQL = {
    "web": f"{_has_phrase('thintion', 'ofonrereer')} AND {_has_word('the')}",
    "exclude": f"{_has_word('license')} AND NOT {_has_word('version')} "
               f"AND NOT {_has_phrase('under', 'the')}",
    "either": f"{_has_word('worthless')} OR ({_has_word('ingre', 'the')})",
}
PHRASE_SQL = {"two": _has_phrase("thintion", "ofonrereer"), "common": _has_phrase("of", "the"),
              "word_twice": _has_phrase("the", "the"), "hyphen": _has_phrase("by-nc", "by", "nc")}
LICENSE = _family("license", "licenses", "licensed", "licensing")
ENGLISH_SQL = {
    "family": f"{LICENSE} AND NOT {_family('worthless', 'worthlessly', 'worthlessness')}",
    "stop": _family("hand", "hands", "handed", "handing", "handly", "handes", "handedly"),
    "phrase": "doc_id IN (SELECT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id "
              "AND b.pos = a.pos + 1 WHERE a.term IN ('license', 'licenses', 'licensed', "
              "'licensing') AND b.term IN ('version', 'versions'))",
    "either": _family("hand", "hands", "handed", "handing", "handly", "handes", "handedly",
                      "thane", "thanes", "thaned", "thaning", "thanedly", "thaningly"),
}
OR_RANK = """o AS (SELECT query_id, n, doc_id, term, w, row_number() OVER (
        PARTITION BY query_id, doc_id, term ORDER BY pos) AS j FROM tokens JOIN asked USING (term)),
    m AS (SELECT query_id, doc_id, term, max(w) AS best FROM o GROUP BY ALL),
    s AS (SELECT query_id, o.n, doc_id, term, best, min(j) FILTER (w = best) AS jm,
        sum(w / (j * j)) AS damped FROM o JOIN m USING (query_id, doc_id, term) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, round(sum((best + damped - best / (jm * jm))
        / 1.64493406685) / any_value(n), 6) AS rank FROM s GROUP BY query_id, doc_id)"""
OR_ASKED = """asked AS (SELECT * FROM (VALUES ('r1', 'worthless', 3), ('r1', 'license', 3),
    ('r1', 'ingre', 3), ('r2', 'the', 1)) AS t(query_id, term, n))"""
AND_RANK = """asked AS (SELECT * FROM (VALUES ('r1', 'license', 2), ('r1', 'version', 2),
        ('r2', 'ingre', 3), ('r2', 'onanshat', 3), ('r2', 'the', 3)) AS t(query_id, term, n)),
    o AS (SELECT query_id, n, doc_id, term, pos, w FROM tokens JOIN asked USING (term)),
    holds AS (SELECT query_id, doc_id FROM o GROUP BY ALL
        HAVING count(DISTINCT term) = any_value(n)),
    pairs AS (SELECT a.query_id, a.doc_id, abs(a.pos - b.pos) AS d, a.w * b.w AS ww
        FROM o a JOIN o b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.term < b.term),
    scored AS (SELECT query_id, doc_id, round(1 - exp(sum(ln(1 - sqrt(ww * CASE WHEN d > 100
        THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))), 6) AS rank
        FROM pairs JOIN holds USING (query_id, doc_id) GROUP BY ALL
        UNION ALL SELECT 'r3', doc_id, 0.0 FROM (SELECT doc_id FROM tokens GROUP BY doc_id
            HAVING bool_or(term = 'worthless') AND NOT bool_or(term = 'ingre')))"""


def _headline_sql() -> str:
    cases = {"h1": (["worthless", "license"], "list_has_any(ls, ['worthless', 'license'])"),
             "h2": (["ingre", "onanshat"], "list_has_all(ls, ['ingre', 'onanshat'])")}
    found = " UNION ALL ".join(f"SELECT '{q}' AS query_id, doc_id, {terms!r} AS terms, ls, rs, gs "
                               f"FROM raw WHERE {test}" for q, (terms, test) in cases.items())
    return rf"""WITH raw AS (SELECT doc_id,
            regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ls,
            regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)([^\p{{L}}\p{{N}}]*)', 1) AS rs,
            regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)([^\p{{L}}\p{{N}}]*)', 2) AS gs
            FROM documents),
        found AS ({found}),
        starts AS (SELECT *, unnest(list_filter(range(1, len(ls) + 1),
            lambda i: list_contains(terms, ls[i]))) AS hit FROM found),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY
            len(list_distinct(list_filter(ls[hit:hit + 14], lambda t: list_contains(terms, t)))) DESC,
            hit) AS place FROM starts),
        spans AS (SELECT *, greatest(least(hit, len(ls) - 4), 1) AS first FROM best
            WHERE place = 1)
        SELECT query_id, doc_id, array_to_string(list_transform(
            range(first, least(first + 15, len(ls) + 1)), lambda i:
            (CASE WHEN list_contains(terms, ls[i]) THEN '>>>' || rs[i] || '<<<' ELSE rs[i] END)
            || (CASE WHEN i < least(first + 14, len(ls)) THEN gs[i] ELSE '' END)), '') AS headline
        FROM spans"""


TAGS = "string_split(p_name, ' ')"
PART_TESTS = {
    "brand": "p_brand = 'Brand#2'", "stock": "p_size > 25", "number": "p_size = 11",
    "text_number": "false", "tags": f"list_has_all({TAGS}, ['red', 'bolt'])",
    "one_element": "p_size % 5 = 4", "all": "true", "array": "false",
    "two": f"p_type = 'SMALL' AND list_contains({TAGS}, 'red') AND p_size <= 25",
    "no_tags": "true",
}
TAGS_WITHIN = f"len(list_filter({TAGS}, lambda t: NOT list_contains(['ring', 'red', 'small'], t))) = 0"
WITHIN_TEST = "p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size = 11 AND p_retailprice = 900 " \
              f"AND {TAGS_WITHIN}"
JSON_BATCH = " UNION ALL ".join(f"SELECT '{q}' AS query_id, p_partkey AS row_id FROM part "
                                f"WHERE {test}" for q, test in PART_TESTS.items())


def _parts(test: str) -> str:
    return f"SELECT p_partkey FROM part WHERE {test}"


def _orders_sql(kept: str) -> str:
    wanted = {"urgent": "o_orderpriority = '1-URGENT'", "low": "o_orderpriority = '5-LOW'",
              "none": "o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'"}
    return " UNION ALL ".join(f"SELECT '{q}' AS query_id, o_orderkey AS row_id FROM orders WHERE {test} AND {kept}"
                              for q, test in wanted.items())


def _web_ranked_sql() -> str:
    """Ranks by the formula for alternatives, headlines by that for excerpts, over English words."""
    family = "['license', 'licenses', 'licensed', 'licensing']"
    asked = """asked AS (SELECT * FROM (VALUES ('family', 'licens', 2), ('family', 'worthless', 2),
        ('named', 'licens', 1)) AS t(query_id, term, n))"""
    return rf"""WITH {ENGLISH_TOKENS}, {asked}, {OR_RANK},
        raw AS (SELECT doc_id, title, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS ls,
            regexp_extract_all(body, '([\p{{L}}\p{{N}}]+)([^\p{{L}}\p{{N}}]*)', 1) AS rs,
            regexp_extract_all(body, '([\p{{L}}\p{{N}}]+)([^\p{{L}}\p{{N}}]*)', 2) AS gs FROM articles),
        found AS (SELECT scored.query_id, doc_id, rank, title, rs, gs, list_transform(ls, lambda w:
            CASE WHEN list_contains({family}, w) THEN 'licens'
            WHEN scored.query_id = 'family' AND w IN ('worthless', 'worthlessly') THEN 'worthless' ELSE '' END) AS ls
            FROM scored JOIN raw USING (doc_id)),
        best AS (SELECT *, list_sort(list_transform(list_filter(range(1, len(ls) + 1), lambda i: ls[i] <> ''),
            lambda i: {{'n': -len(list_distinct(list_filter(ls[i:i + 14], lambda t: t <> ''))), 'at': i}}))[1] AS b
            FROM found),
        spans AS (SELECT *, CASE WHEN b IS NULL THEN 1 ELSE greatest(least(b['at'], len(ls) - 4), 1) END AS first,
            CASE WHEN b IS NULL THEN 5 ELSE 15 END AS n FROM best)
        SELECT query_id, doc_id, title, rank, CASE WHEN len(ls) = 0 THEN '' ELSE array_to_string(list_transform(
            range(first, least(first + n, len(ls) + 1)), lambda i:
            (CASE WHEN ls[i] <> '' THEN '>>>' || rs[i] || '<<<' ELSE rs[i] END)
            || (CASE WHEN i < least(first + n - 1, len(ls)) THEN gs[i] ELSE '' END)), '') END AS headline
        FROM spans"""


def _search_sql() -> dict[str, str]:
    return {
        "text_tokens": f"WITH {TOKENS} SELECT doc_id, pos, term FROM tokens",
        "text_postings_two_fields": f"""WITH {WEIGHTED} SELECT term, doc_id, weight,
            string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tokens GROUP BY ALL""",
        "term_index": f"""WITH {TOKENS} SELECT term, doc_id,
            string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tokens GROUP BY ALL""",
        "search_and": f"WITH {WORDS} {_any_of({'and': _has_word('worthless', 'the')})}",
        "search_or": f"WITH {WORDS} " + _any_of({"or": "list_has_any(ws, "
                                                 "['worthless', 'pathetic', 'ingre'])"}),
        "search_not": f"WITH {WORDS} " + _any_of({
            "not": f"{_has_word('worthless')} AND NOT {_has_word('pathetic')}",
            "pure": f"NOT {_has_word('the')}",
            "neither": f"NOT {_has_word('the')} AND NOT {_has_word('la')}"}),
        "search_phrase": f"WITH {TOKENS} {_any_of(PHRASE_SQL)}",
        "search_strict": f"WITH {TOKENS} " + _any_of({
            "nested": f"({_has_word('worthless')} OR {_has_word('pathetic')}) "
                      f"AND NOT ({_has_word('ingre', 'the')})",
            "phrase_or": " OR ".join([_has_phrase("license", "version"),
                                      _has_phrase("license", "agreement"),
                                      _has_phrase("worthless", "ingre")])}),
        "search_plain": f"WITH {WORDS} {_any_of(PLAIN_SQL)}",
        "search_web": f"WITH {TOKENS} {_any_of(WEB_SQL)}",
        "search_two_fields": f"""WITH {WEIGHTED},
            docs AS (SELECT doc_id FROM words) {_any_of(PHRASE_SQL, 'docs')}""",
        "search_batch": f"""WITH {WORDS}, asked AS (SELECT item_id AS query_id,
            list_distinct({_word_list('text')}) AS terms FROM benchmark)
            SELECT query_id, doc_id FROM asked JOIN words ON list_has_all(ws, terms)
            WHERE len(terms) > 0""",
        "search_counts": f"""WITH {WORDS}, asked AS (SELECT item_id AS query_id,
            list_distinct({_word_list('text')}) AS terms FROM benchmark)
            SELECT query_id, count(doc_id) AS n_docs FROM asked
            LEFT JOIN words ON list_has_all(ws, terms) AND len(terms) > 0 GROUP BY query_id""",
        "search_indexed": f"WITH {TOKENS} {_any_of(WEB_SQL)}",
        "search_phrase_pairs": f"WITH {TOKENS} {_any_of(PHRASE_SQL)}",
        "search_rows_clustered": f"""SELECT query_id, doc_id, lang, n_chars, headline
            FROM ({_headline_sql()}) JOIN documents USING (doc_id)""",
        "search_rows": f"""WITH {WORDS} SELECT doc_id, lang, n_chars FROM documents
            WHERE doc_id IN (SELECT doc_id FROM ({_any_of(PLAIN_SQL)}))""",
        "search_english": f"WITH {TOKENS} {_any_of(ENGLISH_SQL)}",
        "search_english_indexed": f"WITH {TOKENS} {_any_of(ENGLISH_SQL)}",
        "rank_or": f"WITH {WEIGHTED}, {OR_ASKED}, {OR_RANK} SELECT * FROM scored",
        "rank_and": f"WITH {WEIGHTED}, {AND_RANK} SELECT * FROM scored",
        "rank_order": f"""WITH {WEIGHTED}, {AND_RANK} SELECT query_id, doc_id, title,
            round(rank, 4) AS rank FROM scored JOIN articles USING (doc_id)
            ORDER BY query_id, rank DESC, doc_id""",
        "topk": f"""WITH {WEIGHTED}, {OR_ASKED}, {OR_RANK} SELECT query_id, doc_id, rank, place
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id)
            AS place FROM scored) WHERE place <= 10""",
        "headline": _headline_sql(),
        "json_scalar": _parts("p_brand = 'Brand#2'"),
        "json_bool": _parts("p_size <= 25"),
        "json_number": _parts("p_size = 11"),
        "json_number_text": _parts("p_size = 11 AND p_type = 'SMALL'"),
        "json_null": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
        "json_multi": _parts("p_brand = 'Brand#2' AND p_type = 'SMALL'"),
        "json_nested": _parts("p_type = 'SMALL' AND p_size = 30"),
        "json_array": _parts(f"list_contains({TAGS}, 'red')"),
        "json_array_all": _parts(f"list_has_all({TAGS}, ['red', 'bolt'])"),
        "json_array_objects": _parts("p_size % 5 = 4"),
        "json_event_number": "SELECT event_id FROM events "
                             "WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 69",
        "json_reject": """SELECT CASE WHEN json_valid(text) THEN 'parsed' ELSE 'rejected' END AS outcome,
            count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT event_id AS id, props AS text FROM events
            UNION ALL SELECT doc_id, text FROM documents) GROUP BY 1""",
        "load_rejects": """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN -1
            ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
            CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'loaded' END AS outcome FROM events""",
        "json_stored": " UNION ALL ".join(f"SELECT '{name}' AS test, p_partkey AS id FROM part WHERE {test}"
            for name, test in {
                "scalar": "p_brand = 'Brand#2'", "nested": "p_size = 11",
                "array": f"list_has_all({TAGS}, ['red', 'bolt'])", "key": "p_size % 3 = 0",
                "keys": "p_size % 3 = 0", "within": WITHIN_TEST}.items()),
        "json_deep": """SELECT p_size::VARCHAR AS query_id, p_partkey AS row_id, how AS "by"
            FROM part, (VALUES ('scan'), ('index')) AS t(how) WHERE p_size IN (3, 11, 99)""",
        "json_batch_objects": " UNION ALL ".join(
            f"""SELECT '{name}' AS query_id, p_partkey AS row_id, how AS "by" FROM part,
                (VALUES ('scan'), ('index')) AS t(how) WHERE {test}""" for name, test in {
                "stars": "p_size % 5 = 4", "size": "p_size = 11", "crossed": "false",
                "both": "p_size = 11", "long": "p_size % 2 = 0",
                "long_tag": "p_size % 2 = 1 AND p_type = 'SMALL'"}.items()),
        "json_key": _parts("p_size % 3 = 0"),
        "json_key_any": _parts("p_size % 3 = 0"),
        "json_key_all": _parts("p_size % 3 = 0"),
        "json_contained_by": """SELECT o_orderkey FROM orders
            WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
        "json_contained_by_parts": _parts(
            "p_type = 'ECONOMY' AND p_size % 5 IN (1, 3) AND len(list_filter("
            f"{TAGS}, lambda t: NOT list_contains(['ring', 'red', 'small', 'blue', 'widget'], t))) = 0"),
        "json_path_index": f"""SELECT path, vtype, value, count(*) AS n_rows, sum(p_partkey)::BIGINT AS rows
            FROM (SELECT DISTINCT p_partkey, e['path'] AS path, e['vtype'] AS vtype, e['value'] AS value
            FROM (SELECT p_partkey, unnest(list_concat(list_concat(list_concat(
            [{{'path': '$', 'vtype': 'object', 'value': ''}},
             {{'path': '$."brand"', 'vtype': 'string', 'value': p_brand}},
             {{'path': '$."category"', 'vtype': 'string', 'value': p_type}},
             {{'path': '$."tags"', 'vtype': 'array', 'value': ''}},
             {{'path': '$."specs"', 'vtype': 'object', 'value': ''}},
             {{'path': '$."specs"."size"', 'vtype': 'number', 'value': p_size::VARCHAR}},
             {{'path': '$."specs"."price"', 'vtype': 'number',
               'value': regexp_replace(p_retailprice::DECIMAL(18, 2)::VARCHAR, '[.]?0+$', '')}},
             {{'path': '$."in_stock"', 'vtype': 'boolean', 'value': (p_size > 25)::VARCHAR}},
             {{'path': '$."marks"', 'vtype': 'array', 'value': ''}},
             {{'path': '$."marks"[]', 'vtype': 'object', 'value': ''}},
             {{'path': '$."marks"[]."k"', 'vtype': 'string', 'value': 'size'}},
             {{'path': '$."marks"[]."k"', 'vtype': 'string', 'value': 'stars'}},
             {{'path': '$."marks"[]."n"', 'vtype': 'number', 'value': p_size::VARCHAR}},
             {{'path': '$."marks"[]."n"', 'vtype': 'number', 'value': (p_size % 5)::VARCHAR}}],
            list_transform({TAGS}, lambda t: {{'path': '$."tags"[]', 'vtype': 'string', 'value': t}})),
            list_transform(['brand', 'category', 'tags', 'specs', 'in_stock', 'marks'],
                lambda k: {{'path': 'key', 'vtype': 'key', 'value': k}})),
            CASE WHEN p_size % 3 = 0 THEN [{{'path': 'key', 'vtype': 'key', 'value': 'subcategory'}},
                {{'path': '$."subcategory"', 'vtype': 'string', 'value': p_type}}] ELSE [] END)) AS e
            FROM part)) GROUP BY ALL""",
        "json_batch": JSON_BATCH,
        "json_batch_indexed": JSON_BATCH,
        "json_batch_table": "SELECT p_brand || '/' || p_type AS query_id, p_partkey AS row_id "
                            "FROM part",
        "json_keys_indexed": """SELECT 'any' AS query_id, p_partkey AS row_id FROM part
            UNION ALL SELECT unnest(['all', 'any_rare']), p_partkey FROM part
            WHERE p_size % 3 = 0""",
        "json_fields": """SELECT p_partkey, p_brand AS brand,
            CASE WHEN p_size % 3 = 0 THEN p_type ELSE '—' END AS subcategory,
            CASE WHEN p_size > 25 THEN '✓' ELSE '✗' END AS stock, '✗' AS absent FROM part""",
        "json_names": f"""SELECT query_id, row_id // 500 AS chunk,
            string_agg(p_name, ',' ORDER BY row_id) AS names FROM ({JSON_BATCH})
            JOIN part ON p_partkey = row_id GROUP BY ALL""",
        "load_new": """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys
            FROM orders GROUP BY 1""",
        "load_if_empty": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1",
        "index_refresh": f"WITH {WORDS} " + _any_of({
            "fr": _has_word("la", "des"), "de": _has_word("der", "die"),
            "src": "list_has_any(ws, ['src0', 'src3'])", "not": f"NOT {_has_word('la')}"}),
        "index_stream": f"WITH {WORDS} {_any_of(PLAIN_SQL)}",
        "index_sync": f"WITH {SYNCED} {_any_of(SYNC_SQL)}",
        "index_compacted": f"WITH {SYNCED} {_any_of(SYNC_SQL)}",
        "index_stream_updates": f"WITH {STREAMED} " + _any_of({
            "fr": _has_word("la", "des"), "de": _has_word("der", "die"),
            "src": "list_has_any(ws, ['src0', 'src3'])", "not": f"NOT {_has_word('la')}"}),
        "path_index_refresh": _orders_sql("o_orderpriority <> '5-LOW'"),
        "path_index_stream": _orders_sql("true"),
        "rank_indexed": f"WITH {WEIGHTED}, {OR_ASKED}, {OR_RANK} SELECT query_id, doc_id, rank FROM scored",
        "search_web_ranked_indexed": _web_ranked_sql(),
        "text_postings_english": f"""WITH {ENGLISH_TOKENS} SELECT term, doc_id, weight,
            string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tokens
            WHERE term IN ('licens', 'version') GROUP BY ALL""",
        "search_batch_large": rf"""WITH plain AS (SELECT doc_id,
                regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
            asked AS (SELECT DISTINCT array_to_string(ws[k * 5 + 1:k * 5 + 3], ' ') AS query_id, ws[k * 5 + 1] AS a,
                ws[k * 5 + 2] AS b, ws[k * 5 + 3] AS c FROM plain, range(10) AS r(k) WHERE k * 5 + 2 < len(ws)),
            {WORDS}, every AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1),
                lambda i: {{'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]}})) AS t FROM words),
            triples AS (SELECT DISTINCT doc_id, t['a'] AS a, t['b'] AS b, t['c'] AS c FROM every)
            SELECT query_id, doc_id FROM asked JOIN triples USING (a, b, c)""",
        "json_batch_large": """SELECT a.o_orderkey AS query_id, b.o_orderkey AS row_id FROM orders a JOIN orders b
            ON a.o_custkey = b.o_custkey AND a.o_totalprice = b.o_totalprice WHERE a.o_orderstatus <> 'P'""",
        "search_strict_table": rf"""WITH items AS (SELECT item_id AS query_id,
                regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS q FROM benchmark), {WORDS}
            SELECT query_id, doc_id FROM items JOIN words ON len(q) > 2 AND list_contains(ws, q[1])
            AND (list_contains(ws, q[2]) OR NOT list_contains(ws, q[3]))""",
        "json_contained_by_indexed": """SELECT 'urgent' AS query_id, o_orderkey AS row_id FROM orders
            WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
        "json_contained_by_batch": f"""SELECT p_type AS query_id, p_partkey AS row_id, how AS "by"
            FROM part, (VALUES ('scan'), ('index')) AS t(how) WHERE p_size % 5 IN (1, 3) AND len(list_filter(
            {TAGS}, lambda t: NOT list_contains(['ring', 'red', 'small', 'blue', 'widget'], t))) = 0""",
        "json_name_lists": f"""SELECT query_id, string_agg(p_name, ',' ORDER BY row_id) AS names
            FROM ({JSON_BATCH}) JOIN part ON p_partkey = row_id GROUP BY ALL""",
        "index_stream_late": f"WITH {STREAMED} " + _any_of({
            "fr": _has_word("la", "des"), "de": _has_word("der", "die"),
            "src": "list_has_any(ws, ['src0', 'src3'])", "not": f"NOT {_has_word('la')}"}),
        "text_positions_english": f"WITH {ENGLISH_TOKENS} SELECT doc_id, weight, pos::INTEGER AS pos FROM tokens",
        "plan_display": """SELECT "plan", true AS buckets_pruned, true AS entry_pushed
            FROM (VALUES ('terms'), ('paths')) AS t("plan")""",
        "search_alternatives": f"WITH {TOKENS} " + _any_of({
            "two": " OR ".join(_has_phrase(a, b) for a in ("thintion", "worthless") for b in ("ofonrereer", "ingre", "the")),
            "three": " OR ".join(_has_phrase("of", a, b) for a in ("the", "and") for b in ("to", "ingre")),
            "not": f"{_has_word('license')} AND NOT ({_has_phrase('under', 'the')} OR {_has_phrase('under', 'a')})"}),
        "json_keys_table": """SELECT b AS query_id, p_partkey AS row_id FROM part, (SELECT DISTINCT p_brand AS b
            FROM part) WHERE length(b) > 7 AND p_size % 3 = 0""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    added = {**text_prep.QUERIES, "pipeline": corpus_pipeline.run} if text_prep else {}
    return {**_search_queries(), "text_postings_english_all": _postings_english_all, **added}


def oracle_sql() -> dict[str, str]:
    if text_prep is None:
        return _search_sql()
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**_search_sql(), **text_prep.ORACLE_SQL, **whole}
