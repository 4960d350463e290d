import json
import random
import time

import pytest
from conftest import by_query
from pyspark.sql import functions as F

from trawl.functions import jsonb, jsonpaths
from trawl.functions.jsonpaths import nodes
from trawl.operators import json_search
from trawl.operators.json_search import _contains
from trawl.sources import path_index, tables

ITEMS = [
    '{"maker":"Alba","kind":"lamp","tags":["desk","led"],"dims":{"h_cm":40,"w_cm":12.5},'
    '"sold_out":false}',
    '{"maker":"Alba","kind":"chair","tags":["desk","wheels"],"dims":{"h_cm":"40"},"sold_out":true}',
    '{"maker":"Brio","kind":"lamp","tags":["led-strip"],"dims":{"h_cm":40.0,"w_cm":null},'
    '"sold_out":false}',
    '{"maker":"Brio","parts":[{"id":1,"mat":"oak"},{"id":2,"mat":"tin"}],"dims":{}}',
    '{"maker":"Cove","parts":[{"id":1,"mat":"tin"}],"tags":[],"a.b":1}',
    '{}', '["maker","led"]', '"maker"',
]
CONTAINS = {
    '{"maker":"Alba"}': [1, 2], '{"sold_out":false}': [1, 3],
    '{"maker":"Alba","kind":"lamp"}': [1], '{"dims":{"h_cm":40}}': [1, 3],
    '{"dims":{"h_cm":4e1}}': [1, 3], '{"dims":{"h_cm":"40"}}': [2], '{"dims":{"w_cm":null}}': [3],
    '{"dims":{}}': [1, 2, 3, 4], '{"tags":["led"]}': [1], '{"tags":["led","desk"]}': [1],
    '{"tags":[]}': [1, 2, 3, 5], '{"parts":[{"id":1,"mat":"tin"}]}': [5],
    '{"parts":[{"mat":"tin"}]}': [4, 5], '{}': [1, 2, 3, 4, 5, 6], '["led"]': [7],
    '"maker"': [7, 8], '{"h_cm":40}': [], '{"a.b":1}': [5], '[]': [7], '{"a":{"b":1}}': [],
}


@pytest.fixture(scope="module")
def items(spark):
    rows = list(enumerate(ITEMS, 1))
    return spark.createDataFrame(rows, "id long, j string").select(
        "id", F.parse_json("j").alias("attrs"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("pattern", CONTAINS)
def test_contains(items, pattern):
    assert ids(items.where(jsonb.contains("attrs", pattern))) == CONTAINS[pattern]
    # The negation holds for all other rows: the test is never NULL.
    others = set(range(1, 9)) - set(CONTAINS[pattern])
    if not pattern.startswith('"'):
        assert set(ids(items.where(~F.coalesce(jsonb.contains("attrs", pattern), F.lit(False))))) \
            == others


@pytest.mark.parametrize("test,expected", [
    (("has_key", "maker"), [1, 2, 3, 4, 5, 7, 8]),
    (("has_key", "h_cm"), []), (("has_key", "a.b"), [5]),
    (("has_any_key", ["kind", "parts"]), [1, 2, 3, 4, 5]), (("has_any_key", []), []),
    (("has_all_keys", ["maker", "tags"]), [1, 2, 3, 5]),
    (("has_all_keys", ["maker", "led"]), [7]),
    (("contained_by", '{"maker":"Cove","parts":[{"id":1,"mat":"tin"},{"id":9}],"tags":["x"],'
      '"a.b":1,"z":0}'), [5, 6]),
    (("contained_by", '["led","maker","x"]'), [7, 8]),
])
def test_keys_and_contained_by(items, test, expected):
    name, argument = test
    assert ids(items.where(getattr(jsonb, name)("attrs", argument))) == expected


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    where = path_index.PathIndex(str(tmp_path_factory.mktemp("p") / "x"), "id", "attrs", 4)
    path_index.build_path_index(items, where)
    return where


def _batch(requests, items, index):
    for corpus in (json_search.JsonScan(items, "id", "attrs"),
                   json_search.JsonLookup(index, items)):
        yield by_query(json_search.json_matches(requests, corpus).collect(), "row_id")


def test_batches_agree_with_single_predicates(spark, items, index):
    requests = json_search.patterns(spark, {p: p for p in CONTAINS})
    for found in _batch(requests, items, index):
        assert found == {p: e for p, e in CONTAINS.items() if e}


def test_batches_that_are_not_broadcast(spark, items, index, no_broadcast):
    table = spark.createDataFrame([(p, p) for p in CONTAINS], "query_id string, pattern string")
    requests = json_search.patterns(spark, table)
    assert not requests.small
    for found in _batch(requests, items, index):
        assert found == {p: e for p, e in CONTAINS.items() if e}


def test_key_batches(spark, items, index):
    anyone = json_search.keys(spark, {"m": ["maker"], "kp": ["kind", "parts"], "no": ["x"]}, False)
    for found in _batch(anyone, items, index):
        assert found == {"m": [1, 2, 3, 4, 5, 7, 8], "kp": [1, 2, 3, 4, 5]}
    every = json_search.keys(spark, {"mt": ["maker", "tags"], "ml": ["maker", "led", "led"]}, True)
    for found in _batch(every, items, index):
        assert found == {"mt": [1, 2, 3, 5], "ml": [7]}


def test_numbers_have_one_spelling(spark):
    texts = ["1", "1.0", "1e0", "100", "1e2", "0.10", "0.1", "1e-20", "0", "-2.50", "1e25",
             "10000000000000000000000000", "12345678901234567890123456789012345678", "true", '"1"']
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, j string").selectExpr(
        "n", f"{jsonb.number_text('parse_json(j)')} as t").orderBy("n").collect()
    assert [r["t"] for r in rows] == [
        "1", "1", "1", "100", "100", "0.1", "0.1", "0.00000000000000000001", "0", "-2.5",
        "1" + "0" * 25, "1" + "0" * 25, texts[12], None, None]


def _random_json(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind < 4:
        return rng.choice([1, 2, 1.5, "a", "b", "1", True, False, None, "key"])
    if kind == 4:
        return [_random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "c.d", 'q"x', "e'f", "g]h'\"", "back\\slash"]):
            _random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def _part_of(rng, value):
    """A pattern that a value contains, more often than a random one would be."""
    if isinstance(value, dict):
        return {k: _part_of(rng, v) for k, v in value.items() if rng.random() < 0.7}
    if isinstance(value, list):
        return [_part_of(rng, v) for v in value if rng.random() < 0.7]
    return value


def test_random_documents_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    documents = [_random_json(rng) for _ in range(150)]
    patterns = [_part_of(rng, rng.choice(documents)) for _ in range(30)] + \
        [_random_json(rng) for _ in range(10)]
    asked = {str(n): json.dumps(p) for n, p in enumerate(patterns)}
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(documents)],
                               "id long, j string").select("id", F.parse_json("j").alias("v"))

    def holds(document, pattern):
        if not isinstance(pattern, (dict, list)) and isinstance(document, list):
            return any(_contains(x, pattern) for x in document)
        return _contains(document, pattern)

    def exact(value):
        return json.loads(json.dumps(value), parse_int=float)

    want = {}
    for q, pattern in asked.items():
        found = [n for n, d in enumerate(documents) if holds(exact(d), exact(json.loads(pattern)))]
        if found:
            want[q] = found
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 4)
    path_index.build_path_index(df, index)
    requests = json_search.patterns(spark, asked)
    for corpus in (json_search.JsonScan(df, "id", "v"), json_search.JsonLookup(index, df)):
        assert by_query(json_search.json_matches(requests, corpus).collect(), "row_id") == want
    # The compiled predicates, and containment turned round.
    for q in list(asked)[::4]:
        got = sorted(r["id"] for r in df.where(jsonb.contains("v", asked[q])).collect())
        assert got == want.get(q, [])
        got = sorted(r["id"] for r in df.where(jsonb.contained_by("v", asked[q])).collect())
        assert got == [n for n, d in enumerate(documents)
                       if holds(exact(json.loads(asked[q])), exact(d))]


@pytest.mark.parametrize("depth", [1, 8, 9, 70, 400])
def test_documents_of_any_depth(spark, tmp_path, depth):
    deep = "[" * depth + "7" + "]" * depth
    df = spark.createDataFrame([(1, deep), (2, '{"a":' * depth + deep + "}" * depth), (3, "[]")], "id long, j string")
    df = df.selectExpr("id", "parse_json(j) as v")
    assert len(df.where("id = 1").selectExpr(f"{nodes('v')} as n").first()["n"]) == depth + 1
    index = path_index.PathIndex(str(tmp_path / "deep"), "id", "v", 4)
    path_index.build_path_index(df, index)
    requests = json_search.patterns(spark, {"one": deep, "two": '{"a":' * depth + "[]" + "}" * depth})
    for corpus in (json_search.JsonScan(df, "id", "v"), json_search.JsonLookup(index, df)):
        assert by_query(json_search.json_matches(requests, corpus).collect(), "row_id") == {"one": [1], "two": [2]}


@pytest.mark.parametrize("compiled", [200, 0])
def test_rechecks_compare_numbers_as_spark_reads_them(spark, tmp_path, monkeypatch, compiled):
    monkeypatch.setattr(json_search, "COMPILED", compiled)
    long = "123456789012345678901234567890123456789012"
    documents = [f'{{"a":[{{"n":{long},"m":1}},{{"n":2,"m":2}}]}}', '{"a":[{"n":1e2,"m":2.50},{"n":2.0,"m":3}]}']
    df = spark.createDataFrame(list(enumerate(documents)), "id long, j string").selectExpr("id", "parse_json(j) as v")
    asked = {"long": f'{{"a":[{{"n":{long},"m":1}}]}}', "mixed": f'{{"a":[{{"n":{long},"m":2}}]}}',
             "exponent": '{"a":[{"n":100,"m":2.5}]}', "two": '{"a":[{"n":2},{"m":3.0}]}', "flat": f'{{"a":[{{"n":{long}}}]}}'}
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 4)
    path_index.build_path_index(df, index)
    requests = json_search.patterns(spark, asked)
    want = {"long": [0], "exponent": [1], "two": [1], "flat": [0]}
    for corpus in (json_search.JsonScan(df, "id", "v"), json_search.JsonLookup(index, df)):
        found = json_search.json_matches(requests, corpus)
        assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
        assert by_query(found.collect(), "row_id") == want
    for q, pattern in asked.items():
        assert [r["id"] for r in df.where(jsonb.contains("v", pattern)).collect()] == want.get(q, [])


OUTER = {
    "flat": '{"a":1,"b":{"c":[1,2.0,"x"],"d":{}},"e":null}', "elements": '{"a":[{"n":1,"m":2},{"n":3,"k":[1,[2]]}],"z":0}',
    "array": '["x",1,{"y":[true]},[]]', "scalar": '"x"', "empty": "{}", "deep": '{"a":[[{"n":1},{"m":2}],[5]]}'}
INNER = ['{"a":1}', '{"b":{"c":["x",2]}}', '{"b":{"d":{}}}', '{"b":{"d":{"q":1}}}', '{"e":null,"a":1.0}', '{"a":"1"}', "{}", "[]",
         '"x"', "1", "2", "null", '["x"]', '[{"y":[]}]', '[{"y":[true,true]},1]', '[[]]', '{"a":[]}', '{"a":[{"n":1}]}',
         '{"a":[{"n":1,"k":[1]}]}', '{"a":[{"n":1},{"n":3,"k":[[2]]},{"n":3}],"z":0}', '{"a":[{}]}', '{"a":[[{"n":1,"m":2}]]}',
         '{"a":[[{"n":1},{"m":2}]]}', '{"a":[[5],[{"m":2}]]}', '{"a":[[{"n":1},5]]}', '{"b":{"c":[[]]}}', '{"b":{"c":[1,1,1]}}']


def _plain_contains(left, right):
    if isinstance(right, dict):
        return isinstance(left, dict) and all(k in left and _plain_contains(left[k], r) for k, r in right.items())
    if isinstance(right, list):
        return isinstance(left, list) and all(any(_plain_contains(x, r) for x in left) for r in right)
    number = (int, float)
    alike = type(left) is type(right) or all(isinstance(x, number) and not isinstance(x, bool) for x in (left, right))
    return alike and left == right


@pytest.mark.parametrize("compiled", [200, 0])
def test_contained_by_in_batches_and_through_the_index(spark, tmp_path, monkeypatch, compiled):
    monkeypatch.setattr(json_search, "COMPILED", compiled)
    df = spark.createDataFrame(list(enumerate(INNER)) + [(99, None)], "id long, j string").selectExpr(
        "id", "parse_json(j) as v")
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 4)
    path_index.build_path_index(df, index)
    want = {}
    for q, outer in OUTER.items():
        left = json.loads(outer)
        for i, inner in enumerate(INNER):
            right = json.loads(inner)
            bare = isinstance(left, list) and not isinstance(right, (dict, list))
            if _plain_contains(left, right) or bare and any(_plain_contains(x, right) for x in left):
                want.setdefault(q, []).append(i)
    table = spark.createDataFrame(list(OUTER.items()), "query_id string, pattern string")
    for asked in (OUTER, table):
        for corpus in (json_search.JsonScan(df, "id", "v"), json_search.JsonLookup(index, df)):
            found = json_search.json_matches(json_search.containers(spark, asked), corpus)
            assert by_query(found.collect(), "row_id") == want
    for q, outer in OUTER.items():
        assert sorted(r["id"] for r in df.where(jsonb.contained_by("v", outer)).collect()) == want.get(q, [])


def test_contained_by_reads_only_the_literals_buckets(spark, tmp_path):
    df = spark.range(300).selectExpr("id", """parse_json(concat('{"a":', id % 50, ',"b":', id % 7, '}')) as v""")
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 16)
    path_index.build_path_index(df, index)
    found = json_search.json_matches(json_search.containers(spark, {"q": '{"a":3,"b":3,"c":[1]}'}),
                                     json_search.JsonLookup(index, df.where("false")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "path_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "LeftSemi" in plan and "parse_json" not in plan
    assert sorted(r.row_id for r in found.collect()) == [i for i in range(300) if i % 50 == 3 and i % 7 == 3]


def test_same_element_is_decided_by_positions(spark, tmp_path):
    rows = ['{"a":[{"n":1,"m":[{"x":1},{"y":2}]},{"n":2,"m":[{"x":1,"y":2}]}]}', '{"a":[{"n":1,"m":[{"x":1,"y":2}]},{"n":2}]}',
            '{"a":[[1,2],[3]],"b":[[1],[2]]}', '{"a":[[1],[2,3]]}', '{"a.b":[{"c[]":[{"d\\"e":1,"f":2}]}]}', "[]", "1"]
    asked = {"one": '{"a":[{"n":1,"m":[{"x":1,"y":2}]}]}', "two": '{"a":[{"n":2,"m":[{"y":2,"x":1}]},{"n":1}]}',
             "pair": '{"a":[[1,2]]}', "apart": '{"a":[[1],[3]]}', "keys": '{"a.b":[{"c[]":[{"f":2,"d\\"e":1.0}]}]}',
             "empties": '{"a":[{"m":[{}]}]}', "repeated": '{"a":[[2],[2],[3]]}', "none": '{"a":[{"n":1,"x":1}]}'}
    df = spark.createDataFrame(list(enumerate(rows)), "id long, j string").selectExpr("id", "parse_json(j) as v")
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 4)
    path_index.build_path_index(df, index)
    want = {}
    for q, pattern in asked.items():
        ids = [i for i, row in enumerate(rows) if _plain_contains(json.loads(row), json.loads(pattern))]
        want |= {q: ids} if ids else {}
    assert len(want) == 7
    many = asked | {f"many{n}": '{"a":[{"n":%d,"m":[{"x":1}]}]}' % n for n in range(300)}
    want |= {"many1": [0, 1], "many2": [0]}
    table = spark.createDataFrame(list(many.items()), "query_id string, pattern string")
    for given in (many, table):
        for corpus in (json_search.JsonScan(df, "id", "v"), json_search.JsonLookup(index, df.where("false"))):
            found = json_search.json_matches(json_search.patterns(spark, given), corpus)
            assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
            got = by_query(found.collect(), "row_id")
            want["many1"] = [i for i, r in enumerate(rows) if _plain_contains(json.loads(r), json.loads(many["many1"]))]
            assert got == want


def test_requests_from_tables_and_text_keys(spark, tmp_path):
    rows = [("aa1", '{"x":1,"y":2}'), ("aa2", '{"x":1}'), ("b1", '["y"]'), ("c", "null")]
    df = spark.createDataFrame(rows, "id string, j string").selectExpr("id", "parse_json(j) as v", "id as name")
    asked = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y"]), (3, []), (4, None)], "query_id long, keys array<string>")
    corpora = [json_search.JsonScan(df, "id", "v")]
    index = path_index.PathIndex(str(tmp_path / "x"), "id", "v", 4, "string")
    path_index.build_path_index(df, index)
    corpora.append(json_search.JsonLookup(index, df))
    for corpus in corpora:
        found = json_search.json_matches(json_search.keys(spark, asked, True), corpus)
        assert by_query(found.collect(), "row_id") == {1: ["aa1"], 2: ["aa1", "b1"]}
        found = json_search.json_matches(json_search.keys(spark, asked, False), corpus)
        assert by_query(found.collect(), "row_id") == {1: ["aa1", "aa2", "b1"], 2: ["aa1", "b1"]}
    whole = json_search.name_lists(found, df, "id", "name").collect()
    assert sorted(map(tuple, whole)) == [(1, ["aa1", "aa2", "b1"]), (2, ["aa1", "b1"])]
    lists = json_search.name_lists(found, df, "id", "name", 1000).collect()
    assert sorted((r.query_id, r.chunk, r.names) for r in lists) == [
        (1, "aa", ["aa1", "aa2"]), (1, "b1", ["b1"]), (2, "aa", ["aa1"]), (2, "b1", ["b1"])]


def test_name_lists_are_whole_and_in_order(spark, items):
    named = spark.createDataFrame([(n, f"n{n}") for n in range(1, 9)], "id long, name string")
    requests = json_search.patterns(spark, {"all": "{}", "none": '{"x":1}'})
    matched = json_search.json_matches(requests, json_search.JsonScan(items, "id", "attrs"))
    rows = json_search.name_lists(matched, named, "id", "name", 4).collect()
    assert sorted((r.query_id, r.chunk, r.names) for r in rows) == [
        ("all", 0, ["n1", "n2", "n3"]), ("all", 1, ["n4", "n5", "n6"])]


def test_fields_and_marks(items):
    rows = items.select("id", jsonb.field("attrs", "kind").alias("kind"),
                        jsonb.mark("attrs", "sold_out").alias("sold")).orderBy("id").collect()
    assert [(r.kind, r.sold) for r in rows] == [
        ("lamp", "✗"), ("chair", "✓"), ("lamp", "✗")] + [("—", "✗")] * 5


NOT_JSON = ["{a", "", "1 abc", "1,2", "1],[2", '1},{"b":2', '{"a":1} x', '{"a":1}{"b":2}', "]", "01",
            '1,"b":2', "NaN", "'a'"]


def test_bad_json_defaults_and_repeated_keys(spark):
    rows = ['{"a":1,"a":2}', None, " [1] ", "null", '"a]}"', "-1.5e3"] + NOT_JSON
    df = spark.createDataFrame(list(enumerate(rows)), "id long, j string")
    good, bad = tables.split_bad_json(df, "j", "v")
    assert sorted((r.id, r.t) for r in good.select("id", F.to_json("v").alias("t")).collect()) == [
        (0, '{"a":2}'), (1, "{}"), (2, "[1]"), (3, "null"), (4, '"a]}"'), (5, "-1500.0")]
    assert sorted(r.j for r in bad.collect()) == sorted(NOT_JSON)
    df.where("id = 2").select(tables.json_value("j")).collect()
    with pytest.raises(Exception, match="not a JSON value"):
        df.select(tables.json_value("j")).collect()
    with pytest.raises(Exception, match="not a JSON value"):
        json_search.patterns(spark, {"q": '{"a":1} x'})


def test_wide_document_of_many_levels_is_not_copied_per_bracket(spark):
    """Ten levels around 12,000 small arrays: levels are opened, not as many steps as there are brackets."""
    text = "[" * 10 + ",".join("[1]" for _ in range(12_000)) + "]" * 10
    began = time.monotonic()
    row = spark.createDataFrame([(text,)], "t string").select(F.expr(
        f"size(filter({jsonpaths.nodes('parse_json(t)')}, n -> n.vtype = 'number'))").alias("n")).first()
    assert row["n"] == 12_000
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("value", ["a]b", "[[[[", 'x"]}', "\\"])
def test_brackets_in_strings_do_not_change_the_depth(spark, value):
    document = {value: 1, "s": value}
    for k in range(30):
        document = [document, value] if k % 2 else {value: document}
    rows = spark.createDataFrame([(json.dumps(document),)], "t string").select(F.expr(
        f"filter({jsonpaths.nodes('parse_json(t)')}, n -> n.leaf)").alias("ns")).first()["ns"]
    assert len(rows) == 2 + 15
    assert sum(n["vtype"] == "number" for n in rows) == 1
