from pyspark.sql import functions as F

from trawl.sources import path_index

TEXT = '{"a": 1, "tags": ["x", "x", "y"], "in": {"tags": ["x"], "a": 1}, "rows": [{"a": 1}, {"a": 1}], "none": [], "a[]": "x"}'
NODES = {
    ("$", "object", ""): [[]], ('$."a"', "number", "1"): [[]], ('$."tags"', "array", ""): [[]],
    ('$."tags"[]', "string", "x"): [[0], [1]], ('$."tags"[]', "string", "y"): [[2]], ('$."in"', "object", ""): [[]],
    ('$."in"."tags"', "array", ""): [[]], ('$."in"."tags"[]', "string", "x"): [[0]], ('$."in"."a"', "number", "1"): [[]],
    ('$."rows"', "array", ""): [[]], ('$."rows"[]', "object", ""): [[0], [1]],
    ('$."rows"[]."a"', "number", "1"): [[0], [1]], ('$."none"', "array", ""): [[]], ('$."none"', "empty", "array"): [[]],
    ('$."a[]"', "string", "x"): [[]]}


def test_each_entry_once_with_all_its_places(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, "[]"), (3, "[7, 7]"), (4, None), (5, "{}")], "id long, t string")
    found = path_index.path_entries(rows.select("id", F.parse_json("t").alias("v")), "id", "v", True).collect()
    nodes = {(r.path, r.vtype, r.value): r.ats for r in found
             if r.row_id == 1 and r.path.startswith("$")}
    assert nodes == NODES
    assert len({(r.row_id, r.path, r.vtype, r.value) for r in found}) == len(found)
    assert {(r.row_id, r.path, r.vtype): r.ats for r in found if r.row_id == 3 and r.path == "$[]"} == {
        (3, "$[]", "number"): [[0], [1]]}
    assert sorted(r.row_id for r in found if r.vtype == "row") == [1, 2, 3, 4, 5]
