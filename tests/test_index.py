import os
import random
import time
from types import SimpleNamespace

import pytest
import __spark_entry__ as entry
from conftest import by_query
from pyspark.sql import functions as F

from trawl.functions import jsonb
from trawl.operators import json_search, match, rank
from trawl.operators.postings import frequent_terms
from trawl.plans.display import plan_text
from trawl.plans import requests as ask
from trawl.session import drop_work, work_folder
from trawl.sources import buckets, path_index, tables, term_index
from trawl.streaming.upkeep import keep_index

TEXT = (("text", "D"),)
ASKED = {"red": "red", "pair": "red & green", "none": "!red", "phrase": "red <-> green"}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def _search(spark, index):
    requests = ask.strict(spark, ASKED, "simple")
    return by_query(match.matches(requests, match.Lookup(index)).collect(), "doc_id")


def _files(path):
    return sorted((f"{top}/{f}", os.stat(f"{top}/{f}").st_mtime_ns) for top, _, names in os.walk(path) for f in names)


def _index(tmp_path, name="x"):
    return term_index.TermIndex(str(tmp_path / name), "id", TEXT, "simple", 4)


def test_refresh_equals_full_build(spark, tmp_path):
    first = [(n, "red" if n % 2 else "green") for n in range(20)]
    changed = [(1, "red green"), (2, "blue"), (3, "green")]
    new = [(30, "green red"), (31, ""), (2, "red green blue")]
    index = _index(tmp_path)
    term_index.build_term_index(_docs(spark, first), index)
    term_index.build_term_index(_docs(spark, [(99, "red")]), index)  # left as it is
    term_index.refresh_term_index(_docs(spark, changed), index)
    term_index.refresh_term_index(_docs(spark, new), index)
    term_index.refresh_term_index(_docs(spark, new), index)  # replayed
    now = list((dict(first) | dict(changed) | dict(new)).items())
    full, compacted = _index(tmp_path, "full"), _index(tmp_path, "compacted")
    term_index.build_term_index(_docs(spark, now), full)
    term_index.compact_term_index(spark, index, compacted)
    want = _search(spark, full)
    assert want["phrase"] == [1, 2] and 31 in want["none"] and 3 not in want["red"]
    assert _search(spark, index) == want
    assert _search(spark, compacted) == want

    def rows(i):
        return sorted(map(tuple, term_index.read_postings(spark, i).collect()))

    def counts(i):
        return sorted(map(tuple, term_index.all_counts(spark, i).collect()))

    assert counts(index) == counts(full) == counts(compacted)
    assert rows(index) == rows(full) == rows(compacted)


def test_sync_finds_new_and_changed_rows(spark, tmp_path):
    index = _index(tmp_path)
    docs = [(n, "red" if n % 2 else "green") for n in range(10)]
    assert term_index.sync_term_index(_docs(spark, docs), index)
    assert not term_index.sync_term_index(_docs(spark, docs), index)
    later = dict(docs) | {3: "blue", 50: "red green"}
    assert term_index.sync_term_index(_docs(spark, list(later.items())), index)
    written = _files(index.path)
    assert not term_index.sync_term_index(_docs(spark, list(later.items())), index)
    assert _files(index.path) == written
    found = _search(spark, index)
    assert found["red"] == [1, 5, 7, 9, 50] and found["phrase"] == [50]


def test_stream_equals_full_build(spark, tmp_path):
    rows = [(n, f"red w{n}" if n % 3 else "green red green") for n in range(30)]
    source = str(tmp_path / "source")
    for start in (0, 10, 20):
        _docs(spark, rows[start:start + 10]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, text string") \
        .option("maxFilesPerTrigger", 1).parquet(source)
    index, full = _index(tmp_path), _index(tmp_path, "full")
    for _ in range(2):  # a second run finds nothing new
        keep_index(stream, index, str(tmp_path / "checkpoint"), availableNow=True) \
            .awaitTermination()
    term_index.build_term_index(_docs(spark, rows), full)
    assert _search(spark, index) == _search(spark, full)


def test_sync_takes_out_deleted_rows(spark, tmp_path):
    index, compacted = _index(tmp_path), _index(tmp_path, "c")
    docs = {n: "red green" if n % 2 else "green" for n in range(10)}
    term_index.sync_term_index(_docs(spark, list(docs.items())), index)
    left = {n: t for n, t in docs.items() if n not in (1, 2)}
    assert term_index.sync_term_index(_docs(spark, list(left.items())), index)
    assert not term_index.sync_term_index(_docs(spark, list(left.items())), index)
    want = {"red": [3, 5, 7, 9], "none": [0, 4, 6, 8], "pair": [3, 5, 7, 9], "phrase": [3, 5, 7, 9]}
    assert _search(spark, index) == want
    term_index.compact_term_index(spark, index, compacted)
    assert _search(spark, compacted) == want
    assert term_index.sync_term_index(_docs(spark, list(docs.items())), index)  # back again
    assert _search(spark, index)["red"] == [1, 3, 5, 7, 9]


def test_sync_notices_a_text_that_moves_between_fields(spark, tmp_path):
    schema = "id long, title string, body string"
    index = term_index.TermIndex(str(tmp_path / "x"), "id", (("title", "A"), ("body", "B")), "simple", 4)
    before = spark.createDataFrame([(1, "x y", None), (2, None, "")], schema)
    assert term_index.sync_term_index(before, index)
    moved = spark.createDataFrame([(1, None, "x y"), (2, "", None)], schema)
    assert term_index.sync_term_index(moved, index)
    weights = term_index.read_postings(spark, index, "term = 'x'").collect()
    assert [(r.doc_id, r.weight) for r in weights] == [(1, "B")]


def test_a_key_twice_is_refused_or_ordered(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red old", 1), (1, "blue new", 2), (1, "red <-> new", None), (2, "red", 1)],
                                 "id long, text string, version int")
    index = _index(tmp_path)
    with pytest.raises(ValueError, match="not unique"):
        term_index.build_term_index(rows, index)
    term_index.build_term_index(rows, index, order="version")
    with pytest.raises(ValueError, match="not unique"):
        term_index.refresh_term_index(rows, index)
    asked = ask.strict(spark, {"r": "red", "b": "blue", "both": "red <-> new"}, "simple")
    assert by_query(match.matches(asked, match.Lookup(index)).collect(), "doc_id") == {"r": [2], "b": [1]}
    target = str(tmp_path / "t")
    with pytest.raises(ValueError, match="not unique"):
        tables.load_new(rows, target, "id")
    tables.load_new(rows, target, "id", order="version")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "blue new", 2), (2, "red", 1)]


def test_streams_keep_the_newest_version_whenever_it_comes(spark, tmp_path):
    index = _index(tmp_path)
    for name, rows in (("a", [(1, "red", 3), (2, "red", 1), (None, "red", 1)]),
                       ("b", [(2, "red green", 1), (3, "red old", 1), (3, "blue", 2), (1, "late", 2), (1, "unknown", None)]),
                       ("c", [(3, "late", 1), (None, "green", 2)])):
        source = str(tmp_path / name)
        spark.createDataFrame(rows, "id long, text string, version int").coalesce(1).write.parquet(source)
        stream = spark.readStream.schema("id long, text string, version int").parquet(source)
        for _ in range(2):
            keep_index(stream, index, str(tmp_path / f"checkpoint-{name}"), "version", availableNow=True) \
                .awaitTermination()
    for _ in range(2):
        term_index.refresh_term_index(_docs(spark, [(4, "red")]), index)
    assert _search(spark, index) == {"red": [1, 2, 4], "pair": [2], "phrase": [2], "none": [None, 3]}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_versions_may_be_times(spark, tmp_path, kind):
    index = _index(tmp_path)
    for day, text in (("2024-05-02", "red"), ("2024-05-01", "blue"), ("2024-05-03", "green")):
        term_index.refresh_term_index(_docs(spark, [(1, text)]).withColumn("at", F.lit(day).cast(kind)), index, "at")
    assert {r.term for r in term_index.read_postings(spark, index).collect()} == {"", "green"}
    with pytest.raises(ValueError, match="whole number"):
        term_index.refresh_term_index(_docs(spark, [(1, "x")]).withColumn("at", F.lit("y")), index, "at")


def test_null_is_a_key_like_any_other(spark, tmp_path):
    index, rows = _index(tmp_path), [(1, "red"), (None, "green")]
    assert term_index.sync_term_index(_docs(spark, rows), index)
    written = _files(index.path)
    assert not term_index.sync_term_index(_docs(spark, rows), index)
    assert _files(index.path) == written
    assert term_index.sync_term_index(_docs(spark, [(1, "red"), (None, "red")]), index)
    assert _search(spark, index)["red"] == [None, 1]
    assert term_index.sync_term_index(_docs(spark, [(1, "red")]), index)
    assert _search(spark, index) == {"red": [1]}
    target = str(tmp_path / "t")
    for _ in range(3):
        tables.load_new(_docs(spark, rows), target, "id")
    assert spark.read.parquet(target).count() == 2


def test_a_change_rewrites_only_the_key_buckets_of_its_keys(spark, tmp_path):
    index = _index(tmp_path)
    term_index.build_term_index(_docs(spark, [(n, f"w{n % 5} red") for n in range(60)]), index)
    before = {f for f, _ in _files(index.path) if f.endswith(".parquet")}
    mine = spark.sql(f"select {buckets.bucket_of(['7L'], 4)}").first()[0]
    old = {f for f in before if f"key_bucket={mine}/" in f}
    term_index.refresh_term_index(_docs(spark, [(7, "blue")]), index)
    after = {f for f, _ in _files(index.path) if f.endswith(".parquet")}
    assert old and before - after == old
    assert not os.path.exists(index.layout.staged)


class _Died(Exception):
    pass


@pytest.mark.parametrize("step", range(1, 5))
def test_a_writer_may_die_at_any_step(spark, tmp_path, monkeypatch, step):
    """Before or after each write of a change, or halfway through replacing the folders."""
    index, first = _index(tmp_path), [(n, "red" if n % 2 else "green w") for n in range(12)]
    changed = [(1, "blue"), (2, "red green"), (30, "red")]
    term_index.build_term_index(_docs(spark, first), index)
    write, calls = buckets._write, []

    def dying(rows, at, path, dynamic):
        calls.append(path)
        if len(calls) == step:
            if step == 3:  # some folders were replaced
                write(rows.where("term_bucket < 2"), at, path, dynamic)
            raise _Died
        write(rows, at, path, dynamic)

    monkeypatch.setattr(buckets, "_write", dying)
    if step < 4:
        with pytest.raises(_Died):
            term_index.refresh_term_index(_docs(spark, changed), index)
    else:
        term_index.refresh_term_index(_docs(spark, changed), index)
    monkeypatch.setattr(buckets, "_write", write)
    if step == 1:  # nothing was staged
        assert _search(spark, index)["red"] == [1, 3, 5, 7, 9, 11]
        term_index.refresh_term_index(_docs(spark, changed), index)
    elif step < 4:  # the next change finishes it, whatever it is
        term_index.refresh_term_index(_docs(spark, [(0, "green w")]), index)
    full = _index(tmp_path, "full")
    term_index.build_term_index(_docs(spark, list((dict(first) | dict(changed)).items())), full)
    assert _search(spark, index) == _search(spark, full)
    assert sorted(map(tuple, term_index.all_counts(spark, index).collect())) == \
        sorted(map(tuple, term_index.all_counts(spark, full).collect()))


def test_an_unfinished_build_is_not_read_and_not_in_the_way(spark, tmp_path):
    index = _index(tmp_path)
    with pytest.raises(FileNotFoundError):
        term_index.read_postings(spark, index)
    os.makedirs(f"{index.path}/key_bucket=0/term_bucket=0")  # a build that was cut off
    with pytest.raises(FileNotFoundError):
        term_index.read_postings(spark, index)
    term_index.build_term_index(_docs(spark, [(1, "red")]), index)
    os.remove(f"{index.layout.counts}/_SUCCESS")  # the counts were cut off
    term_index.refresh_term_index(_docs(spark, [(3, "red")]), index)
    assert _search(spark, index)["red"] == [1, 3]
    assert {r.term: r.n for r in term_index.all_counts(spark, index).collect()} == {"": 2, "red": 2}


def test_counts_are_those_of_the_entries_asked_for(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "parse_json(concat('{\"a\":', id % 3, ',\"b\":', id % 5, '}')) as v")
    index = path_index.PathIndex(str(tmp_path / "p"), "id", "v", 1)
    path_index.build_path_index(rows, index)
    wanted = [('$."a"', "number", "1"), ('$."b"', "number", "4")]
    counts, width = path_index.entry_counts(spark, index, wanted)
    assert counts == {wanted[0]: 100, wanted[1]: 60} and width == 8


def test_many_terms_plan_quickly(spark, tmp_path):
    index = _index(tmp_path)
    term_index.build_term_index(_docs(spark, [(1, "red"), (2, "w77")]), index)
    terms = [f"w{n}" for n in range(8000)]
    term_index.term_counts(spark, index, ["red"])
    start = time.perf_counter()
    wanted = term_index._terms(spark, index, terms)
    assert wanted.count("term_bucket") == 1 and time.perf_counter() - start < 2
    assert term_index.term_counts(spark, index, terms)[0] == {"w77": 1}


def test_path_index_refresh(spark, tmp_path):
    def rows(*texts):
        return spark.createDataFrame(texts, "id long, j string").select(
            "id", F.parse_json("j").alias("v"))

    index = path_index.PathIndex(str(tmp_path / "p"), "id", "v", 4)
    path_index.build_path_index(rows((1, '{"a":[{"b":1,"c":2}]}'), (2, '{"a":1}'), (3, "[1]")), index)
    path_index.refresh_path_index(rows((2, '{"z":1}'), (4, '{"a":[{"b":1},{"c":2}]}')), index)
    now = rows((1, '{"a":[{"b":1,"c":2}]}'), (2, '{"z":1}'), (3, "[1]"),
               (4, '{"a":[{"b":1},{"c":2}]}'))
    requests = json_search.patterns(spark, {
        "a": '{"a":1}', "z": '{"z":1.0}', "one": '{"a":[{"b":1,"c":2}]}', "b": '{"a":[{"b":1}]}',
        "bare": "1", "all": "{}"})
    for corpus in (json_search.JsonLookup(index, now), json_search.JsonScan(now, "id", "v")):
        assert by_query(json_search.json_matches(requests, corpus).collect(), "row_id") == {
            "z": [2], "one": [1], "b": [1, 4], "bare": [3], "all": [1, 2, 4]}
    compacted = path_index.PathIndex(str(tmp_path / "c"), "id", "v", 8)
    path_index.compact_path_index(spark, index, compacted)
    assert sorted(map(tuple, path_index.read_entries(spark, compacted).collect())) \
        == sorted(map(tuple, path_index.read_entries(spark, index).collect()))


def test_path_index_sync(spark, tmp_path):
    def rows(values):
        return spark.createDataFrame(list(values.items()), "id long, j string").select(
            "id", F.parse_json("j").alias("v"))

    index = path_index.PathIndex(str(tmp_path / "p"), "id", "v", 4)
    values = {1: '{"a":1,"b":2}', 2: '{"a":1}', 3: "[1]", 4: None}
    assert path_index.sync_path_index(rows(values), index)
    assert not path_index.sync_path_index(rows(values | {1: '{"b":2, "a":1}'}), index)
    later = values | {2: '{"z":1}', 5: '{"a":1}'}
    assert path_index.sync_path_index(rows(later), index)
    assert not path_index.sync_path_index(rows(later), index)
    requests = json_search.patterns(spark, {"a": '{"a":1}', "z": '{"z":1}', "one": "1"})
    found = json_search.json_matches(requests, json_search.JsonLookup(index, rows(later)))
    assert by_query(found.collect(), "row_id") == {"a": [1, 5], "z": [2], "one": [3]}
    assert path_index.sync_path_index(rows({k: v for k, v in later.items() if k not in (3, 5)}), index)
    found = json_search.json_matches(requests, json_search.JsonLookup(index, rows(later)))
    assert by_query(found.collect(), "row_id") == {"a": [1], "z": [2]}


# ---- plans ----------------------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_its_buckets_with_a_pushed_filter(spark, tmp_path):
    index = _index(tmp_path)
    term_index.build_term_index(_docs(spark, [(n, f"w{n}") for n in range(50)]), index)
    requests = ask.plain(spark, {"q": "w7"}, "simple")
    plan = _plan(match.matches(requests, match.Lookup(index)))
    folders = {d for k in range(4) for d in os.listdir(f"{index.path}/key_bucket={k}")}
    assert len(folders) == 4
    assert "PartitionFilters: [isnotnull(term_bucket" in plan or "PartitionFilters: [(term_bucket" \
        in plan or "PartitionFilters: [term_bucket" in plan
    assert "EqualTo(term,w7)" in plan
    assert "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_frequent_terms_are_split_over_files_and_lookups_cut_them_down(spark, tmp_path):
    """Every document has one term, and one document holds a third of all words."""
    rows = spark.range(20000).selectExpr("id", "concat('the w', id % 500) as text").unionByName(
        spark.range(1).selectExpr("30000L as id", "repeat('the zz ', 10000) as text"))
    index = _index(tmp_path)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        term_index.build_term_index(rows, index)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    the = spark.read.parquet(index.path).where("term = 'the'")
    assert the.count() == 20001
    assert the.select(F.input_file_name()).distinct().count() > 1
    requests = ask.strict(spark, {"a": "the & w7", "b": "the <-> zz <-> the", "c": "the"}, "simple")
    found = match.matches(requests, match.Lookup(index))
    counted = {r["query_id"]: r["n_docs"] for r in match.counts(requests, found).collect()}
    assert counted == {"a": 40, "b": 1, "c": 20001}
    rare = ask.strict(spark, {"a": "the & w7"}, "simple")
    led, _ = match.Lookup(index).documents(rare, False)
    assert led.leads == ("w7",)
    assert "LeftSemi" in _plan(match.matches(rare, match.Lookup(index)))


def test_phrases_of_frequent_words_read_the_postings_of_pairs(spark, tmp_path):
    rng = random.Random(6)
    rows = [(n, " ".join(rng.choices(["of", "the", "and", "red", f"w{n % 9}"], weights=[6, 8, 4, 1, 1], k=25))) for n in range(200)]
    docs = _docs(spark, rows)
    frequent = frequent_terms(docs, "id", list(TEXT), "simple", share=0.5)
    assert set(frequent) >= {"of", "the", "and"} and not any(t.startswith("w") for t in frequent)
    frequent = ("of", "the", "and")
    plain_index, index = _index(tmp_path), term_index.TermIndex(
        str(tmp_path / "pairs"), "id", TEXT, "simple", 4, frequent=frequent)
    for where in (plain_index, index):
        term_index.build_term_index(docs, where)
    asked = ask.strict(spark, {
        "a": "of <-> the", "b": "of <-> the <-> and", "c": "the <-> red <-> of <-> the", "d": "red <-> of", "e": "the",
        "f": "!(of <-> the) & red", "g": "the <-> the <-> the", "h": "of <-> (the | red) <-> and", "i": "(of <-> the) | w3"}, "simple")
    found = [by_query(match.matches(asked, match.Lookup(i)).collect(), "doc_id") for i in (plain_index, index)]
    assert found[0] == found[1] == by_query(match.matches(asked, match.Scan(docs, "id", list(TEXT))).collect(), "doc_id")
    one = ask.strict(spark, {"a": "of <-> the"}, "simple")
    plan = _plan(match.matches(one, match.Lookup(index)))
    assert "EqualTo(term,of the)" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    ranked = [sorted(map(tuple, rank.ranked(one, match.Lookup(i)).collect())) for i in (plain_index, index)]
    assert ranked[0] == ranked[1] and ranked[0]
    term_index.refresh_term_index(_docs(spark, [(3, "and of the end"), (500, "the of")]), index)
    later = by_query(match.matches(one, match.Lookup(index)).collect(), "doc_id")["a"]
    assert 3 in later and 500 not in later
    assert not term_index.sync_term_index(_docs(spark, [(n, t) for n, t in rows if n != 3] + [(3, "and of the end"), (500, "the of")]), index)
    other = term_index.TermIndex(index.path, "id", TEXT, "simple", 4, frequent=("of",))
    assert term_index.sync_term_index(_docs(spark, rows), other)  # read in another way


def test_scan_matches_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(60_000).selectExpr("id", "repeat(concat('red green ', uuid()), 3) as text").write.parquet(path)
    docs = spark.read.schema("id long, text string").parquet(path)
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) > 2 << 20
    requests = ask.strict(spark, ASKED, "simple")
    plan = _plan(match.matches(requests, match.Scan(docs, "id", list(TEXT))))
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan


def test_scalar_pattern_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.sql("select id, parse_json(to_json(named_struct('brand', concat('b', id)))) v "
              "from range(9)").write.parquet(path)
    rows = spark.read.schema("id long, v variant").parquet(path)
    plan = _plan(rows.where(jsonb.contains("v", {"brand": "b3"})).select("id"))
    assert "EqualTo(v.`0`,b3)" in plan
    assert "v:struct<0:string" in plan.replace(" ", "")


# ---- base tables ----------------------------------------------------------------------------

def test_loading_is_repeatable(spark, tmp_path):
    target = str(tmp_path / "t")
    empty = tables.create_table(spark, target, tables.ARTICLES)
    assert empty.count() == 0
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], tables.ARTICLES)
    assert tables.load_if_empty(rows, target)
    assert not tables.load_if_empty(rows, target)
    more = spark.createDataFrame([(2, "x", "y"), (3, "e", "f")], tables.ARTICLES)
    tables.load_new(more, target, "id")
    tables.load_new(more, target, "id")
    tables.create_table(spark, target, tables.ARTICLES)
    got = sorted(map(tuple, tables.read_table(spark, target, tables.ARTICLES).collect()))
    assert got == [(1, "a", "b"), (2, "c", "d"), (3, "e", "f")]
    products = tables.create_table(spark, str(tmp_path / "p"), tables.PRODUCTS)
    assert products.schema["attributes"].dataType.simpleString() == "variant"


def test_rejects(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "c", "d")], tables.ARTICLES)
    good, bad = tables.split_rejects(rows, ["title", "body"])
    assert [r.id for r in good.collect()] == [2] and [r.id for r in bad.collect()] == [1]


def _session(master, named=None, set_to=None):
    conf = SimpleNamespace(get=lambda name, default: named)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_to)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_work_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "n").startswith(f"{named.rstrip('/')}/n-")
    assert work_folder(_session("yarn", "hdfs://a/b/"), "n").startswith("hdfs://a/b/n-")
    assert work_folder(_session("yarn", None, "hdfs://c/d"), "n").startswith("hdfs://c/d/n-")
    assert os.path.isdir(os.path.dirname(work_folder(_session("local[4]"), "n")))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_folder(_session(master), "n")


def test_work_is_dropped_on_demand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("trawl.session._made", [])
    folder = work_folder(spark, "dropped")
    spark.range(3).write.parquet(folder)
    drop_work(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("folder", [False, True])
@pytest.mark.parametrize("query", ["index_stream", "index_stream_updates", "index_stream_late", "path_index_stream"])
def test_streams_read_tables_that_are_files_or_folders(spark, tmp_path, query, folder):
    rows = [(i, f"the of and to la des {i}", ("fr", "en")[i % 2], f"src{i % 4}") for i in range(12)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    orders = spark.createDataFrame([(i, "OFP"[i % 3], 1.5 * i, ("1-URGENT", "5-LOW")[i % 2]) for i in range(12)],
                                   "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    for name, table in (("documents", texts), ("orders", orders)):
        if folder:
            table.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            table.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    found = entry.queries()[query](spark, str(tmp_path)).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], set()).add(r[1])
    if query == "index_stream":
        assert by == {"hot": set(range(12))}
    elif query == "path_index_stream":
        assert by["urgent"] == {i for i in range(12) if i % 2 == 0}
        assert by["low"] == {i for i in range(12) if i % 2 == 1} and "old" not in by
    else:
        assert by["src"] == {0, 4, 8}
        assert by["fr"] == set(range(1, 12, 2))


def test_frequent_terms_count_documents_without_postings(spark, monkeypatch):
    """Rows that share a key, null too, are one document; no postings are made or shuffled to find out."""
    def refused(*_, **__):
        raise AssertionError("postings are not needed")

    monkeypatch.setattr("trawl.operators.postings.text_postings", refused)
    rows = [(1, "a b a", "c"), (2, "a", None), (3, "b-x", "a"), (4, None, "z")]
    fields = [("t", "A"), ("u", "B")]
    once = spark.createDataFrame(rows, "id long, t string, u string")
    assert frequent_terms(once, "id", fields, "simple", share=0.25) == ("a", "b", "b-x", "c", "x", "z")
    assert frequent_terms(once, "id", fields, "simple", share=0.6) == ("a",)
    again = [(1, "b", "c"), (1, "a", "c"), (None, "b", "q"), (None, "q", "q")]
    twice = spark.createDataFrame(rows + again, "id long, t string, u string")
    assert frequent_terms(twice, "id", fields, "simple", share=0.4) == ("a", "b")
    assert frequent_terms(twice, "id", fields, "simple", share=0.2, most=3) == ("a", "b", "b-x")


@pytest.mark.parametrize("make, name", [(entry._small_products, "part"), (entry._priced, "orders")])
def test_json_of_a_table_in_one_split_is_made_on_all_cores(spark, tmp_path, make, name):
    rows = {"part": "id as p_partkey, 'a b' as p_name, 'SMALL' as p_type, id as p_size",
            "orders": "id as o_orderkey, 'O' as o_orderstatus, id as o_totalprice, '5-LOW' as o_orderpriority"}
    given = spark.range(0, 50, 1, 1).selectExpr(*rows[name].split(", "))
    given.write.parquet(str(tmp_path / f"{name}.parquet"))
    made = make(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 50


def test_arriving_rows_are_dealt_out_to_all_cores(spark, tmp_path):
    spark.range(0, 50, 1, 1).write.parquet(str(tmp_path / "orders.parquet"))
    seen = []
    (entry._arriving(spark, str(tmp_path), "orders").writeStream
     .foreachBatch(lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())))
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [(spark.sparkContext.defaultParallelism, 50)]


@pytest.mark.parametrize("small", [True, False])
def test_rows_stay_where_they_are_when_few_keys_change(spark, tmp_path, monkeypatch, small):
    docs = _docs(spark, [(i, f"a{i} b") for i in range(20)] + [(None, "c")])
    index = _index(tmp_path)
    term_index.build_term_index(docs, index)
    monkeypatch.setattr(buckets, "LEAD_BYTES", buckets.LEAD_BYTES if small else 0)
    joined, dealt, whole = [], [], buckets.without
    kind = type(docs)
    hint = kind.hint

    def without(*args):
        joined.append((args[-1], plan_text(whole(*args))))
        return whole(*args)

    def watched(self, name, *args):
        dealt.append(name)
        return hint(self, name, *args)

    monkeypatch.setattr(buckets, "without", without)
    monkeypatch.setattr(kind, "hint", watched)
    changed = _docs(spark, [(3, "new b"), (None, "d")])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        term_index.refresh_term_index(changed, index)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [s for s, _ in joined] == [small] and ("BroadcastHashJoin" in joined[0][1]) == small
    assert dealt.count("rebalance") == 2  # staged rows and counts; what was staged is in its folders already
    now = _index(tmp_path, "now")
    term_index.build_term_index(docs.where("id <> 3").unionByName(changed), now)
    for read in (term_index.read_postings, term_index.all_counts):
        assert sorted(map(str, read(spark, index).collect())) == sorted(map(str, read(spark, now).collect()))


@pytest.mark.parametrize("most", [64, 3])
def test_changes_of_a_large_index_are_kept_beside_it(spark, tmp_path, monkeypatch, most):
    """A change does not write the index again, until its changes are many; rows are those of a full build."""
    monkeypatch.setattr(buckets, "LARGE_BYTES", 1)
    monkeypatch.setattr(buckets, "MOST_RECENT", most)
    monkeypatch.setattr(buckets, "MOST_GROWTH", 1000)
    index, full, written = _index(tmp_path), _index(tmp_path, "full"), []
    write = buckets._write
    monkeypatch.setattr(buckets, "_write", lambda rows, at, path, dynamic: (written.append(path), write(rows, at, path, dynamic)))
    now = {n: f"red w{n}" if n % 2 else "green" for n in range(40)}
    term_index.build_term_index(_docs(spark, list(now.items())), index)
    changes = [{3: "blue", 40: "red green"}, {3: "red", None: "green red"}, {40: "w3", 41: "red"}, {3: "green w3"}, {None: "red green"}]
    for change in changes:
        del written[:]
        now |= change
        for _ in range(2):  # repeating a change changes nothing
            term_index.refresh_term_index(_docs(spark, list(change.items())), index)
        if most == 64:
            assert all("/_recent/" in path for path in written)
    assert os.path.exists(index.layout.recent)
    del now[7], now[40]
    assert term_index.sync_term_index(_docs(spark, list(now.items())), index)
    assert not term_index.sync_term_index(_docs(spark, list(now.items())), index)
    term_index.build_term_index(_docs(spark, list(now.items())), full)

    def rows(i):
        return sorted(map(repr, term_index.read_postings(spark, i).collect()))

    assert rows(index) == rows(full) and _search(spark, index) == _search(spark, full)
    compacted = _index(tmp_path, "compacted")
    term_index.compact_term_index(spark, index, compacted)
    assert rows(compacted) == rows(full)


def test_an_unfinished_recent_change_is_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "LARGE_BYTES", 1)
    index, paths = _index(tmp_path), path_index.PathIndex(str(tmp_path / "p"), "id", "v", 4)
    term_index.build_term_index(_docs(spark, [(1, "red"), (2, "red")]), index)
    term_index.refresh_term_index(_docs(spark, [(2, "blue"), (3, "red")]), index)
    assert _search(spark, index)["red"] == [1, 3]
    os.remove(f"{index.layout.recent}/keys/change=1/_SUCCESS")  # cut off before its keys were written
    assert _search(spark, index)["red"] == [1, 2]
    term_index.refresh_term_index(_docs(spark, [(2, "green red"), (4, "red")]), index)
    assert _search(spark, index)["red"] == [1, 2, 4]

    def values(*texts):
        return spark.createDataFrame(texts, "id long, j string").select("id", F.parse_json("j").alias("v"))

    path_index.build_path_index(values((1, '{"a":1}'), (2, '{"a":1}')), paths)
    path_index.refresh_path_index(values((2, '{"z":1}'), (3, '{"a":1}')), paths)
    assert os.path.exists(paths.layout.recent)
    counts, _ = path_index.entry_counts(spark, paths, [('$."a"', "number", "1")])
    assert counts == {('$."a"', "number", "1"): 2}
    found = json_search.json_matches(json_search.patterns(spark, {"a": '{"a":1}', "z": '{"z":1}'}), json_search.JsonLookup(paths, values((1, "1"))))
    assert by_query(found.collect(), "row_id") == {"a": [1, 3], "z": [2]}
