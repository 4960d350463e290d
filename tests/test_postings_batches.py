from collections import defaultdict

import pytest

from trawl.functions.analysis import with_entries
from trawl.operators import postings

ROWS = [("a", "full-text of the The", "of the end", None, 7), ("b", None, "the of the", "the of licensed versions", 8),
        (None, "", None, "", 9), ("d", "the", "--- 1-2-3 é", "of of of", None), ("e", "x of", "", "the x", 1)]
FIELDS = [("title", "A"), ("body", "D"), ("note", "D")]


def _given(spark):
    return spark.createDataFrame(ROWS, "id string, title string, body string, note string, at long")


@pytest.mark.parametrize("fields", [FIELDS[1:2], FIELDS[:2], FIELDS])
@pytest.mark.parametrize("config, frequent", [("simple", ()), ("english", ()), ("simple", ("of", "the", "x")),
                                              ("english", ("x", "licens", "version"))])
def test_postings_are_the_entries_of_each_row(spark, fields, config, frequent):
    places = defaultdict(list)
    for row in with_entries(_given(spark), fields, config).collect():
        for n, e in enumerate(row.entries):
            places[e.term, row.id, e.weight, None].append(e.pos)
            before = row.entries[n - 1] if n else None
            if n and before.term in frequent and e.term in frequent and e.pos == before.pos + 1:
                places[f"{before.term} {e.term}", row.id, before.weight, None].append(before.pos)
    found = postings.text_postings(_given(spark), "id", fields, config, True, "at", frequent).collect()
    own = [r for r in found if r.term == ""]
    assert sorted((str(r.doc_id), r.weight, r.version or 0, len(r.positions)) for r in own) == sorted(
        (str(i), "D", at or 0, 2) for i, *_, at in ROWS)
    words = [r for r in found if r.term != ""]
    assert {(r.term, r.doc_id, r.weight, r.version): r.positions for r in words} == {
        k: sorted(v) for k, v in places.items()}
    assert len(words) == len(places)


def test_a_batch_gives_its_postings_in_the_order_of_terms(spark):
    """So the sort of an index merges long runs, not one for every document."""
    docs = spark.createDataFrame([(n, f"w{n % 7} red w{n % 3}") for n in range(300)], "id long, body string").coalesce(1)
    found = postings.text_postings(docs, "id", [("body", "B")], "simple").collect()
    assert [(r.term, r.doc_id) for r in found] == sorted((r.term, r.doc_id) for r in found)
    assert len(found) == sum(len({f"w{n % 7}", "red", f"w{n % 3}"}) for n in range(300))


def test_a_table_without_rows_has_no_postings(spark):
    none = spark.createDataFrame([], "id long, body string")
    for config in ("simple", "english"):
        assert postings.text_postings(none, "id", [("body", "B")], config, True).collect() == []
