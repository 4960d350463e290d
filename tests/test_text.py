import random
import time
import re

import pytest
from conftest import by_query

from trawl.functions.analysis import STOP_WORDS, with_entries
from trawl.functions.stemming import stem
from trawl.operators import match, postings, rank, shared_items
from trawl.operators.headline import headlines
from trawl.plans import requests as ask
from trawl.sources import term_index

FIELDS = [("title", "A"), ("body", "B")]
NOTES = [
    (1, "Harbour bridges", "Bridges crossing the harbour need yearly inspection."),
    (2, "Inspecting a rail bridge",
     "A rail bridge inspection covers bolts, welds and rail-bed drainage."),
    (3, "Night ferry", "The ferry crosses the harbour at night; no bridge is used."),
    (4, "Rail-bed repair", "Crews repaired the rail bed after floods."),
    (5, "Tunnels versus bridges", "Tunnels avoid storms. Bridges avoid floods."),
    (6, "The of and", "to be or not"),
    (7, "Signal", "Lamp and horn"),
    (8, "", ""),
    (9, None, "Yachts only"),
]
STRICT = {
    "bridge & inspection": [1, 2], "ferry | tunnel": [3, 5], "rail <-> bridge": [2],
    "rail <-> bed": [2, 4], "bolt <-> weld": [2], "weld <-> rail": [], "signal <-> lamp": [7],
    "bridge & !harbour": [2, 5], "!bridge": [4, 6, 7, 8, 9], "the & bridge & !(rail | harbour)": [5],
    "(ferry | rail) & !bed": [3], "rail <-> (bridge | bed)": [2, 4], "!(the | of)": [],
    "!!horn": [7], "rail-bed": [2, 4], "": [], "the": [], "!(bridge & harbour)": [2, 4, 5, 6, 7, 8, 9],
    "bolts <-> weld <-> and <-> rail-bed": [2], "weld <-> and <-> rail": [], "(the | horn) & lamp": [7], "(the | horn) & rail": [],
}
PLAIN = {"rail bed repair": [4], "the of": [], "Bridges, harbour!": [1, 3], "rail-bed drainage": [2]}
WEB = {'"rail bed" flood': [4], "ferry OR rail flood": [3, 4], "bridge -rail": [1, 3, 5],
       "-bridge -the": [4, 6, 7, 8, 9], 'ferry or -"bridge"': [3, 4, 6, 7, 8, 9],
       "OR ferry": [3], "ferry OR": [3], '"rail bed': [2, 4], 'bridge -"rail bridge" -ferry': [1, 5],
       "night OR or horn": [3, 7], "": []}
KINDS = [(ask.strict, STRICT), (ask.plain, PLAIN), (ask.web, WEB)]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "id long, title string, body string")


@pytest.fixture(scope="module")
def index(notes, tmp_path_factory):
    where = term_index.TermIndex(str(tmp_path_factory.mktemp("i") / "x"), "id", tuple(FIELDS),
                                 "english", 4)
    term_index.build_term_index(notes, where)
    return where


def expected(cases):
    return {q: ids for q, ids in cases.items() if ids}


@pytest.mark.parametrize("kind,cases", KINDS)
def test_scan_and_index_find_the_expected_notes(spark, notes, index, kind, cases):
    requests = kind(spark, {q: q for q in cases})
    assert requests.small
    for corpus in (match.Scan(notes, "id", FIELDS), match.Lookup(index)):
        found = match.matches(requests, corpus).collect()
        assert by_query(found, "doc_id") == expected(cases)


@pytest.mark.parametrize("kind,cases", KINDS)
def test_request_sets_that_are_not_broadcast(spark, notes, index, no_broadcast, kind, cases):
    requests = kind(spark, {q: q for q in cases})
    assert not requests.small
    for corpus in (match.Scan(notes, "id", FIELDS), match.Lookup(index)):
        matched = match.matches(requests, corpus)
        assert by_query(matched.collect(), "doc_id") == expected(cases)
    scored = rank.ranked(requests, match.Lookup(index)).collect()
    assert by_query(scored, "doc_id") == expected(cases)


def test_counts_keep_requests_without_results(spark, notes):
    requests = ask.web(spark, {q: q for q in WEB})
    matched = match.matches(requests, match.Scan(notes, "id", FIELDS))
    found = {r["query_id"]: r["n_docs"] for r in match.counts(requests, matched).collect()}
    assert found == {q: len(ids) for q, ids in WEB.items()}


def test_requests_from_a_table(spark, notes):
    table = spark.createDataFrame([(10, "rail bed"), (20, "ferry")], "query_id long, text string")
    requests = ask.plain(spark, table)
    found = match.matches(requests, match.Scan(notes, "id", FIELDS)).collect()
    assert by_query(found, "doc_id") == {10: [2, 4], 20: [3]}


def test_matching_rows_and_best_first(spark, notes):
    corpus = match.Scan(notes, "id", FIELDS)
    requests = ask.plain(spark, {"q": "rail bridge"})
    rows = match.matching_rows(notes, "id", match.matches(requests, corpus)).collect()
    assert [r["title"] for r in rows] == ["Inspecting a rail bridge"]
    requests = ask.strict(spark, {"q": "rail | flood"})
    ordered = [r["doc_id"] for r in rank.best_first(rank.ranked(requests, corpus)).collect()]
    assert ordered == [4, 2, 5]


@pytest.mark.parametrize("text", ["a &", "| b", "(a", "a b", "a <-> !b", "& &"])
def test_bad_strict_requests_are_refused(spark, text):
    with pytest.raises(ValueError):
        ask.strict(spark, {"q": text})


def test_configs_must_agree(spark, index):
    with pytest.raises(ValueError):
        match.matches(ask.plain(spark, {"q": "rail"}, "simple"), match.Lookup(index))


def test_words_and_positions(spark):
    df = spark.createDataFrame([(1, "Full-text search, the O'Neill's API_key x-1-y", "Next one")],
                               "id long, a string, b string")
    simple = with_entries(df, [("a", "A"), ("b", "B")], "simple").first()["entries"]
    assert [(e["term"], e["weight"], e["pos"]) for e in simple] == list(zip(
        "full-text full text search the o neill s api key x-1-y x 1 y next one".split(),
        "A" * 14 + "BB", range(1, 17)))
    english = with_entries(df, [("a", "A"), ("b", "B")], "english").first()["entries"]
    # "the" and "s" leave gaps; the second field follows the last kept position.
    assert [(e["term"], e["pos"]) for e in english] == [
        ("full-text", 1), ("full", 2), ("text", 3), ("search", 4), ("o", 6), ("neill", 7),
        ("api", 9), ("key", 10), ("x-1-y", 11), ("x", 12), ("1", 13), ("y", 14),
        ("next", 15), ("one", 16)]


def test_stems():
    pairs = """consistency consist knightly knight knackeries knackeri learning learn apis api
        indexes index searches search database databas machine machin generously generous
        flies fli ties tie dying die running run hoping hope hopping hop agreed agre feed feed
        rationalization ration relational relat ability abil communication communic news news
        innings inning analogies analog electricity electr possibly possibl gas gas this this
        kiwis kiwi say say enjoy enjoy happy happi effective effect bed bed full full""".split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))
    assert stem("mp3s") == "mp3s" and stem("ab") == "ab"


def test_postings_group_positions_by_term_and_weight(spark):
    df = spark.createDataFrame([(1, "b a b", "a c a")], "id long, t string, u string")
    rows = postings.text_postings(df, "id", [("t", "A"), ("u", "B")], "simple").collect()
    assert sorted((r.term, r.weight, r.positions) for r in rows) == [
        ("a", "A", [2]), ("a", "B", [4, 6]), ("b", "A", [1, 3]), ("c", "B", [5])]


# ---- against plain Python on random texts ---------------------------------------------------

WORDS = ["ab", "cd", "ef", "gh", "the", "zz"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return {n: " ".join(rng.choices(WORDS, weights=[9, 5, 3, 2, 20, 1], k=rng.randint(0, 300)))
            for n in range(60)}


def _random_request(rng, depth=0):
    kind = rng.choice(["word", "word", "phrase", "not", "and", "or"] if depth < 3 else ["word"])
    if kind == "word":
        return rng.choice(WORDS)
    if kind == "phrase":
        return " <-> ".join(rng.choices(WORDS, k=rng.randint(2, 3)))
    if kind == "not":
        return f"!({_random_request(rng, depth + 1)})"
    sides = [f"({_random_request(rng, depth + 1)})" for _ in range(2)]
    return (" & " if kind == "and" else " | ").join(sides)


def _holds(request, words):
    def leaf(m):
        phrase = m.group().split(" <-> ")
        return str(any(words[i:i + len(phrase)] == phrase for i in range(len(words))))

    source = re.sub(r"\w+( <-> \w+)*", leaf, request)
    return eval(source.replace("!", " not ").replace("&", " and ").replace("|", " or "))


def test_random_strict_requests(spark, texts):
    rng = random.Random(3)
    asked = {f"{n}": _random_request(rng) for n in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    requests = ask.strict(spark, asked, "simple")
    found = by_query(match.matches(requests, match.Scan(docs, "id", [("text", "D")])).collect(),
                     "doc_id")
    for query, request in asked.items():
        assert found.get(query, []) == [n for n, t in texts.items() if _holds(request, t.split())], \
            request


def test_random_strict_requests_from_a_table(spark, texts, no_broadcast):
    rng = random.Random(5)
    asked = [(n, _random_request(rng)) for n in range(30)] + [(99, ""), (100, None)]
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    requests = ask.strict(spark, spark.createDataFrame(asked, "query_id long, text string"), "simple")
    assert not requests.small
    found = by_query(match.matches(requests, match.Scan(docs, "id", [("text", "D")])).collect(), "doc_id")
    for query, request in asked:
        assert found.get(query, []) == [n for n, t in texts.items() if request and _holds(request, t.split())], request


def test_strict_requests_are_not_multiplied_out(spark):
    groups = " & ".join(f"(a{n} | b{n})" for n in range(20))
    start = time.perf_counter()
    top, items, steps, leads = ask._strict_tree(groups, "english")
    assert time.perf_counter() - start < 1
    assert (top, len(items), len(steps), leads) == ("and", 40, 61, [[0], [1]])
    nested = "x"
    for n in range(60):
        nested = f"!({nested} {'&|'[n % 2]} y{n})"
    ask._strict_tree(nested, "english")
    text = " ".join(f"a{n}" for n in range(20))
    docs = spark.createDataFrame([(1, text), (2, text.replace("a7 ", "b7 ")), (3, text.replace("a7 ", ""))],
                                 "id long, text string")
    requests = ask.strict(spark, {"q": groups}, "simple")
    assert by_query(match.matches(requests, match.Scan(docs, "id", [("text", "D")])).collect(), "doc_id") == {"q": [1, 2]}


@pytest.mark.parametrize("text", ["cat > dog", "a < b", "a <2> b", "a & ", "(a", "a b", "a <-> !b", "! & a", "a <-> (b & c)"])
def test_other_notations_are_refused(text):
    with pytest.raises(ValueError):
        ask._strict_tree(text, "simple")


def test_stop_words_are_the_127_of_the_public_list():
    assert len(set(STOP_WORDS)) == 127


def test_headline_marks_the_richest_window(spark):
    filler = " ".join(f"w{n}" for n in range(30))
    text = f"Rail, {filler} the rails; and bridges! {filler}"
    docs = spark.createDataFrame([(1, text), (2, "no rail"), (3, "one two three four five six rail")],
                                 "id long, body string")
    requests = ask.web(spark, {"q": "rail OR bridge", "t": "three -five"})
    matched = match.matches(requests, match.Scan(docs, "id", [("body", "B")]))
    found = {(r["query_id"], r["doc_id"]): r["headline"] for r in headlines(
        requests, matched, docs, "id", "body", 6, 5, "<b>", "</b>").collect()}
    assert found == {
        ("q", 1): "<b>rails</b>; and <b>bridges</b>! w0 w1 w2",
        ("q", 2): "no <b>rail</b>",
        ("q", 3): "three four five six <b>rail</b>"}


def test_headline_without_a_hit_shows_the_first_words(spark, notes):
    requests = ask.plain(spark, {"q": "signal"})
    matched = match.matches(requests, match.Scan(notes, "id", FIELDS))
    rows = headlines(requests, matched, notes, "id", "body", min_words=2).collect()
    assert [r["headline"] for r in rows] == ["Lamp and"]


def test_long_and_deep_strict_requests(spark):
    start = time.perf_counter()
    top, items, steps, groups = ask._strict_tree(" & ".join(f"w{n}" for n in range(20_000)), "simple")
    assert (top, len(items), len(steps), len(groups), len(groups[0])) == ("and", 20_000, 20_001, 1, 20_000)
    top, items, steps, groups = ask._strict_tree(" | ".join(f"w{n}" for n in range(20_000)), "simple")
    assert (top, len(items), len(steps), len(groups)) == ("or", 20_000, 20_001, 20_000)
    nested = "(" * 1000 + "a" + ")" * 1000 + "\n&\n" + "".join(f"(b{n} | !(c{n} & " for n in range(1000)) + "d" + "))" * 1000
    top, items, steps, _ = ask._strict_tree(nested, "simple")
    assert (top, len(items)) == ("and", 2002) and len(steps) == 2002 + 1 + 3000
    groups = " <-> ".join(f"(a{n} | b{n})" for n in range(30))
    top, items, steps, _ = ask._strict_tree(groups, "simple")
    assert (top, len(items), steps) == ("phrase", 1, [("item", 0)])
    assert time.perf_counter() - start < 5
    text = " ".join(f"{'ab'[n % 2]}{n}" for n in range(30))
    docs = spark.createDataFrame([(1, text), (2, text.replace("b7 ", "a7 ")), (3, text.replace("b7 ", "c7 "))], "id long, text string")
    requests = ask.strict(spark, {"q": groups, "r": "a0 <->\n(b1 | zz) <-> a2"}, "simple")
    assert by_query(match.matches(requests, match.Scan(docs, "id", [("text", "D")])).collect(), "doc_id") == {
        "q": [1, 2], "r": [1, 2, 3]}
    with pytest.raises(ValueError, match="too many"):
        ask._strict_tree(" <-> ".join(f"(a <-> b | c{n})" for n in range(30)), "simple")


ALTERNATIVES = {
    "rail <-> (bridge | bed | zzz)": [2, 4], "(night | rail) <-> (ferry | bed)": [2, 3, 4], "(rail | the) <-> bed": [2, 4],
    "(the | of) <-> rail <-> bed": [2, 4], "(rail-bed | harbour) <-> (drainage | need)": [1, 2], "rail <-> (zzz | yyy)": [],
    "!(rail <-> (bridge | bed)) & rail": [], "(bolts | welds) <-> (welds | rail <-> bed)": [2], "bed <-> (repair | after)": [4]}


@pytest.mark.parametrize("small", [True, False])
def test_alternatives_inside_phrases(spark, notes, index, monkeypatch, small):
    if not small:
        monkeypatch.setattr("trawl.plans.requests.SMALL_TERMS", 0)
    requests = ask.strict(spark, {q: q for q in ALTERNATIVES})
    assert requests.small == small
    for corpus in (match.Scan(notes, "id", FIELDS), match.Lookup(index)):
        found = match.matches(requests, corpus).collect()
        assert by_query(found, "doc_id") == expected(ALTERNATIVES)


def test_large_sets_of_phrases_are_found_as_sequences(spark, no_broadcast, monkeypatch):
    """Phrases of all lengths, with gaps, alternatives and a shared or absent key, against plain loops;
    no document meets a phrase on one frequent word alone."""
    words = [["a", "b", "a", "b", "c", "d", "a"], ["b", "a", "c"], ["a", "b", "c", "d", "a", "b", "e", "f"], ["a"] * 5, ["a", "b", "x", "c"]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(None, "a b c")], "id long, text string")
    phrases = sorted({" ".join(w[i:i + n]) for w in words for n in range(1, 8) for i in range(len(w)) if len(w[i:i + n]) == n}) + ["a c a", "zz a"]
    asked = spark.createDataFrame([(p, f'"{p}"') for p in phrases], "query_id string, text string")
    met = []
    joined = shared_items._term_hits
    monkeypatch.setattr(shared_items, "_term_hits", lambda items, *a: met.append(
        items.where("size(terms) > 1").count()) or joined(items, *a))
    found = match.matches(ask.web(spark, asked, "simple"), match.Scan(docs, "id", [("text", "D")])).where("doc_id is not null").collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in found) == sorted(
        (p, i) for p in phrases for i, w in enumerate(words) if f" {p} " in f" {' '.join(w)} ")
    assert met == [0]
    twice = docs.unionByName(spark.createDataFrame([(3, "c d")], docs.schema))
    again = match.matches(ask.web(spark, asked, "simple"), match.Scan(twice, "id", [("text", "D")]))
    got = {(r["query_id"], r["doc_id"]) for r in again.collect()}
    assert {(r["query_id"], r["doc_id"]) for r in found} | {("c d", 3), ("d", 3)} <= got
