"""Text search requests as rows: a tree of wanted and unwanted terms and phrases.

A request set is one small table, one row per request::

    query_id, top_op, items array<struct<item_id, terms array<struct<offset, term>>>>,
    steps array<struct<op, n>>, groups array<array<int>>, terms array, leads array

An item is a word or a phrase; terms of a phrase with the same offset are alternatives at that place.
``steps`` is the request's tree in postfix order: ``item`` n, ``not``, and ``and`` or ``or`` of the last
n results. It is as long as the request; nothing is multiplied out. A document that holds a request
has an item of one of its ``groups`` at least; item -1 stands for every document. ``leads`` has the terms
of one place per group: the longest, which tends to be the rarest, until an index gives exact counts.
Request words go through the same analysis as documents.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.analysis import ANY_DOCUMENT, STOP_WORDS, let, with_entries
from trawl.session import SMALL_TERMS, local_table, pinned, ship_package, stored, with_column

ANY_ITEM = -1
WEB_PIECE = r'-*"[^"]*"|[^\s"]+'


@dataclass(frozen=True)
class Requests:
    """Analysed requests. ``terms`` is None when the set is too large to be broadcast."""

    asked: DataFrame
    rows: DataFrame
    config: str
    terms: tuple[str, ...] | None
    leads: tuple[str, ...] | None
    phrases: bool
    head: pa.Table | None = None

    @property
    def alternatives(self) -> bool:
        """Whether a phrase has alternatives at a place."""
        return any(len({t["offset"] for t in i["terms"]}) < len(i["terms"])
                   for row in self.head["items"].to_pylist() for i in row)

    @property
    def flat(self) -> bool:
        """Whether every request wants all its items."""
        return all(op == "item" or op == "and" and at == len(row) - 1 - tail or op == "or" and n == 1
                   for row in ([(s["op"], s["n"]) for s in steps] for steps in self.head["steps"].to_pylist())
                   for tail in [row[-1] == ("or", 1)] for at, (op, n) in enumerate(row))

    @property
    def small(self) -> bool:
        return self.terms is not None

    def led_by(self, counts: dict[str, int]) -> Requests:
        """The same requests, each group led by its place with the fewest occurrences."""
        def lead(items, group):
            places: dict[tuple, list[str]] = {}
            for i in items:
                if i["item_id"] in group:
                    for t in i["terms"]:
                        places.setdefault((i["item_id"], t["offset"]), []).append(t["term"])
            return min(places.values(), key=lambda p: (sum(counts.get(t, 0) for t in p), p)) if places else [ANY_DOCUMENT]

        leads = [sorted({t for g in groups for t in lead(items, g)}) for items, groups in
                 zip(self.head["items"].to_pylist(), self.head["groups"].to_pylist())]
        return replace(self, rows=with_column(self.rows, self.head, "leads", leads),
                       leads=tuple(sorted({t for row in leads for t in row})))


    def paired(self, frequent: tuple[str, ...]) -> Requests:
        """The same requests with two frequent words after each other in a phrase as one term.

        Words inside such pairs are left out; they are covered by them. Phrases with alternatives
        stay as they are.
        """
        known, items = set(frequent), []
        for row in self.head["items"].to_pylist():
            items.append([{"item_id": i["item_id"], "terms": _paired_terms(i["terms"], known)} for i in row])
        terms = [sorted({t["term"] for i in row for t in i["terms"]} | ({ANY_DOCUMENT} & set(was)))
                 for row, was in zip(items, self.head["terms"].to_pylist())]
        places = [_longest_leads(row, groups) for row, groups in zip(items, self.head["groups"].to_pylist())]
        head = self.head
        for name, values in (("items", items), ("terms", terms), ("leads", places)):
            at = head.column_names.index(name)
            head = head.set_column(at, name, pa.array(values, head.schema.field(name).type))
        return replace(self, rows=self.rows.sparkSession.createDataFrame(head, self.rows.schema), head=head,
                       terms=tuple(sorted({t for row in terms for t in row})),
                       leads=tuple(sorted({t for row in places for t in row})),
                       phrases=any(len(i["terms"]) > 1 for row in items for i in row))


def _paired_terms(terms: list[dict], known: set[str]) -> list[dict]:
    at = {t["offset"]: t["term"] for t in terms}
    if len(at) < len(terms):
        return terms
    pairs = {o: f"{w} {at[o + 1]}" for o, w in at.items() if w in known and at.get(o + 1) in known}
    covered = {o for first in pairs for o in (first, first + 1)}
    left = pairs | {o: w for o, w in at.items() if o not in covered}
    return [{"offset": o, "term": left[o]} for o in sorted(left)]


def _longest_leads(items: list[dict], groups: list[list[int]]) -> list[str]:
    """The terms of one place of each group, until an index gives exact counts."""
    leads = set()
    for group in groups:
        places: dict[tuple, list[str]] = {}
        for i in items:
            if i["item_id"] in group:
                for t in i["terms"]:
                    places.setdefault((i["item_id"], t["offset"]), []).append(t["term"])
        best = max(places.values(), key=lambda p: (-len(p), min(map(len, p)), p)) if places else [ANY_DOCUMENT]
        leads.update([ANY_DOCUMENT] if ANY_ITEM in group else best)
    return sorted(leads)


def _asked(spark: SparkSession, requests) -> DataFrame:
    if isinstance(requests, DataFrame):
        return requests.select("query_id", "text")
    return local_table(spark, query_id=list(requests), text=list(requests.values()))


def plain(spark: SparkSession, requests, config: str = "english") -> Requests:
    """Every word of the text, whatever its punctuation. ``requests``: dict or DataFrame."""
    asked = _asked(spark, requests)
    words = with_entries(asked, [("text", "D")], config).selectExpr(
        "query_id", "0 as clause_id", "posexplode(entries) as (item_id, entry)", "false as negated")
    return _requests(asked, _in_clauses(words), config)


def web(spark: SparkSession, requests, config: str = "english") -> Requests:
    """Search-box style: ``"a phrase"``, ``-unwanted``, ``OR``, other words all wanted."""
    asked = _asked(spark, requests)
    # OR separates clauses where a piece stands before and after it.
    ors = """transform(ps, (p, i) -> if(lower(p) = 'or' and i between 1 and size(ps) - 2
        and lower(ps[greatest(i - 1, 0)]) <> 'or', 1, 0))"""
    parts = let("ors", ors, """transform(ps, (p, i) -> named_struct(
        'clause_id', aggregate(slice(ors, 1, i + 1), 0, (a, x) -> a + x),
        'is_or', ors[i] = 1, 'negated', startswith(p, '-'), 'text', p))""")
    pieces = let("ps", f"regexp_extract_all(text, r'{WEB_PIECE}', 0)", parts)
    rows = (asked.selectExpr("query_id", f"posexplode({pieces}) as (item_id, p)")
            .where("not p.is_or").selectExpr("query_id", "p.clause_id", "item_id", "p.text", "p.negated"))
    words = with_entries(rows, [("text", "D")], config).selectExpr(
        "query_id", "clause_id", "item_id", "explode(entries) as entry", "negated")
    return _requests(asked, _in_clauses(words), config)


def strict(spark: SparkSession, requests, config: str = "english") -> Requests:
    """Written with ``&``, ``|``, ``!``, ``<->`` and parentheses. ``requests``: dict or DataFrame."""
    asked = _asked(spark, requests)
    kind = asked.schema["query_id"].dataType.simpleString()
    if isinstance(requests, DataFrame):
        ship_package(spark)
        trees = asked.mapInPandas(partial(_read_trees, config=config), f"query_id {kind}, {TREE}")
    else:
        read = [(q, *_strict_tree(text, config)) for q, text in requests.items()]
        trees = spark.createDataFrame([r for r in read if r[1]], f"query_id {kind}, {TREE}")
    trees = stored(trees, "request-trees")
    texts = trees.selectExpr("query_id", "posexplode(texts) as (item_id, t)")
    item = ["query_id", "0 as clause_id", "item_id"]
    words = with_entries(texts.selectExpr("query_id", "item_id", "t.text"), [("text", "D")], config).selectExpr(
        *item, "explode(entries) as entry", "false as negated")
    others = texts.selectExpr("query_id", "item_id", "inline(t.others)")
    others = with_entries(others, [("text", "D")], config).selectExpr(
        *item, "explode(transform(entries, e -> named_struct('term', e.term, 'weight', e.weight, 'pos', pos))) as entry",
        "false as negated")
    items = _items(words.unionByName(others)).selectExpr("query_id", f"{ITEMS} as items")
    return _requests(asked, items.join(trees.drop("texts"), "query_id"), config)


TREE = ("top_op string, texts array<struct<text:string,others:array<struct<pos:int,text:string>>>>, "
        "steps array<struct<op:string,n:int>>, groups array<array<int>>")
ITEMS = "transform(parts, p -> named_struct('item_id', p.item_id, 'terms', p.terms))"


def _items(words: DataFrame) -> DataFrame:
    """(query_id, parts): each request's items in order, a request's words being few."""
    part = ["query_id", "clause_id", "item_id", "negated"]
    items = (words.repartition("query_id").groupBy(*part)
             .agg(F.expr("sort_array(collect_set(struct(entry.pos, entry.term)))").alias("at"))
             .selectExpr(*part, """transform(at, t ->
                 named_struct('offset', t.pos - at[0].pos, 'term', t.term)) as terms"""))
    return items.groupBy("query_id").agg(F.expr(
        "sort_array(collect_list(struct(clause_id, item_id, negated, terms)))").alias("parts"))


def _in_clauses(words: DataFrame) -> DataFrame:
    """Requests that are OR-ed clauses of wanted and unwanted items."""
    def step(op: str, n: str) -> str:
        return f"named_struct('op', '{op}', 'n', {n})"

    item = f"if(p.negated, array({step('item', 'p.item_id')}, {step('not', '1')}), array({step('item', 'p.item_id')}))"
    mine = "filter(parts, p -> p.clause_id = c)"
    clause = f"concat(flatten(transform(own, p -> {item})), array({step('and', 'size(own)')}))"
    steps = f"""concat(flatten(transform(cs, c -> {let('own', mine, clause)})),
        array({step('or', 'size(cs)')}))"""
    # A clause of exclusions only starts from all documents.
    needed = "transform(filter(parts, p -> p.clause_id = c and not p.negated), p -> p.item_id)"
    groups = f"transform(cs, c -> {let('need', needed, f'if(size(need) = 0, array({ANY_ITEM}), need)')})"
    return _items(words).selectExpr(
        "query_id", "parts", "array_distinct(transform(parts, p -> p.clause_id)) as cs").selectExpr(
        "query_id", f"{ITEMS} as items", f"{steps} as steps", f"{groups} as groups",
        """case when size(cs) > 1 then 'or' when size(parts) = 1 and parts[0].negated then 'not'
           else 'and' end as top_op""")


def _requests(asked: DataFrame, rows: DataFrame, config: str) -> Requests:
    """Add each request's terms and leads, and fetch the requests where they are small."""
    place = """transform(array_distinct(transform(i.terms, t -> t.offset)), o -> transform(
        filter(i.terms, t -> t.offset = o), t -> t.term))"""
    lead = f"""if(array_contains(g, {ANY_ITEM}), array('{ANY_DOCUMENT}'), array_max(flatten(transform(
        filter(items, i -> array_contains(g, i.item_id)), i -> transform({place}, p -> struct(
            -size(p) as few, array_min(transform(p, t -> length(t))) as n, p as terms))))).terms)"""
    rows = rows.selectExpr(
        "query_id", "top_op", "items", "steps", "groups",
        f"array_distinct(flatten(array_compact(transform(groups, g -> {lead})))) as leads").selectExpr(
        "*", f"""array_distinct(concat(flatten(transform(items, i -> i.terms.term)),
            if(array_contains(leads, '{ANY_DOCUMENT}'), array('{ANY_DOCUMENT}'),
               cast(array() as array<string>)))) as terms""")
    table, head = pinned(rows, "requests")
    if head is None:
        return Requests(asked, table, config, None, None, True)
    terms = {t for row in head["terms"].to_pylist() for t in row}
    leads = {t for row in head["leads"].to_pylist() for t in row}
    if len(terms) > SMALL_TERMS:
        return Requests(asked, table, config, None, None, True)
    phrases = any(len(i["terms"]) > 1 for row in head["items"].to_pylist() for i in row)
    return Requests(asked, table, config, tuple(sorted(terms)), tuple(sorted(leads)), phrases, head)


# ---- the strict notation, read by operator precedence

TOKEN = re.compile(r"\s+|(<->|[&|!()])|([^\s&|!()<>]+)")
RANKS = {"|": 1, "&": 2, "<->": 3, "!": 4}
NAMES = {"|": "or", "&": "and"}
# A phrase may have so many forms that differ in their number of words; other alternatives are one form.
MOST_FORMS = 4096


@dataclass
class _Part:
    """What has been read so far of a request, as postfix steps; items in them are forms of phrases.

    ``forms`` are the phrases that the part may stand for inside a phrase, each a list of places with
    their alternative words, or None. ``holds`` and ``fails`` are groups of items, as in requests, of
    documents that hold the part or do not; None stands for every document. No ``steps``: stop words.
    """

    op: str
    steps: deque = field(default_factory=deque)
    holds: list = field(default_factory=list)
    fails: list = field(default_factory=list)
    forms: list | None = None


def _read_trees(batches: Iterator[pd.DataFrame], config: str) -> Iterator[pd.DataFrame]:
    names = ["query_id", "top_op", "texts", "steps", "groups"]
    for batch in batches:
        read = [(q, *_strict_tree(text or "", config)) for q, text in zip(batch["query_id"], batch["text"])]
        yield pd.DataFrame([r for r in read if r[1]], columns=names)


def _strict_tree(text: str, config: str) -> tuple:
    """(top_op, items, steps, groups) of one request; no top_op when it has no words. An item is the
    text of a phrase, and other words for some of its places."""
    part = _parsed(text, config)
    if part is None or not part.steps:
        return None, [], [], []
    ids: dict[tuple, int] = {}
    steps = [("item", ids.setdefault(n, len(ids))) if op == "item" else (op, n) for op, n in part.steps]
    groups = [[ANY_ITEM if i is None else ids[i] for i in g] for g in part.holds]
    return part.op, [_item(form) for form in ids], steps, [sorted(set(g)) for g in groups]


def _parsed(text: str, config: str) -> _Part | None:
    parts: list[_Part] = []
    waiting: list[str] = []
    operand = True      # whether an operand has to come next
    at = 0

    def refuse():
        raise ValueError(f"not a valid request: {text[:200]!r}")

    def apply():
        op = waiting.pop()
        if op == "(":
            refuse()
        right = parts.pop()
        parts.append(_negated(right, config) if op == "!" else _joined(op, parts.pop(), right, config))

    while at < len(text):
        found = TOKEN.match(text, at)
        if found is None:
            raise ValueError(f"not a valid request, only <-> joins words: {text[:200]!r}")
        at = found.end()
        token, word = found.groups()
        if word is not None or token in ("!", "("):
            if not operand:
                refuse()
            if word is not None:
                parts.append(_Part("term", forms=[[[word]]]))
                operand = False
            else:
                waiting.append(token)
        elif token is not None:
            if operand:
                refuse()
            if token == ")":
                while waiting and waiting[-1] != "(":
                    apply()
                if not waiting:
                    refuse()
                waiting.pop()
            else:
                while waiting and waiting[-1] != "(" and RANKS[waiting[-1]] >= RANKS[token]:
                    apply()
                waiting.append(token)
                operand = True
    if not parts and not waiting:
        return None
    if operand:
        refuse()
    while waiting:
        apply()
    return _settled(parts[0], config)


def _lexemes(text: str) -> list[str]:
    """Words that analysis makes of a text: a word with hyphens and its parts are several."""
    found = re.findall(r"[^\W_]+(?:-[^\W_]+)*", text.lower())
    return [w for word in found for w in ([word, *word.split("-")] if "-" in word else [word])]


def _blank(word: str, config: str) -> bool:
    """Whether nothing of a word is left after analysis."""
    found = _lexemes(word)
    return not found or (config == "english" and all(w in STOP_WORDS for w in found))


def _settled(part: _Part, config: str) -> _Part:
    """A part whose steps are written out: those of a word or phrase are its forms, of which one holds."""
    if part.op not in ("term", "phrase") or part.steps:
        return part
    forms = []
    for form in part.forms:
        kept = [[w for w in place if not _blank(w, config)] or place[:1] for place in form]
        if any(not _blank(w, config) for place in kept for w in place):
            forms.append(tuple(map(tuple, kept)))
    forms = list(dict.fromkeys(forms))
    part.steps.extend(("item", form) for form in forms)
    if len(forms) > 1:
        part.steps.append(("or", len(forms)))
    part.holds, part.fails = [[form] for form in forms], [[None]]
    return part


def _negated(part: _Part, config: str) -> _Part:
    part = _settled(part, config)
    if part.steps:
        part.steps.append(("not", 1))
    return _Part("not", part.steps, part.fails, part.holds)


def _joined(op: str, left: _Part, right: _Part, config: str) -> _Part:
    if op == "<->":
        if left.forms is None or right.forms is None:
            raise ValueError("a phrase may hold words and alternatives only")
        if len(left.forms) * len(right.forms) > MOST_FORMS:
            raise ValueError("a phrase has too many alternatives that differ in their number of words")
        if len(right.forms) == 1 and len(left.forms) == 1:
            left.forms[0].extend(right.forms[0])
            return _Part("phrase", forms=left.forms)
        return _Part("phrase", forms=[[*a, *b] for a in left.forms for b in right.forms])
    forms = _alternatives(left, right) if op == "|" else None
    left, right = _settled(left, config), _settled(right, config)
    if not left.steps or not right.steps:
        out = left if left.steps else right
        return _Part(out.op, out.steps, out.holds, out.fails, forms)
    name = NAMES[op]
    sides = 2
    if left.op == name:  # a & b & c is one step
        sides += left.steps.pop()[1] - 1
    if len(left.steps) < len(right.steps):
        right.steps.extendleft(reversed(left.steps))
        steps = right.steps
    else:
        left.steps.extend(right.steps)
        steps = left.steps
    steps.append((name, sides))
    both, one = (left.holds, right.holds), (left.fails, right.fails)
    if name == "and":
        return _Part(name, steps, _all_of(*both), _one_of(*one), forms)
    return _Part(name, steps, _one_of(*both), _all_of(*one), forms)


def _alternatives(left: _Part, right: _Part) -> list | None:
    """The forms of either part; single words that stay single in analysis are one form."""
    if left.forms is None or right.forms is None:
        return None

    def single(forms):
        return len(forms) == 1 and len(forms[0]) == 1 and all(len(_lexemes(w)) == 1 for w in forms[0][0][-1:])

    if single(left.forms) and single(right.forms):
        mine, other = left.forms[0][0], right.forms[0][0]
        if left.op != "or":
            return [[mine + other]]
        mine.extend(other)  # its steps are written out already
        return left.forms
    return left.forms + right.forms


def _all_of(left: list, right: list) -> list:
    """Both sides hold: their single groups together are one, of which any may lead."""
    single = [g for g in (left, right) if len(g) == 1 and g != [[None]]]
    if len(single) == 2:
        if len(left[0]) < len(right[0]):
            left, right = right, left
        left[0].extend(right[0])
        return left
    return single[0] if single else min(left, right, key=lambda g: (g == [[None]], len(g)))


def _one_of(left: list, right: list) -> list:
    if left == [[None]] or right == [[None]]:
        return [[None]]
    if len(left) < len(right):
        return [*left, *right]
    left.extend(right)
    return left


def _item(form: tuple) -> tuple[str, list[tuple[int, str]]]:
    """A phrase's text, of the first word of each place, and the other words with their positions."""
    pos, others = 1, []
    for place in form:
        others += [(pos, word) for word in place[1:]]
        pos += len(_lexemes(place[0]))
    return " ".join(place[0] for place in form), others
