"""A variant's nodes as (path, type, value) entries, all levels walked inside one expression."""

from __future__ import annotations

from trawl.functions.analysis import let
from trawl.functions.jsonb import ARRAY, OBJECT, get, number_text

KEY = "key"  # path and type of the entries that key tests look for
LEAVES = "leaves"  # type of the entry, with an empty path, whose value is a row's number of leaf entries
EMPTY = "empty"  # type of the entry of an empty container; its value is the container's kind

USUAL_DEPTH = 8  # levels that a fold opens


def _deepest(value: str) -> str:
    """SQL for how deep the brackets of a variant's text are nested; those in strings do not count."""
    bare = f"""regexp_replace(regexp_replace(to_json({value}), r'\\\\.', ''), r'"[^"]*+"', '')"""
    step = "if(b in ('[', '{'), 1, -1)"
    return f"""aggregate(regexp_extract_all({bare}, r'[\\[\\]{{}}]', 0), named_struct('now', 0, 'most', 0), (d, b) ->
        named_struct('now', d.now + {step}, 'most', greatest(d.most, d.now + {step})), d -> d.most)"""


def nodes(value: str) -> str:
    """SQL for ``array<struct<path, vtype, value, leaf, at>>`` of all nodes of a variant.

    Array positions are left out of paths: ``$."tags"[]``; they are in ``at``, outermost first, so path
    and ``at`` together name a node. ``leaf`` marks scalars and empty containers. Each step of the fold
    opens one level, so nothing is exchanged or read twice. A document that is not done after
    ``USUAL_DEPTH`` levels is opened further, as many at a time and as often as its text is nested. A
    fold copies its state at each step, so what was seen before is kept out of the inner ones.
    """
    node = "array<struct<path:string,vtype:string,value:string,leaf:boolean,at:array<int>>>"

    def opened(v: str) -> str:
        return f"'v', {v}, 'object', {get(v, '$', OBJECT)}, 'array', {get(v, '$', ARRAY)}"

    kind = """case when n.object is not null then 'object' when n.array is not null then 'array'
        when stored = 'VOID' then 'null' when stored = 'BOOLEAN' then 'boolean'
        when stored = 'STRING' then 'string' else 'number' end"""
    text = f"""case when kind in ('object', 'array', 'null') then ''
        when kind = 'number' then {number_text('n.v')} else {get('n.v', '$', 'string')} end"""
    scalar_type = "if(n.object is null and n.array is null, schema_of_variant(n.v), '')"
    described = let("stored", scalar_type, let("kind", kind, f"""named_struct(
        'path', n.path, 'vtype', kind, 'value', coalesce({text}, ''),
        'leaf', coalesce(cardinality(n.object), cardinality(n.array), 0) <= 0, 'at', n.at)"""))
    key = r"""concat('."', replace(replace(m.key, r'\', r'\\'), '"', r'\"'), '"')"""
    children = f"""coalesce(
        transform(map_entries(n.object), m ->
            named_struct('path', concat(n.path, {key}), 'at', n.at, {opened('m.value')})),
        transform(n.array, (x, i) -> named_struct('path', concat(n.path, '[]'), 'at', array_append(n.at, i), {opened('x')})),
        cast(array() as array<struct<path:string,at:array<int>,v:variant,object:{OBJECT},array:{ARRAY}>>))"""
    fold = f"""(state, step) -> if(size(state.open) = 0, state, named_struct(
        'seen', concat(state.seen, transform(state.open, n -> {described})),
        'open', flatten(transform(state.open, n -> {children}))))"""

    def levels(start: str) -> str:
        return f"""aggregate(sequence(1, {USUAL_DEPTH}), named_struct('seen', cast(array() as {node}), 'open', {start}), {fold})"""

    first = levels(f"array(named_struct('path', '$', 'at', cast(array() as array<int>), {opened(value)}))")
    further = let("part", levels("begun.open"), "named_struct('seen', concat(begun.seen, part.seen), 'open', part.open)")
    times = f"greatest(1, cast({_deepest(value)} div {USUAL_DEPTH} as int))"
    rest = f"""aggregate(sequence(1, {times}), done, (begun, time) -> if(size(begun.open) = 0, begun, {further}),
        begun -> begun.seen)"""
    return f"""if({value} is null, cast(array() as {node}),
        {let("done", first, f"if(size(done.open) = 0, done.seen, {rest})")})"""


def keys(value: str) -> str:
    """SQL for the strings for which a key test on the variant holds."""
    def text(x):
        return f"if(schema_of_variant({x}) = 'STRING', {get(x, '$', 'string')}, null)"

    return f"""array_distinct(coalesce(
        map_keys({get(value, '$', OBJECT)}),
        array_compact(transform({get(value, '$', ARRAY)}, x -> {text('x')})),
        array_compact(array({text(value)})), cast(array() as array<string>)))"""


def entries(value: str) -> str:
    """SQL for ``array<struct<path, vtype, value, at>>`` of nodes and keys, with repetitions.

    An empty container has a second entry of type ``EMPTY``, and one entry of type ``LEAVES`` tells how many
    different leaf entries (scalars and those) there are.
    """
    empty = f"named_struct('path', n.path, 'vtype', '{EMPTY}', 'value', n.vtype, 'at', n.at)"
    own = "struct(n.path, n.vtype, n.value, n.at)"
    alike = "size(array_distinct(transform(leaves, e -> struct(e.path, e.vtype, e.value))))"
    count = f"named_struct('path', '', 'vtype', '{LEAVES}', 'value', cast({alike} as string), 'at', cast(array() as array<int>))"
    leaf = f"if(n.vtype in ('object', 'array'), {empty}, {own})"
    leaves = let("leaves", f"transform(filter(ns, n -> n.leaf), n -> {leaf})", f"""concat(
        transform(ns, n -> {own}), filter(leaves, e -> e.vtype = '{EMPTY}'), if(size(ns) > 0, array({count}),
        cast(array() as array<struct<path:string,vtype:string,value:string,at:array<int>>>)))""")
    return f"""concat({let("ns", nodes(value), leaves)},
        transform({keys(value)}, k -> named_struct('path', '{KEY}', 'vtype', '{KEY}', 'value', k,
            'at', cast(array() as array<int>))))"""


def within_entries(value: str) -> str:
    """SQL for ``array<struct<path, vtype, value>>``: the leaf entries that a variant which is contained
    in this one may have."""
    may = f"""if(n.vtype in ('object', 'array'), named_struct('path', n.path, 'vtype', '{EMPTY}', 'value', n.vtype),
        struct(n.path, n.vtype, n.value))"""
    # A bare scalar is also contained in a top-level array that has it as an element.
    bare = "filter(ns, n -> n.path = '$[]' and n.vtype not in ('object', 'array'))"
    return let("ns", nodes(value), f"""array_distinct(concat(transform(ns, n -> {may}),
        transform({bare}, n -> named_struct('path', '$', 'vtype', n.vtype, 'value', n.value))))""")


def entry_text(e: str) -> str:
    """SQL for an entry as one string; paths quote their keys, so no two entries coincide."""
    return f"concat({e}.path, ' ', {e}.vtype, ' ', {e}.value)"
