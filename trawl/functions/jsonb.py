"""Containment and key tests on variant columns, as plain column expressions.

The pattern is known when the query is written, so it is unrolled into path extractions that
Spark pushes into the Parquet scan. Casts from variant are lenient (the string "32" reads as
the number 32), so every test also checks the stored type. ``value`` is a column name or any
other SQL expression of type variant.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.analysis import let, text_list

OBJECT = "map<string,variant>"
ARRAY = "array<variant>"
NUMBER_TYPES = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def get(value: str, path: str, kind: str) -> str:
    return f"try_variant_get({value}, {text_list([path])}, '{kind}')"


def parsed(text: str, strict: bool = True) -> str:
    """SQL for JSON text as a variant. Text that is not one JSON value fails the job, or gives
    NULL when not strict.

    Spark's parser stops after the first value and ignores what follows it. What follows cannot
    close a bracket and a brace at once, so text that is valid inside both is one value.
    """
    element = get(f"try_parse_json(concat('[', {text}, ']'))", "$[0]", "variant")
    member = f"""try_parse_json(concat('{{"v":', {text}, '}}'))"""
    value = f"if({member} is null, null, {element})"
    if not strict:
        return value
    failure = f"cast(raise_error(concat('not a JSON value: ', {text})) as variant)"
    return f"if({text} is null, null, coalesce({value}, {failure}))"


def number_text(value: str) -> str:
    """One spelling per numeric value: 1, 1.0 and 1e0 all give ``1``; NULL for other types.

    Integers and decimals are exact. A double is spelled out when one of a few decimal shapes
    holds it without loss, and is left in scientific form otherwise.
    """
    double = get(value, "$", "double")
    shapes = [let("_dec", get(value, "$", f"decimal(38,{scale})"),
                  f"if(cast(_dec as double) = {double}, cast(_dec as string), null)")
              for scale in (18, 0, 37)]
    text = f"""if(_type rlike '^(FLOAT|DOUBLE)', coalesce({', '.join(shapes)},
        cast({double} as string)), {get(value, '$', 'string')})"""
    trimmed = let(
        "_num", text, r"if(_num rlike r'^-?\d+\.\d+$', regexp_replace(_num, r'\.?0+$', ''), _num)")
    return let("_type", f"schema_of_variant({value})",
               f"if(_type rlike '{NUMBER_TYPES}', {trimmed}, null)")


def _child(value: str, base: str, key: str) -> tuple[str, str]:
    """Where a key's value is: a longer path, or a map entry for keys no path can name."""
    if re.fullmatch(r"[^'\]\\]+", key):
        return value, f"{base}['{key}']"
    return f"try_element_at({get(value, base, OBJECT)}, {text_list([key])})", "$"


def _whole(value: str, base: str) -> str:
    return value if base == "$" else get(value, base, "variant")


def _scalar(value: str, base: str, wanted) -> str:
    whole = _whole(value, base)
    if wanted is None:
        return f"is_variant_null({whole})"
    if isinstance(wanted, bool):
        return f"({get(value, base, 'boolean')} = {wanted} " \
               f"and schema_of_variant({whole}) = 'BOOLEAN')"
    if isinstance(wanted, str):
        return f"({get(value, base, 'string')} = {text_list([wanted])} " \
               f"and schema_of_variant({whole}) = 'STRING')"
    literal = str(wanted) if isinstance(wanted, (int, Decimal)) else repr(wanted)
    same = f"{number_text(whole)} = {number_text(f'''parse_json('{literal}')''')}"
    number = Decimal(literal)
    if abs(number) < Decimal(10) ** 20:
        # A test on the extracted number alone, which the scan can use.
        same = f"{get(value, base, 'decimal(38,18)')} = " \
               f"cast('{format(number, 'f')}' as decimal(38,18)) and {same}"
    return f"({same})"


def _all(tests: list[str]) -> str:
    return f"({' and '.join(tests)})" if tests else "true"


def _any(tests: list[str]) -> str:
    return f"({' or '.join(tests)})" if tests else "false"


def _holds(value: str, base: str, pattern, depth: int = 0) -> str:
    if isinstance(pattern, dict):
        if not pattern:
            return f"{get(value, base, OBJECT)} is not null"
        return _all([_holds(*_child(value, base, k), p, depth) for k, p in pattern.items()])
    if isinstance(pattern, list):
        array, x = get(value, base, ARRAY), f"_x{depth}"
        if not pattern:
            return f"{array} is not null"
        return _all([f"exists({array}, {x} -> {_holds(x, '$', p, depth + 1)})" for p in pattern])
    return _scalar(value, base, pattern)


def _read(pattern):
    """A pattern given as JSON text is read exactly; other values are taken as they are."""
    return json.loads(pattern, parse_float=Decimal) if isinstance(pattern, str) else pattern


def contains(value: str, pattern) -> Column:
    """Whether a variant contains a pattern (a dict, a list, or JSON text).

    Objects may have more keys, arrays more elements in any order; scalars must agree in type
    and value. The comparison starts at the top; a top-level array also contains a bare scalar.
    """
    pattern = _read(pattern)
    test = _holds(value, "$", pattern)
    if not isinstance(pattern, (dict, list)):
        element = f"exists({get(value, '$', ARRAY)}, _x -> {_holds('_x', '$', pattern)})"
        test = f"coalesce({test}, false) or coalesce({element}, false)"
    return F.expr(f"coalesce({test}, false)" if " or " in test else test)


def contained_by(value: str, document) -> Column:
    """Whether a variant is contained in a given document (a dict, a list, or JSON text)."""
    document = _read(document)
    tests = [_within(value, document, 0)]
    if isinstance(document, list):
        tests += [f"coalesce({_scalar(value, '$', d)}, false)" for d in document
                  if not isinstance(d, (dict, list))]
    return F.expr(_any(tests))


def _within(value: str, document, depth: int) -> str:
    if isinstance(document, dict):
        entries, m = get(value, "$", OBJECT), f"_m{depth}"
        names = f"_k in ({text_list(document)})" if document else "false"
        tests = [f"forall(map_keys({m}), _k -> {names})"]
        for key, part in document.items():
            name = text_list([key])
            tests.append(f"(not map_contains_key({m}, {name}) or "
                         f"{_within(f'try_element_at({m}, {name})', part, depth + 1)})")
        return f"coalesce({let(m, entries, _all(tests))}, false)"
    if isinstance(document, list):
        x = f"_x{depth}"
        some = _any([_within(x, part, depth + 1) for part in document])
        return f"coalesce(forall({get(value, '$', ARRAY)}, {x} -> {some}), false)"
    return f"coalesce({_scalar(value, '$', document)}, false)"


def _has_key(value: str, key: str) -> str:
    child, base = _child(value, "$", key)
    present = f"{_whole(child, base)} is not null"
    element = f"exists({get(value, '$', ARRAY)}, _x -> {_scalar('_x', '$', key)})"
    return f"({present} or coalesce({element}, false) " \
           f"or coalesce({_scalar(value, '$', key)}, false))"


def has_key(value: str, key: str) -> Column:
    """Whether a top-level key exists (also with a JSON null), or a top-level array holds the
    string, or the value is that string."""
    return F.expr(_has_key(value, key))


def has_any_key(value: str, keys: list[str]) -> Column:
    return F.expr(_any([_has_key(value, k) for k in keys]))


def has_all_keys(value: str, keys: list[str]) -> Column:
    return F.expr(_all([_has_key(value, k) for k in keys]))


def field(value: str, key: str, default: str = "—") -> Column:
    """A top-level string field, or a default where it is absent."""
    return F.expr(f"coalesce({get(*_child(value, '$', key), 'string')}, {text_list([default])})")


def mark(value: str, key: str) -> Column:
    """``✓`` where a top-level flag is true, else ``✗``."""
    return F.expr(f"if({get(*_child(value, '$', key), 'boolean')}, '✓', '✗')")
