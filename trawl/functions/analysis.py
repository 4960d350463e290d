"""Text to lexemes: each document's words, positions and weights, built inside its own row.

Row-wise array work is written as SQL expression text, for ``F.expr``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.stemming import stem_all
from trawl.session import ship_package, small_batches

# Runs of letters and digits, optionally joined by hyphens.
WORD = r"[\p{L}\p{N}]++(?:-[\p{L}\p{N}]++)*+"

# The public 127-word English stop list of the `english` configuration.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split()

CONFIGS = ("english", "simple")

# Every document also gets this term, so that "all documents" is an ordinary lookup.
ANY_DOCUMENT = ""


def let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once per row and uses it in ``body`` by name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def text_list(values) -> str:
    """Strings as a SQL list of literals."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def words(text: str) -> str:
    """Lower-case words in order; ``full-text`` gives ``full-text``, ``full``, ``text``."""
    return let("ws", f"regexp_extract_all(lower({text}), r'{WORD}', 0)", """
        if(exists(ws, w -> contains(w, '-')),
           flatten(transform(ws, w -> if(contains(w, '-'), concat(array(w), split(w, '-')), array(w)))),
           ws)""")


def _entries(field: str, weight: str, config: str) -> str:
    entries = f"""transform({words(f"coalesce(`{field}`, '')")}, (w, i) ->
        named_struct('term', w, 'weight', '{weight}', 'pos', i + 1))"""
    if config == "english":
        return f"filter({entries}, e -> e.term not in ({text_list(STOP_WORDS)}))"
    return entries


def with_entries(df: DataFrame, fields: list[tuple[str, str]], config: str,
                 to: str = "entries") -> DataFrame:
    """Add ``array<struct<term, weight, pos>>`` for weighted text fields, in position order.

    Stop words leave a gap in the positions. A later field continues after the last kept
    position of the earlier ones, so a phrase may cross the border. No rows are exchanged.
    """
    if config not in CONFIGS:
        raise ValueError(f"config must be one of {CONFIGS}, not {config!r}")
    columns = [f"_{to}_{n}" for n in range(len(fields))]
    df = df.withColumns({column: F.expr(_entries(field, weight, config))
                         for column, (field, weight) in zip(columns, fields)})
    if config == "english":
        ship_package(df.sparkSession)
        small_batches(df.sparkSession)
        df = df.withColumns({f"{c}_stems": stem_all(F.col(f"{c}.term")) for c in columns})
        df = df.withColumns({c: F.expr(f"""zip_with({c}, {c}_stems, (e, s) ->
            named_struct('term', s, 'weight', e.weight, 'pos', e.pos))""") for c in columns})
    joined = columns[0]
    for column in columns[1:]:
        joined = let("before", joined, f"""concat(before, transform({column}, e -> named_struct(
            'term', e.term, 'weight', e.weight,
            'pos', e.pos + coalesce(try_element_at(before, -1).pos, 0))))""")
    dropped = [c for c in df.columns if c.startswith(f"_{to}_")]
    return df.withColumn(to, F.expr(joined)).drop(*dropped)


def grouped(entries: str) -> str:
    """``array<struct<term, weight, positions>>``: the runs of equal terms after a sort.

    The document's own row holds all of its words, so they are grouped there in n log n and
    postings leave the scan already aggregated, ahead of any shuffle.
    """
    starts = """if(size(es) > 0, filter(sequence(0, size(es) - 1), i ->
        i = 0 or es[i].term <> es[greatest(i - 1, 0)].term
        or es[i].weight <> es[greatest(i - 1, 0)].weight), cast(array() as array<int>))"""
    runs = """transform(firsts, (first, k) -> named_struct(
        'term', es[first].term, 'weight', es[first].weight,
        'positions', transform(
            slice(es, first + 1, coalesce(get(firsts, k + 1), size(es)) - first), e -> e.pos)))"""
    return let("es", f"sort_array({entries})", let("firsts", starts, runs))


def document_entry(fields: list[tuple[str, str]] = (), config: str = "") -> str:
    """The posting that stands for the document itself; its two positions are a hash of how its
    fields are read and of each field, null or not, by which a changed document is known."""
    read = text_list([" ".join([config, *(f"{name}:{weight}" for name, weight in fields)])])
    parts = "".join(f", `{name}` is null, `{name}`" for name, _ in fields)
    digest = f"xxhash64({read}{parts})" if fields else "0L"
    halves = let("digest", digest, """array(cast(shiftright(digest, 32) as int),
        cast(pmod(digest, 4294967296L) - 2147483648L as int))""")
    return f"named_struct('term', '{ANY_DOCUMENT}', 'weight', 'D', 'positions', {halves})"


def with_lexemes(df: DataFrame, raw: str, config: str, to: str) -> DataFrame:
    """Add the lexeme of each word of a string array, in place: a stop word becomes ``''``."""
    if config == "english":
        ship_package(df.sparkSession)
        small_batches(df.sparkSession)
        kept = F.expr(f"""transform({raw}, w ->
            if(lower(w) in ({text_list(STOP_WORDS)}), '', lower(w)))""")
        return df.withColumn(to, stem_all(kept))
    return df.withColumn(to, F.expr(f"transform({raw}, w -> lower(w))"))
