"""Registered queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import (fingerprints, hardneg, idfiles, langid, licenses, lm, merkle, minhash, mixing, pieces,
                       pivots, quality, sharding)
from trawl.llm.common import LOWER, UPPER, remainder, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.known_licenses(spark))
    return found.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses_sql() -> str:
    def lines(text: str) -> str:
        plain = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){licenses.COPYRIGHT}', '', 'g')"
        form = f"' ' || replace(regexp_replace({plain}, '{licenses.PUNCTUATION}', '  ', 'g'), chr(10), " \
               "' ' || chr(10) || ' ') || ' '"
        for old, new in licenses.SPELLINGS.items():
            old, new = (f" {x.replace(' ', '  ')} " for x in (old, new))
            form = f"replace({form}, '{old}', '{new}')"
        return form

    known = [*licenses.TEXTS.items(), *((name, text) for text, name in licenses.NOTICES.items())]
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in known)
    one_line = "sha256(trim(regexp_replace({}, '[ \\n]+', ' ', 'g')))"
    return f"""WITH known AS (SELECT DISTINCT license, {one_line.format("lines")} AS digest
            FROM (SELECT license, {lines("text")} AS lines FROM (VALUES {rows}) AS v(license, text))),
        forms AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
        found AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, {one_line.format("line")} AS digest
            FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM forms))
            JOIN known USING (digest)),
        listed AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS line_licenses
            FROM found GROUP BY doc_id)
        SELECT doc_id, digest, license, coalesce(line_licenses, '') AS line_licenses
        FROM (SELECT doc_id, {one_line.format("lines")} AS digest FROM forms)
        LEFT JOIN known USING (digest) LEFT JOIN listed USING (doc_id)"""


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.text_form(own).alias("fingerprint"),
        fingerprints.text_form(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprints.n_distinct(own).alias("n_shingles_estimate"),
        fingerprints.containment(own, edited).alias("contained_in_edited"))


MOST_REPEATS = 2.0


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once at least and small sources up to twice."""
    mixture = mixing.mix(table(spark, sf_dir, "documents"), most_repeats=MOST_REPEATS)
    return mixture.rows.select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").cast("long").alias("epoch"),
        "mix_place", F.lit(mixture.exponent).alias("exponent"))


LEAST_QUALITY = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held_out = remainder("doc_id", 5) == 0
    forest = quality.fit(docs, labels, ~held_out)
    scored = quality.score(docs, forest, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


OP8_SQL = """WITH RECURSIVE rows AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    fit AS (SELECT * FROM rows WHERE e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reached AS (SELECT vec_id AS a, vec_id AS b FROM rows
        UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
    roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
    counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
    FROM roots LEFT JOIN counted USING (vec_id)"""

OP6_SQL = f"""WITH RECURSIVE ws AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i:
            w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM ws),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sets),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y
        ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * c >= 85 * (p.n + q.n - c)),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
    roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
    SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept
    FROM roots JOIN sizes USING (doc_id)"""

WORD_PIECES = idfiles.Encoding(public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)


def op9_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.encoded(table(spark, sf_dir, "documents"), WORD_PIECES)


PIECES_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text again."""
    found = pieces.encode_checked(table(spark, sf_dir, "documents"), PIECES_MODEL, keep=["doc_id"])
    return found.select("doc_id", F.size("pieces.piece_ids").cast("long").alias("n_pieces"),
                        F.col("pieces.piece_ids").alias("piece_ids"), F.col("pieces.lossless").alias("lossless"))


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """WITH fit AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id,
        list_inner_product(a.q, r.q)::BIGINT AS s FROM fit a JOIN fit r ON r.vec_id <> a.vec_id
        WHERE a.vec_id % 50 = 0),
    positives AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id
            ORDER BY s DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, s AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
    QUALIFY rank <= 3"""

MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), MANIFEST_FIELDS, tampered=tampered)


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in (*MANIFEST_FIELDS[:-1], text)]
        return f"sha256({' || '.join(parts)})"

    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END"
    byte = f"list_reduce(range(8), lambda a, b: {bit}, xor(c, x))"
    crc = f"""xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda d: ascii(d)::BIGINT), lambda c, x: {byte}, 4294967295::BIGINT))"""
    tree = """{name} AS (SELECT * FROM {leaves} UNION ALL
        SELECT tree, lvl + 1, place // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY place))
        FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // 16)"""
    def climb(state: str, run: str) -> str:
        rest = f"{state}.place % 16], {{}}k.hs[{state}.place % 16 + 2:]"
        return f"""{state}.lvl + 1, {state}.place // 16, ({state}.n + 15) // 16,
            {state}.proof || array_to_string(list_concat(k.hs[:{rest.format('')}), ''),
            sha256(array_to_string(list_concat(k.hs[:{rest.format(f'[{state}.h], ')}), ''))
            FROM {state} JOIN runs k ON k.tree = {run} AND k.lvl = {state}.lvl AND k.run = {state}.place // 16
            WHERE {state}.n > 1"""

    return f"""WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
        leaves AS MATERIALIZED (SELECT r, doc_id, leaf, other,
            dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, 0 AS lvl,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place,
            count(*) OVER (PARTITION BY source) AS n FROM given),
        start AS (SELECT tree, lvl, place, n, leaf AS h FROM leaves),
        {tree.format(name="low", leaves="start")},
        tops AS (SELECT -1 AS tree, 0 AS lvl, tree AS place, count(*) OVER () AS n, h FROM low WHERE n = 1),
        {tree.format(name="high", leaves="tops")},
        nodes AS MATERIALIZED (SELECT * FROM low UNION ALL SELECT * FROM high),
        runs AS MATERIALIZED (SELECT tree, lvl, place // 16 AS run, list(h ORDER BY place) AS hs
            FROM nodes WHERE n > 1 GROUP BY ALL),
        low_way AS (SELECT r, tree, lvl, place, n, '' AS proof, coalesce(other, leaf) AS h FROM leaves
            UNION ALL SELECT low_way.r, low_way.tree, {climb("low_way", "low_way.tree")}),
        high_way AS (SELECT r, 0 AS lvl, tree AS place, (SELECT count(*) FROM tops) AS n, proof, h
            FROM low_way WHERE n = 1
            UNION ALL SELECT high_way.r, {climb("high_way", "-1")}),
        root AS (SELECT h AS root FROM high WHERE n = 1)
        SELECT doc_id, leaf, tops.h AS subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root,
            w.h = root AS verified
        FROM high_way w JOIN leaves USING (r) JOIN tops ON tops.place = leaves.tree CROSS JOIN root WHERE w.n = 1"""


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    found = langid.predict(docs, langid.fit(docs.where(~held_out)), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "code_bits")


QUERIES = {query.__name__: query for query in (
    op1_licenses, op2_lm, op3_fingerprints, op4_mixing, op5_quality, op6_minhash, op7_sharding, op8_pivots, op9_idfiles,
    op10_pieces, op11_hardneg, op12_merkle, op13_langid)}
ORACLE_SQL = {"op1_licenses": _licenses_sql(), "op6_minhash": OP6_SQL, "op8_pivots": OP8_SQL,
              "op11_hardneg": OP11_SQL, "op12_merkle": _merkle_sql()}
