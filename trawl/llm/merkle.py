"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows of a group (a source) are the leaves of a tree in ascending id order; ``FAN`` nodes in a row become
one node until one is left, the group's subroot. Subroots in order of their groups are the leaves of
the tree above, which has the number ``TOP``. H is the lower-case hex SHA-256 of hex texts one after
another; digests are kept as 32 bytes.

Every node above the leaves is one row with its children's digests. Such a node starts with a pointer to
its parent and the segment of siblings that lie on the way there, left and right of it. A round joins the
nodes with themselves: a node takes over the pointer of the node it points to and adds that one's
segments to its own, so that the distance doubles and the rounds needed are the logarithm of the tree's
height. Leaves point to nodes and nothing points to them, so they join once, when their parents have
reached the root, and their long proofs are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import ascii_lower
from trawl.llm.ordering import dealt, starts
from trawl.session import stored

FAN = 16
WIDTH = 32     # bytes of a digest
TOP = -1
NODE = ["tree", "level", "place"]
UP = [f"up_{name}" for name in NODE]
PATH = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: each ``-`` if null, else byte count, ``:`` and value."""
    def form(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(form, fields)))


def heights(n: int) -> int:
    """Levels above the leaves of a tree with n of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Stored tables of the nodes above ``leaves`` (tree, level, place, n, digest), a level each.

    ``n`` is the number of nodes that the tree has at the level. A node has at most ``FAN`` children.
    """
    found, below = [], leaves
    for _ in range(heights(most)):
        run = F.expr(f"place div {FAN}")
        kids = F.expr("transform(sort_array(collect_list(struct(place, digest))), c -> c.digest)")
        nodes = below.where("n > 1").groupBy("tree", "level", run.alias("place")).agg(
            F.expr(f"(first(n) + {FAN - 1}) div {FAN}").alias("n"), kids.alias("kids"))
        joined = F.expr("aggregate(kids, cast('' as binary), (a, k) -> concat(a, k))")
        nodes = nodes.select("tree", (F.col("level") + 1).alias("level"), "place", "n", joined.alias("kids"))
        below = stored(nodes.withColumn("digest", digest(hex_text(F.col("kids")))), "merkle-level")
        found.append(below)
    return found


def _pointed(nodes: DataFrame) -> DataFrame:
    """Adds the parent (``UP``) and the place among its children (``slot``); none for the root."""
    inner = "n > 1"
    at = f"if({inner}, place, tree)"
    root = f"tree = {TOP} and n = 1"
    return nodes.selectExpr(
        "*", f"if({root}, null, if({inner}, tree, {TOP}L)) as up_tree",
        f"if({root}, null, if({inner}, level + 1, 1)) as up_level",
        f"if({root}, null, {at} div {FAN}) as up_place", f"cast({at} % {FAN} as int) as slot")


def _step() -> Column:
    """What lies left and right of a child in its parent's children."""
    return F.expr(f"""array(named_struct('left', substring(kids, 1, slot * {WIDTH}),
        'right', substring(kids, (slot + 1) * {WIDTH} + 1)))""")


def _paths(nodes: DataFrame, depth: int) -> DataFrame:
    """(NODE, path): each node's siblings on its way to the root, nearest first, one step per level."""
    parents = nodes.select(*(F.col(c).alias(u) for c, u in zip(NODE, UP, strict=True)), "kids")
    near = _pointed(nodes.drop("kids")).join(parents, UP, "left")
    none = F.lit(None)
    first = near.select(
        *NODE, *(F.when(F.col("kids").isNotNull(), F.col(u)).otherwise(none).alias(u) for u in UP),
        F.when(F.col("kids").isNotNull(), _step()).otherwise(F.array().cast(PATH)).alias("path"))
    links, reach = stored(first, "merkle-links"), 1
    while reach < depth:
        far = links.select(*(F.col(c).alias(u) for c, u in zip(NODE, UP, strict=True)),
                           *(F.col(u).alias(f"far_{u}") for u in UP), F.col("path").alias("far_path"))
        moved = links.where("up_tree is not null").join(far, UP).select(
            *NODE, *(F.col(f"far_{u}").alias(u) for u in UP), F.concat("path", "far_path").alias("path"))
        # Nodes that have reached the root wait; they would all meet at one key.
        links, reach = stored(links.where("up_tree is null").unionByName(moved), "merkle-links"), 2 * reach
    return links.select(*NODE, "path")


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """(leaves with tree, level, place and n; most leaves of a tree; number of trees).

    Trees are numbered in the order of their groups. Only counts by range and group are summed up.
    """
    given = dealt(leaves, ["_group", "_id", "digest"], "merkle-leaves")
    runs = stored(given.groupBy("_part", "_group").agg(F.count("*").alias("_n")), "merkle-runs")
    groups = runs.groupBy("_group").agg(F.min("_part").alias("_first"), F.sum("_n").alias("n"))
    offsets = starts(groups.groupBy("_first").agg(F.count("*").alias("_trees")), "_first", "_trees", "_before")
    inside = F.row_number().over(Window.partitionBy("_first").orderBy(F.asc_nulls_first("_group"))) - 1
    trees = stored(groups.withColumn("_in", inside).join(offsets, "_first").select(
        F.col("_group").alias("_of"), (F.col("_before") + F.col("_in")).cast("long").alias("tree"), "n"), "merkle-trees")
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = runs.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(
        trees, F.col("_group").eqNullSafe(F.col("_of"))).select(
        F.col("_part").alias("_at"), "_of", "_start", "tree", "n")
    order = Window.partitionBy("_part", "_group").orderBy("_id", "digest", "_row")
    rows = given.withColumn("_in", F.row_number().over(order) - 1).join(
        begun, (F.col("_part") == F.col("_at")) & F.col("_group").eqNullSafe(F.col("_of")))
    placed = rows.select(*leaves.columns, "tree", F.lit(0).alias("level"),
                         (F.col("_start") + F.col("_in")).cast("long").alias("place"), "n")
    size = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    return stored(placed, "merkle-placed"), int(size[0]), int(size[1])


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row per input row: (id_col, leaf, subroot, root, proof_sha256, folded_root, verified).

    A row's leaf is the H of its ``fields``. ``proof_sha256`` is the H of all siblings on the way to the
    root; ``folded_root`` is what folding the row's leaf with them gives. Rows for which ``tampered`` is
    true are folded from the leaf they have after A to Z in ``text_col`` were lower-cased, so a row
    with any such letter is not ``verified``.

    Null groups form one group, before all others; groups go in bytewise order. Null ids come first in
    their group; rows with equal ids follow each other by leaf, and repeated rows are leaves of their
    own. Null fields differ from empty ones; texts are hashed in whole, however long. Columns that are
    not named are ignored, whatever their names. An empty table gives an empty result.
    """
    changed = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False))
    inputs = [F.col(f"`{name}`") for name in fields]
    lowered = [ascii_lower(c) if name == text_col else c for name, c in zip(fields, inputs, strict=True)]
    leaves = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{group_col}`").cast("string").alias("_group"),
                         leaf(inputs).alias("digest"), F.when(changed, leaf(lowered)).alias("_given"))
    rows, most, trees = _placed(leaves)
    node = [*NODE, "n", "digest"]
    below = _levels(rows.select(*node), most)
    subroots = stored(reduce(DataFrame.unionByName, [t.where("n = 1").select("tree", "digest")
                                                    for t in [rows, *below]]), "merkle-subroots")
    above = _levels(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"),
        F.lit(trees).cast("long").alias("n"), "digest"), trees)
    root = (above[-1] if above else subroots).select("digest").first()
    root = bytes(root["digest"]) if root else b""
    paths = None
    if below or above:
        nodes = reduce(DataFrame.unionByName, [*below, *above])
        paths = _paths(nodes, heights(most) + heights(trees))
        # Beside its path, a parent of leaves holds their siblings and the subroot of its tree.
        paths = paths.where("level = 1").join(nodes.where("level = 1").select(*NODE, "kids"), NODE).join(
            subroots.select("tree", F.col("digest").alias("_subroot")), "tree", "left")
        paths = paths.select(*(F.col(c).alias(u) for c, u in zip(NODE, UP, strict=True)), "path", "kids", "_subroot")
        proved = _pointed(rows).join(paths, UP, "left")
        way = F.when(F.col("kids").isNotNull(), F.concat(_step(), F.col("path"))).otherwise(F.array().cast(PATH))
    else:
        proved, way = rows.withColumn("_subroot", F.lit(None).cast("binary")), F.array().cast(PATH)
    proved = proved.withColumn("_way", way)
    siblings = F.expr("aggregate(_way, cast('' as binary), (a, s) -> concat(a, s.left, s.right))")
    folded = F.expr("""aggregate(_way, lower(hex(coalesce(_given, digest))), (a, s) ->
        sha2(cast(concat(lower(hex(s.left)), a, lower(hex(s.right))) as binary), 256))""")
    return proved.select(
        F.col("_id").alias(id_col), hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.when(F.col("n") > 1, F.col("_subroot")).otherwise(F.col("digest"))).alias("subroot"),
        F.lit(root.hex()).alias("root"), F.sha2(hex_text(siblings).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
