"""A Merkle manifest of a table: a digest for each row, a tree for each group of rows, a tree over the groups, and a proof for each row.

Rows get their rank in their group by a range partitioning. The low BITS binary digits of a rank place a row in a block of 2^BITS rows; the digit columns are grouped away one after the
other within the blocks, which one shuffle brings together, and each grouping nests the structs of the one before. Blocks are rows of a tree above them, made in the same way, until one
is left. A transform over the nested structs and an explode then give each row its path; no join looks up a sibling. What stands above a block comes by a row for each block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shipping import stored

#: A block holds 2^BITS nodes: some 40 KB.
BITS = 8


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with g) and rank (from 0 in order within g), total (rows of g). Equal rows take any order, but each a rank of its own."""
    by = ["g", *order, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed).withColumn("_part", F.shiftright("_at", 33))
    # A row for each partition and group, in order of both: partitions and groups together at most.
    sizes = placed.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = stored(sizes.selectExpr("g", "_part", "_first", "sum(_n) over (partition by g order by _part) - _n as _start", "sum(_n) over (partition by g) as total"))
    return placed.join(sizes, ["g", "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_start")).drop("_at", "_part", "_first", "_start")


def nodes_of(level: int) -> Column:
    """Nodes of a group that are left after so many levels."""
    return F.ceil(F.col("total") / F.lit(1 << level))


def rolled(rows: DataFrame) -> DataFrame:
    """(g, block, total, node): a row for each block of rows (g, rank, total, node: a struct with h). A node has its digest h and its kids, two or one.

    Where only one node of the group is left it is passed on as it is, so that small groups have the height that they need.
    """
    digits = [f"d{k}" for k in range(BITS)]
    now = rows.select("g", F.shiftright("rank", BITS).alias("block"), "total", *(F.shiftright("rank", k).bitwiseAND(F.lit(1)).alias(d) for k, d in enumerate(digits)), "node")
    now = now.repartition("g", "block")
    for level, digit in enumerate(digits):
        now = now.groupBy("g", "block", "total", *digits[level + 1 :]).agg(F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("kids"))
        h = F.when(nodes_of(level) > 1, F.sha2(F.array_join("kids.node.h", ""), 256)).otherwise(F.col("kids")[0]["node"]["h"])
        now = now.select("g", "block", "total", *digits[level + 1 :], F.struct(h.alias("h"), F.col("kids.node").alias("kids")).alias("node"))
    return now


def kids_of(hashed: Column) -> Callable[[Column], Column]:
    """From a node and its path to its kids with theirs; hashed: whether the node is a digest of its kids, else it is one of them passed on."""

    def kids(x: Column) -> Column:
        def kid(own: Column, at: Column) -> Column:
            step = F.array(F.struct(F.get(x["node"]["kids"]["h"], 1 - at).alias("sibling"), (at == 1).alias("on_left")))
            return F.struct(own.alias("node"), F.when(hashed, F.concat(step, x["path"])).otherwise(x["path"]).alias("path"))

        return F.transform(x["node"]["kids"], kid)

    return kids


def paths(block: DataFrame) -> DataFrame:
    """block (g, block, total, node and more columns) taken apart: node is what rolled() was given, path its siblings within the block, upwards.

    A step of a path is (sibling: null where a node is hashed alone, on_left: whether the sibling stands on the left).
    """
    nodes = F.array(F.struct("node", F.array().cast("array<struct<sibling:string,on_left:boolean>>").alias("path")))
    for level in reversed(range(BITS)):
        nodes = F.flatten(F.transform(nodes, kids_of(nodes_of(level) > 1)))
    rest = [c for c in block.columns if c != "node"]
    return block.select(*rest, F.explode(nodes).alias("_x")).select(*rest, F.col("_x.node").alias("node"), F.col("_x.path").alias("path"))


def trees(rows: DataFrame) -> list[DataFrame]:
    """The blocks of rows (g, rank, total, node), the blocks of those blocks, and so on until each group has one."""
    levels = [stored(rolled(rows))]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = levels[-1].select("g", F.col("block").alias("rank"), nodes_of(BITS).alias("total"), F.struct(F.col("node.h").alias("h"), F.col("block").alias("below")).alias("node"))
        levels.append(stored(rolled(up)))
    return levels


def walked(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(node, path to the root, and the columns of above): above has g, its path above the group, and what else every row of the group is told."""
    told = [c for c in above.columns if c not in ("g", "above")]
    whole = F.concat("path", "above").alias("above")
    now = levels[-1].join(above, "g")
    for below in reversed(levels[:-1]):
        now = paths(now).select("g", F.col("node.below").alias("block"), whole, *told)
        now = below.join(now, ["g", "block"])
    return paths(now).select("node", whole, *told)


def merkle_manifest(rows: DataFrame, columns: tuple[str, ...], group_col: str, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep: struct, leaf, subroot, root, path): a row for each row, with the siblings from its leaf up to the root (see paths).

    A leaf is leaf_digest(columns). Per group the leaves stand in ascending order of id (null first; of equal ids by leaf, equal leaves in any order); while there are several nodes, every
    two in a row, the last perhaps alone, become the sha256 of their hex digests. The subroots, by group (null first, then by bytes), become the root in the same way. Nulls, empty and very
    long values, repeated rows and groups of any size are leaves like others; an empty table has no rows. keep names further columns; they stand in a struct, so no name can clash.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = rows.select(g.alias("g"), F.struct(leaf_digest(*(F.col(c) for c in columns)).alias("h"), F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep)).alias("keep")).alias("node"))
    leaves = ranked(stored(leaves).withColumns({"_id": F.col("node.id"), "_h": F.col("node.h")}), ["_id", "_h"])
    own = trees(leaves.select("g", "rank", "total", "node"))
    groups = own[-1].select(F.lit("").alias("g"), F.struct(F.col("node.h").alias("h"), F.col("g").alias("group")).alias("node"))
    over = trees(ranked(groups.withColumn("_g", F.col("node.group")), ["_g"]).select("g", "rank", "total", "node"))
    top = over[-1].select("g", F.array().cast("array<struct<sibling:string,on_left:boolean>>").alias("above"), F.col("node.h").alias("root"))
    above = stored(walked(over, top).select(F.col("node.group").alias("g"), "above", F.col("node.h").alias("subroot"), "root"))
    return walked(own, above).select(F.col("node.id").alias("id"), F.col("node.keep").alias("keep"), F.col("node.h").alias("leaf"), "subroot", "root", F.col("above").alias("path"))


def proof_digest(path: Column) -> Column:
    """sha256 of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.when(s["sibling"].isNull(), h).when(s["on_left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


# Trees of up to 2^20 rows a group and 2^4 groups: a level for each step, none of them recursive.
LEVELS, OVER = 20, 4


def oracle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    digest = lambda n: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    # crc32 of the decimal id, byte by byte and bit by bit
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    sql = f"""WITH d AS (SELECT *, {digest('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {digest('(n_chars + 1)')} END AS other FROM documents),
  r AS (SELECT doc_id, lang, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d), a0 AS (SELECT lang, i, n, leaf AS h FROM r)"""
    for k in range(LEVELS):
        sql += f", a{k + 1} AS (SELECT lang, i // 2 AS i, max((n + 1) // 2) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM (SELECT lang, i, n, h FROM a{k}) GROUP BY lang, i // 2)"
    sql += f", b0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a{LEVELS})"
    for k in range(OVER):
        sql += f", b{k + 1} AS (SELECT i // 2 AS i, max((n + 1) // 2) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM (SELECT i, n, h FROM b{k}) GROUP BY i // 2)"
    hashed = "CASE WHEN {n} <= 1 THEN {f} WHEN s.h IS NULL THEN sha256({f}) WHEN {i} % 2 = 1 THEN sha256(s.h || {f}) ELSE sha256({f} || s.h) END"
    sql += ", f0 AS (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS f, i, n, '' AS proof FROM r)"
    for k in range(LEVELS):
        sql += f", f{k + 1} AS (SELECT q.doc_id, q.lang, q.leaf, {hashed.format(n='q.n', f='q.f', i='q.i')} AS f, q.i // 2 AS i, (q.n + 1) // 2 AS n, q.proof || coalesce(s.h, '') AS proof FROM f{k} q LEFT JOIN a{k} s ON s.lang IS NOT DISTINCT FROM q.lang AND s.i = xor(q.i, 1))"
    sql += f", g0 AS (SELECT q.doc_id, q.leaf, q.f, q.proof, b0.h AS subroot, b0.i AS i, b0.n AS n FROM f{LEVELS} q JOIN b0 ON b0.lang IS NOT DISTINCT FROM q.lang)"
    for k in range(OVER):
        sql += f", g{k + 1} AS (SELECT q.doc_id, q.leaf, {hashed.format(n='q.n', f='q.f', i='q.i')} AS f, q.proof || coalesce(s.h, '') AS proof, q.subroot, q.i // 2 AS i, (q.n + 1) // 2 AS n FROM g{k} q LEFT JOIN b{k} s ON s.i = xor(q.i, 1))"
    return sql + f" SELECT q.doc_id, q.leaf, q.subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = t.h AS verified FROM g{OVER} q, b{OVER} t"


ORACLE_SQL = oracle_sql()
