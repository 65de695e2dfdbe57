"""Merkle manifest of a dataset: a radix-ranked trie of row hashes, with a membership proof for every row.

A row's place in its group (a language) comes from hierarchical histograms of the digits of its doc_id: the ids of a cell of
4096, the cells of a range, the ranges of the group. At each level an exclusive running sum over at most 65 536 digits, and
the sum of these down a row's path, is its exact rank; rows are never sorted globally. Rank digits to the base of the fan-out
key the trie: rank >> 9 names a block of three levels, which is reduced from its longest prefixes to its shortest without
another shuffle. Block roots are the nodes of the next pass, until each group has one; the subroots go through the same
passes once more. Proofs come down the same blocks: a block's rows inherit the siblings of its root. Only DataFrame functions
are used, and what meets in one row is a block of 512 nodes at most.

Defined results: nulls in any column are hashed as `-`; a null doc_id comes first, a null lang is a group of its own and comes
first; very long texts are hashed whole; rows with one doc_id in one group are ordered by their leaf, and equal rows are
leaves of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm._common import global_positions, read, stage

#: Bits of a rank digit: the fan-out is 8. A block has three levels.
DIGIT = 3
BLOCK = 3 * DIGIT
#: Bits of doc_id below a cell, and of each digit above it. A null doc_id has a cell of its own before all others.
CELL, WIDE = 12, 16
NULL_CELL = -(1 << (63 - CELL)) - 1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def sized(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _before(part: list[str], by: str) -> Column:
    w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def ranked(rows: DataFrame) -> DataFrame:
    """Add rank (gapless from 0 in the group, by doc_id, then h) and n (rows of the group) to rows of (g, doc_id, h, uid, ..)."""
    celled = rows.withColumn("cell", F.coalesce(F.shiftright("doc_id", CELL), F.lit(NULL_CELL))).withColumn("low", F.coalesce(F.col("doc_id").bitwiseAND((1 << CELL) - 1), F.lit(0)))
    ids = stage(celled.groupBy("g", "cell", "low").agg(F.count("*").alias("n")), "merkle-ids")
    cells = ids.groupBy("g", "cell").agg(F.sum("n").alias("n")).withColumn("range", F.shiftright("cell", WIDE))
    ranges = cells.groupBy("g", "range").agg(F.sum("n").alias("n")).withColumn("top", F.shiftright("range", WIDE))
    tops = ranges.groupBy("g", "top").agg(F.sum("n").alias("n"))
    tops = tops.select("g", "top", _before(["g"], "top").alias("b"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    ranges = ranges.withColumn("a", _before(["g", "top"], "range")).join(tops, ["g", "top"]).select("g", "range", (F.col("a") + F.col("b")).alias("b"), "total")
    cells = cells.withColumn("a", _before(["g", "range"], "cell")).join(ranges, ["g", "range"]).select("g", "cell", (F.col("a") + F.col("b")).alias("b"), "total")
    ids_at = ids.withColumn("a", _before(["g", "cell"], "low")).join(cells, ["g", "cell"])
    placed = celled.join(ids_at.select("g", "cell", "low", (F.col("a") + F.col("b")).alias("rank"), F.col("n").alias("same"), "total"), ["g", "cell", "low"])
    wanted = [*rows.columns, "rank", F.col("total").alias("n")]
    if ids.where("n > 1").isEmpty():
        return placed.select(*wanted)
    # Rows that share a doc_id: their order among themselves. uid keeps equal rows apart, so no range of keys is too large.
    tied = global_positions(placed.where("same > 1"), ["g", "cell", "low", "h", "uid"], "merkle-ties", pos="_at")
    firsts = tied.groupBy("g", "cell", "low").agg(F.min("_at").alias("_first"))
    tied = tied.join(firsts, ["g", "cell", "low"]).withColumn("rank", F.col("rank") + F.col("_at") - F.col("_first"))
    return placed.where("same = 1").select(*wanted).unionByName(tied.select(*wanted))


def _reduced(nodes: DataFrame, level: int, keys: list[str], node: Column) -> DataFrame:
    """Runs of nodes by key; a run's digest is new where the group has several nodes at this level, else its only node's."""
    runs = nodes.groupBy("g", *keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(node)).alias("kids"))
    several = F.col("n") > (1 << (DIGIT * level))
    return runs.withColumn("h", F.when(several, F.sha2(F.array_join("kids.h", ""), 256)).otherwise(F.col("kids.h")[0]))


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """Three levels of the trie at once: (g, block, n, kids, h) from nodes (g, rank, n, h, item); n counts the group's nodes."""
    at = {name: F.shiftright("rank", DIGIT * k) for name, k in (("k1", 1), ("k2", 2), ("block", 3))}
    dealt = nodes.withColumns(at).repartition("g", "block")
    one = _reduced(dealt, 0, ["block", "k2", "k1"], F.struct("rank", "h", "item"))
    two = _reduced(one, 1, ["block", "k2"], F.struct("k1", "h", "kids"))
    return stage(_reduced(two, 2, ["block"], F.struct("k2", "h", "kids")), label)


def _down(nodes: DataFrame, level: int, carried: list[str]) -> DataFrame:
    """A row for each kid, its path longer by the siblings at this level."""
    out = nodes.select("g", "n", *carried, "path", F.col("kids.h").alias("hs"), F.posexplode("kids").alias("i", "kid"))
    left, right = F.array_join(F.slice("hs", F.lit(1), F.col("i")), ""), F.array_join(F.slice("hs", F.col("i") + 2, F.lit(1 << DIGIT)), "")
    own = F.array(F.struct(left.alias("l"), right.alias("r")))
    path = F.when(F.col("n") > (1 << (DIGIT * level)), F.concat(own, "path")).otherwise(F.col("path"))
    return out.select("g", "n", *carried, path.alias("path"), "kid.*")


def expanded(made: DataFrame, above: DataFrame) -> DataFrame:
    """(g, rank, h, item, subroot, path) of the nodes of blocks; above has (g, block, subroot, path) of the blocks."""
    x = made.drop("h").join(above, ["g", "block"])
    for level in (2, 1, 0):
        x = _down(x, level, ["subroot"])
    return x.select("g", "rank", "h", "item", "subroot", "path")


def passes(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Blocks of the nodes, blocks of their roots, and so on until each group has one root."""
    made = [blocks(nodes, label)]
    while (made[-1].agg(F.max("n")).first()[0] or 0) > (1 << BLOCK):
        up = made[-1].select("g", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << BLOCK) - 1), BLOCK).alias("n"), "h", F.lit(0).alias("item"))
        made.append(blocks(up, label))
    return made


def descended(made: list[DataFrame], above: DataFrame) -> DataFrame:
    for each in made[:0:-1]:
        above = expanded(each, above).select("g", F.col("rank").alias("block"), "subroot", "path")
    return expanded(made[0], above)


def manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """((g, doc_id, h, item, subroot, path) of each leaf, root) from leaves (g, doc_id, h, uid, item); groups are ordered by g."""
    nodes = ranked(leaves)
    made = passes(nodes.select("g", "rank", "n", "h", F.struct("doc_id", "item").alias("item")), "merkle-blocks")
    # One row for each group, in the order of g, as leaves of the tree above.
    subroots = global_positions(made[-1].select("g", "h"), ["g"], "merkle-groups", pos="rank")
    n = subroots.count()
    top = passes(subroots.select(F.lit("").alias("g"), "rank", F.lit(n).cast("long").alias("n"), "h", F.struct("g").alias("item")), "merkle-top")
    root = top[-1].first()
    none = F.array().cast("array<struct<l:string,r:string>>")
    groups = descended(top, top[-1].select("g", "block", F.lit("").alias("subroot"), none.alias("path")))
    above = groups.select("item.g", F.lit(0).cast("long").alias("block"), F.col("h").alias("subroot"), "path")
    found = descended(made, above)
    return found.select("g", "item.doc_id", "h", "item.item", "subroot", "path"), root and root["h"]


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, at: digest(at["l"], h, at["r"]))


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); tampered is the text to verify where it is not the row's own."""

    def leaf_of(text: Column) -> Column:
        return digest(*map(sized, (F.col(key), F.col("source"), F.col(group), F.col("n_chars"), text)))

    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("g"),
        F.col(key).cast("long").alias("doc_id"),
        leaf_of(F.col("text")).alias("h"),
        F.struct((F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_of(tampered))).alias("other")).alias("item"),
    )
    leaves = stage(leaves.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    found, root = manifest(leaves)
    back = folded(F.coalesce(F.col("item.other"), F.col("h")), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["l"], at["r"])), "")
    rows = found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), back.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return proofs(read(spark, sf_dir, "documents"), tampered=F.when(third, F.translate("text", UPPER, LOWER)))


OP13_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS c
    FROM range(256) r(i))
),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295) % 3 = 0 AS third
  FROM documents, tab
),
f AS (
  SELECT doc_id, lang, third, text,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d
),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN third THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM f
),
k AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM l
),
low(g, lvl, r, n, h) AS (
  SELECT coalesce('+' || lang, ''), 0, r, n, leaf FROM k
  UNION ALL
  SELECT g, lvl + 1, r // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM low WHERE n > 1 GROUP BY g, lvl, n, r // 8
),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, r, n, h) AS (
  SELECT 0, r, n, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, r // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM high WHERE n > 1 GROUP BY lvl, n, r // 8
),
runs AS (
  SELECT g, lvl, r // 8 AS run, list(h ORDER BY r) AS hs FROM low WHERE n > 1 GROUP BY g, lvl, r // 8
  UNION ALL
  SELECT NULL, lvl, r // 8, list(h ORDER BY r) FROM high WHERE n > 1 GROUP BY lvl, r // 8
),
walk(id, g, lvl, r, proof, fold) AS (
  SELECT row_number() OVER (), coalesce('+' || lang, ''), 0, r, '', coalesce(other, leaf) FROM k
  UNION ALL
  SELECT w.id, w.g, w.lvl + 1, w.r // 8,
    w.proof || array_to_string(hs[1:w.r % 8], '') || array_to_string(hs[w.r % 8 + 2:], ''),
    sha256(array_to_string(hs[1:w.r % 8], '') || w.fold || array_to_string(hs[w.r % 8 + 2:], ''))
  FROM walk w JOIN runs u ON u.g = w.g AND u.lvl = w.lvl AND u.run = w.r // 8
),
leafs AS (SELECT row_number() OVER () AS id, doc_id, leaf, coalesce('+' || lang, '') AS g FROM k),
climbed AS (
  SELECT w.id, w.proof, w.fold, s.subroot, s.r FROM walk w JOIN sub s ON s.g = w.g
  WHERE w.lvl = (SELECT max(lvl) FROM low x WHERE x.g = w.g)
),
climb(id, lvl, r, proof, fold) AS (
  SELECT id, 0, r, proof, fold FROM climbed
  UNION ALL
  SELECT w.id, w.lvl + 1, w.r // 8,
    w.proof || array_to_string(hs[1:w.r % 8], '') || array_to_string(hs[w.r % 8 + 2:], ''),
    sha256(array_to_string(hs[1:w.r % 8], '') || w.fold || array_to_string(hs[w.r % 8 + 2:], ''))
  FROM climb w JOIN runs u ON u.g IS NULL AND u.lvl = w.lvl AND u.run = w.r // 8
),
top AS (SELECT h AS root, lvl AS height FROM high WHERE n = 1)
SELECT doc_id, leaf, c.subroot, root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = root AS verified
FROM leafs JOIN climbed c USING (id) JOIN climb p USING (id), top WHERE p.lvl = height
"""
