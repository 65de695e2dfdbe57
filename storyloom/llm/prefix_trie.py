"""Trie of conversation prefixes: every distinct sequence of first turns, with its members, children, leaves and what sharing it saves.

Conversations become arrays of turn digests, and equal ones one path with a count, before anything is grouped by content.
Paths are hash-partitioned by the digest of their first turn. Subtries of up to `oversized` paths are built in applyInPandas as
pointer dictionaries, many in a bucket, and summed up in postorder without recursion. A larger subtrie is divided by its
next turn after the prefix that all its paths share, over and over; its own nodes are then summed from the tops of its parts.

Defined results: turns are ordered by turn, null first, ties by their digest; a null role or text is empty; rows without a
conv_id belong to no conversation; repeated rows are turns of their own; very long texts are hashed whole and equal texts
take no room twice; an empty table gives no rows; extra columns are ignored. A conversation's digests meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import read, slices, stage

#: Paths above which a subtrie is divided by its next turn, and paths that a task builds tries from at once. Neither changes a result.
OVERSIZED, BUCKET = 256, 2048
#: Low bits of conv_id that one string of members covers.
RUN = 12
#: Characters of a turn's digest: 128 bits in hexadecimal.
WIDTH = 32
NONE_END = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): t is the digest of a turn's role and text, b the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)
    one = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", t.alias("t"), F.octet_length(text).cast("long").alias("b")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["t"].alias("t"), x["b"].alias("b")))
    return one.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % every, then the own ones after h; h = crc32(c) % (most + 1)."""
    own = stage(turns_of(conversations), "trie-turns")
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.array().cast("array<struct<t:string,b:bigint>>")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    after = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), after).alias("turns"))


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(pid, path, n, first, ends) of each distinct conversation: how many there are, the smallest conv_id, the digest of all of them.

    Members are joined in runs of 4096 conv_ids, in order, and only these strings meet: a task hashes them as they come, so a
    conversation that a third of all share is one stream of strings and never one row.
    """
    pid = F.sha2(F.array_join("turns.t", ""), 256)
    keyed = conversations.select(pid.alias("pid"), F.shiftright("conv_id", RUN).alias("run"), "conv_id", F.col("turns").alias("path"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = stage(keyed.groupBy("pid", "run").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("first"), text.alias("ids")), "trie-runs")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in slices(batches):
            out = []
            for pid, ids in zip(batch.column("pid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if pid == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = pid, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["pid", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["pid", "ends"])

    ends = runs.select("pid", "run", "ids").repartition("pid").sortWithinPartitions("pid", "run").select("pid", "ids").mapInArrow(hashed, "pid string, ends string")
    paths = runs.groupBy("pid").agg(F.first("path").alias("path"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return paths.join(ends, "pid")


def build(frame: pd.DataFrame) -> list[tuple]:
    """Nodes of the subtries of a bucket as (gid, up_gid, *NODE); gid and up_gid only at a subtrie's top.

    frame: gid, up_gid, up (the conv_id above), depth (turns above), ts (digests, joined), bs (bytes of each), n, first, ends.
    """
    tops: dict[str, int] = {}
    kids: list[dict[str, int]] = []
    above: list[int] = []
    rows: list[list] = []  # gid, up_gid, conv_id, depth, parent, n, children, leaves, saved, ends, bytes

    def node(parent: int, depth: int, size: int, gid: str | None = None, up_gid: str | None = None, up: int | None = None) -> int:
        kids.append({})
        above.append(parent)
        rows.append([gid, up_gid, None, depth, up, 0, 0, 0, 0, NONE_END, int(size)])
        return len(rows) - 1

    for gid, up_gid, up, depth, ts, bs, n, first, ends in frame.itertuples(index=False, name=None):
        at = -1
        for i in range(len(ts) // WIDTH):
            t = ts[i * WIDTH : (i + 1) * WIDTH]
            found = (tops if i == 0 else kids[at]).get(gid if i == 0 else t)
            if found is None:
                found = node(at, depth + i + 1, bs[i], gid, up_gid, up) if i == 0 else node(at, depth + i + 1, bs[i])
                (tops if i == 0 else kids[at])[gid if i == 0 else t] = found
            at = found
            row = rows[at]
            row[5] += n
            row[2] = first if row[2] is None else min(row[2], first)
        rows[at][9] = ends
    for at in range(len(rows) - 1, -1, -1):  # children come after their parents, so this is a postorder
        row, parent = rows[at], above[at]
        row[6] = len(kids[at])
        row[7] = row[7] or 1
        row[8] += (row[5] - 1) * row[10]
        if parent >= 0:
            row[4] = rows[parent][2]
            rows[parent][7] += row[7]
            rows[parent][8] += row[8]
    return [tuple(row[:10]) for row in rows]


_BUILT = f"gid string, up_gid string, {NODE}"
_NAMES = [c.split()[0] for c in _BUILT.split(", ")]


def _small(work: DataFrame, bucket: int) -> DataFrame:
    """The nodes of subtries that fit a bucket together."""
    rows = work.count()
    if not rows:
        return work.sparkSession.createDataFrame([], _BUILT)
    many = -(-rows // bucket)
    ready = work.select(
        F.pmod(F.xxhash64("gid"), F.lit(many)).alias("bucket"), "gid", "up_gid", "up", F.col("depth").cast("long"),
        F.array_join(F.col("tail.t"), "").alias("ts"), F.col("tail.b").alias("bs"), "n", "first", "ends",
    )
    return ready.groupBy("bucket").applyInPandas(lambda frame: pd.DataFrame(build(frame.drop(columns="bucket")), columns=_NAMES), _BUILT)


def _shared(low: Column, high: Column) -> Column:
    """How many first turns two sorted ends of a group have in common; that is what all between them have in common."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a["t"] == b["t"], F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def trie(conversations: DataFrame, oversized: int = OVERSIZED, bucket: int = BUCKET) -> DataFrame:
    """The nodes of all prefixes of (conv_id, turns). tail holds a path's turns below its group, whose digest is gid."""
    paths = stage(distinct_paths(conversations), "trie-paths")
    whole = paths.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max(F.when(F.size("path") == 0, F.col("ends"))).alias("ends")).first()
    spark = conversations.sparkSession
    if whole["n"] is None:
        return spark.createDataFrame([], NODE)
    first_turn = F.col("path")[0]["t"]
    work = paths.where(F.size("path") > 0).select(
        first_turn.alias("gid"), F.lit("").alias("up_gid"), F.lit(whole["first"]).alias("up"), F.lit(0).alias("depth"), F.col("path").alias("tail"), "n", "first", "ends"
    )
    built: list[DataFrame] = []
    divided: list[DataFrame] = []
    while True:
        sizes = work.groupBy("gid").agg(F.count("*").alias("rows"))
        large = stage(sizes.where(F.col("rows") > oversized).select("gid"), "trie-large")
        if large.isEmpty():
            built.append(stage(_small(work, bucket), "trie-nodes"))
            break
        built.append(stage(_small(work.join(large, "gid", "left_anti"), bucket), "trie-nodes"))
        work = work.join(large, "gid", "left_semi")
        # The least and the greatest path of a group have in common what all of them have.
        groups = work.groupBy("gid").agg(
            F.min("tail").alias("low"), F.max("tail").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.first("up_gid").alias("up_gid"), F.first("up").alias("up"), F.first("depth").alias("depth"),
        )
        chain = groups.withColumn("k", _shared(F.col("low"), F.col("high")))
        chain = stage(chain.select("gid", "up_gid", "up", "depth", "n", "first", "k", F.slice(F.col("low.b"), F.lit(1), F.col("k")).alias("bs")), "trie-chains")
        below = work.select("gid", "tail", "n", "first", "ends").join(chain.select("gid", "k", F.col("first").alias("up"), "depth"), "gid")
        below = stage(
            below.select(F.col("gid").alias("up_gid"), "up", (F.col("depth") + F.col("k")).alias("depth"), F.slice("tail", F.col("k") + 1, F.greatest(F.size("tail"), F.lit(1))).alias("tail"), "n", "first", "ends"),
            "trie-below",
        )
        # At most one path ends where its group divides.
        stops = below.where(F.size("tail") == 0).select(F.col("up_gid").alias("gid"), F.col("ends"))
        divided.append(stage(chain.join(stops, "gid", "left").withColumn("ends", F.coalesce("ends", F.lit(NONE_END))), "trie-divided"))
        work = below.where(F.size("tail") > 0).withColumn("gid", F.sha2(F.concat("up_gid", F.col("tail")[0]["t"]), 256))

    nodes = [b.select(*[c for c in _NAMES[2:]]) for b in built]
    tops = built[-1].where("gid is not null").select("up_gid", "n_leaves", "saved_tokens")
    for level in range(len(divided) - 1, -1, -1):
        summed = stage(_summed(divided[level], tops), "trie-summed")
        # From the place of division upwards: each node of the chain adds its own saving to what lies below it.
        saved = F.col("saved") + F.aggregate(F.slice("bs", F.col("i") + 1, F.col("k")), F.lit(0).cast("long"), lambda a, b: a + b) * (F.col("n") - 1)
        last = F.col("i") == F.col("k") - 1
        each = summed.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select(
            "up_gid",
            "i",
            F.col("first").alias("conv_id"),
            (F.col("depth") + F.col("i") + 1).cast("long").alias("depth"),
            F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            saved.cast("long").alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(NONE_END).alias("ends_sha256"),
        )
        nodes.append(each.select(*_NAMES[2:]))
        tops = each.where("i = 0").select("up_gid", "n_leaves", "saved_tokens").unionByName(built[level].where("gid is not null").select("up_gid", "n_leaves", "saved_tokens"))
    under = tops.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    top = [(whole["first"], 0, None, whole["n"], under["kids"], under["leaves"] or 1, under["saved"] or 0, whole["ends"] or NONE_END)]
    nodes.append(spark.createDataFrame(top, NODE))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _summed(groups: DataFrame, tops: DataFrame) -> DataFrame:
    parts = tops.groupBy(F.col("up_gid").alias("gid")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return groups.join(parts, "gid")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(read(spark, sf_dir, "conversations")))


OP12_SQL = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS c
    FROM range(256) r(i))
),
own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM own, tab
),
reb AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
),
pre AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS stops FROM reb, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends
  FROM pre GROUP BY p, d
),
linked AS (
  SELECT c.p, c.d, c.conv_id, c.n, c.ends, u.conv_id AS up, CASE WHEN c.d > 0 THEN (c.n - 1) * octet_length(encode(c.p[c.d].body)) ELSE 0 END AS own_saving,
    (SELECT count(*) FROM nodes k WHERE k.d = c.d + 1 AND k.p[1:c.d] = c.p) AS kids
  FROM nodes c LEFT JOIN nodes u ON u.d = c.d - 1 AND u.p = c.p[1:c.d - 1]
),
sums AS (
  SELECT p[1:a] AS p, a AS d, count(*) FILTER (kids = 0) AS leaves, sum(own_saving) AS saved
  FROM linked, LATERAL (SELECT unnest(range(d + 1)) AS a) GROUP BY ALL
)
SELECT l.conv_id, l.d AS depth, l.up AS parent_conv_id, l.n AS n_convs, l.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, l.ends AS ends_sha256
FROM linked l JOIN sums s ON s.d = l.d AND s.p = l.p
"""
