"""Conversation prefix trie: every distinct beginning of a conversation as a node, by preorder intervals.

A turn becomes a token of 16 bytes (SHA-256 of role and text) with its number of words; texts do not
travel. The tokens of a conversation, one after the other, are its key. Distinct keys are ranked in the
order of their bytes by ranges, so the conversations that share a beginning have neighbouring
ranks, and a node is known by the least rank ``lo`` and the greatest rank ``hi`` that it is found
with. Nodes in the order of (lo, depth) are in preorder, and the subtree of a node ends where the
key of rank ``hi`` ends. Running sums of leaves and savings over that order are made range by range, with
the sums of the ranges before added; what a subtree holds is the difference of two of them. No step
goes down the trie level by level, and none gathers the children or members of a node.

Copies are merged into counts before anything is sorted, and nodes are counted with partial sums, so
a beginning that a third of all conversations share costs each task one row. The ids of the
conversations that end in a node are sorted by ranges and joined into texts of up to PIECE bytes, which
one stream a node feeds to the hash: a SHA-256 has to be taken in order, but it never holds more than a
piece. A key has 20 bytes a turn; Spark's limit of 2 GB a value bounds a conversation to 100 million turns.

Defined cases: null roles and texts are empty; rows with a null conversation id belong to no
conversation and are left out; turns that are null come first; turns of one number are ordered by their token; repeated
rows are turns of their own; an empty table has no node, not even a root, as there is no member; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.textbytes import lean, trim
from siltstone.runtime import partitions_for, session_partitions, small_batches, sound_unions, stage_table

#: Bytes of a token and of a turn in a key (token, then its words), and bytes of ids that go to the hash at a time.
TOKEN, ENTRY, PIECE = 16, 20, 1 << 20
#: Conversations that share a beginning in the production query, and the greatest id.
GROUP, LAST_ID = 20, (1 << 63) - 1
ROOT = bytes(TOKEN)

KEYS = "conv_id long, key binary, node binary"
STEPS = "node binary, parent binary, depth long, words long, n_convs long, conv_id long, rank long, ends long"
PIECES = "node binary, first long, piece string"
WORD = r"[^\x20\x09-\x0D]+"


def tokens(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, token, words) of every turn; places count from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(digest, 1, TOKEN).alias("token"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "token")
    dealt = rows.repartition(partitions_for(conversations), "conv_id")
    return dealt.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "token", "words")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % 4


def rebuilt(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """Turns of the production query: each conversation begins with turns of the first conversation of its group.

    Groups are the ids between multiples of ``group``. Every conversation also has a row of place 0
    without a token, so that it is known when it has no turn left.
    """
    sound_unions(turns.sparkSession)
    turns = stage_table(turns, "turns")
    place = F.col("place")
    own = turns.where(place > head_turns(F.col("conv_id"))).select("conv_id", F.lit(2).alias("source"), "place", "token", "words")
    stop = F.when(F.col("conv_id") > LAST_ID - group, F.lit(LAST_ID)).otherwise(F.col("conv_id") + (group - 1))
    lent = turns.where((F.pmod("conv_id", F.lit(group)) == 0) & (place <= 3)).select(F.explode(F.sequence("conv_id", stop)).alias("conv_id"), F.lit(1).alias("source"), "place", "token", "words")
    known = turns.where(place == 1).select("conv_id", F.lit(0).alias("source"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent.where(place <= head_turns(F.col("conv_id")))).unionByName(known)


def _node(parent: bytes, token: bytes) -> bytes:
    return hashlib.sha256(parent + token).digest()[:TOKEN]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its sorted turns; conversations without a row of source 0 are not in the table."""
    lean()
    now, known, key, node = None, False, bytearray(), ROOT
    for batch in batches:
        ids, keys, nodes = [], [], []
        for conv, token, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token", "words")), strict=True):
            if conv != now:
                if known:
                    ids.append(now)
                    keys.append(bytes(key))
                    nodes.append(node)
                now, known, key, node = conv, token is None, bytearray(), ROOT
            if token is not None and known:
                key += token + min(words, (1 << 32) - 1).to_bytes(4, "big")
                node = _node(node, token)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary())], ["conv_id", "key", "node"])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bytes(key)], pa.binary()), pa.array([node], pa.binary())], ["conv_id", "key", "node"])
    trim()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the way to every key, from the root on."""
    names = ["node", "parent", "depth", "words", "n_convs", "conv_id", "rank", "ends"]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
    for batch in batches:
        rows: list[tuple] = []
        for key, n, conv, rank in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "conv_id", "rank")), strict=True):
            node, depth = ROOT, len(key) // ENTRY
            rows.append((ROOT, None, 0, 0, n, conv, rank, 0 if depth else n))
            for d in range(depth):
                parent, token, words = node, key[d * ENTRY : d * ENTRY + TOKEN], int.from_bytes(key[d * ENTRY + TOKEN : (d + 1) * ENTRY], "big")
                node = _node(parent, token)
                rows.append((node, parent, d + 1, words, n, conv, rank, n if d + 1 == depth else 0))
                if len(rows) >= 1 << 15:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def running(rows: DataFrame, order: list[str], sums: dict[str, str], place: str = "preorder") -> DataFrame:
    """``rows`` with their 1-based place in a total order and running sums of columns (new name: column).

    Ranges of the order are staged and summed inside; the driver sees one row of sums a range.
    """
    spark = rows.sparkSession
    ranged = stage_table(rows.repartitionByRange(session_partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "preorder")
    each = ranged.groupBy("_range").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{new}") for new, c in sums.items()]).orderBy("_range").collect()
    table, before = [], [0] * (1 + len(sums))
    for r in each:
        table.append((r["_range"], *before))
        before = [b + v for b, v in zip(before, r[1:], strict=True)]
    names = ["_before", *[f"_before_{new}" for new in sums]]
    starts = spark.createDataFrame(table, "_range int, " + ", ".join(f"{c} long" for c in names))
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(starts), "_range")
    added = {place: F.row_number().over(inside) + F.col("_before")} | {new: F.sum(c).over(upto) + F.col(f"_before_{new}") for new, c in sums.items()}
    return joined.withColumns(added).drop("_range", *names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted ids of a node, joined by commas."""
    now, first, held, size = None, 0, [], 0
    out: list[tuple] = []

    def put():
        if held:
            out.append((now, first, ",".join(held)))

    for batch in batches:
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != now or size >= PIECE:
                put()
                now, first, held, size = node, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "piece"])
        out = []
    put()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "piece"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None
    for batch in batches:
        nodes, out = [], []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if node != now:
                if sha is not None:
                    nodes.append(now)
                    out.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], ["node", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): of the ids of a node's rows (node, conv_id), ascending, with commas between."""
    n = session_partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, PIECES)
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, source, place, token, words), ordered by source and place.

    Columns: node and parent (16 bytes), depth, conv_id (smallest member), parent_conv_id, n_convs,
    n_children, preorder, subtree_end, n_leaves, saved_tokens, ends_sha256. A row without a token
    makes its conversation known; without one a conversation is not part of the table.
    """
    spark = turns.sparkSession
    small_batches(spark)
    sound_unions(spark)
    dealt = turns.repartition(session_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "source", "place")
    convs = stage_table(dealt.select("conv_id", "token", "words").mapInArrow(_keys, KEYS), "keys")
    distinct = convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ranked = running(distinct, ["key"], {}, "rank")
    steps = ranked.select("key", "n", "conv_id", "rank").mapInArrow(_steps, STEPS)
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("ends").alias("ends")]
    nodes = stage_table(steps.groupBy("node", "parent", "depth", "words").agg(*sums), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("words")})
    leaf = (F.col("n_children") == 0).cast("long")
    ordered = stage_table(running(counted.withColumn("leaf", leaf), ["lo", "depth"], {"leaves": "leaf", "savings": "saved"}), "trie")
    # The key of rank r ends in the last node that it brings into the order, and only there do conversations end.
    stops = ordered.where(F.col("ends") > 0).select(F.col("lo").alias("hi"), F.col("preorder").alias("subtree_end"), F.col("leaves").alias("leaves_end"), F.col("savings").alias("savings_end"))
    parents = ordered.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = ordered.join(stops, "hi").join(parents, "parent", "left").join(end_hashes(convs.select("node", "conv_id")), "node", "left")
    return found.select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "preorder", "subtree_end", (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("savings_end") - F.col("savings") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations``."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie(rebuilt(tokens(conversations)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS b(n)),
ids AS (
  SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
                         lambda c, x: xor(c >> 8, crc.t[1 + (xor(c, x) & 255)])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
turns AS (
  SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
joined AS (
  SELECT ids.conv_id, 1 AS source, i, said, text FROM ids JOIN turns ON turns.conv_id = ids.base AND i <= h
  UNION ALL
  SELECT ids.conv_id, 2, i, said, text FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND i > h),
whole AS (
  SELECT ids.conv_id, coalesce(list(sha256(said) ORDER BY source, i) FILTER (said IS NOT NULL), []) AS path,
         coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY source, i) FILTER (said IS NOT NULL), []) AS words
  FROM ids LEFT JOIN joined USING (conv_id) GROUP BY ids.conv_id),
members AS (
  SELECT conv_id, d, path[1:d] AS node, CASE WHEN d > 0 THEN path[1:d-1] END AS parent, coalesce(words[d], 0) AS words, d = len(path) AS last FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM members GROUP BY node),
children AS (
  SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
full_nodes AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.parent = nodes.node),
above AS (
  SELECT node[1:k] AS top, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes)),
below AS (
  SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.top = f.node LEFT JOIN nodes p ON p.node = f.parent
"""
