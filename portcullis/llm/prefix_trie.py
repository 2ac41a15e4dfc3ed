"""The trie of conversation prefixes, its subtree totals by leaf peeling.

Each distinct sequence of first turns is a node. A turn is a 128-bit hash of its place, role and text,
and a prefix is known by its length and the exclusive-or of its turns' hashes, so prefixes come of a
running aggregate that also runs by blocks: conversations of any length spread over tasks.

A node's ``conv_id`` is its smallest member. The nodes of one conv_id follow one another: they are a
path that hangs on a node of another path. Peeling goes by paths: each holds a counter of the paths that
still hang on it; those at zero are complete and send their totals to the node that they hang on, which
lowers that path's counter, until only the root's path is left. A round is one pass over the paths that
are left, without their nodes; the rounds are as many as paths hang on one another, however long they
are. What each node received is then summed up along its path.

Null roles and texts count as empty, turns are ordered with nulls first, equal ones by their content;
repeated rows are turns each. Rows without a conv_id belong to no conversation. A conversation without
turns ends at the root. Without conversations there is no root and no row. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import Scratch

#: Turns of a conversation, or nodes of a path, that one task runs along at a time.
BLOCK = 4096
EMPTY_SHA = hashlib.sha256().hexdigest()


def long_of(digest: Column, start: int) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def running(df: DataFrame, keys: list[str], place: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running aggregates of each key's rows in the order of ``place`` (0, 1, 2, ...).

    ``sums``: name -> (column, ``sum`` or ``bit_xor``), up to and including the row. Each block of
    ``BLOCK`` places runs on its own; the totals of the blocks before it are added: rows x 1/``BLOCK``.
    """
    block = F.floor(F.col(place) / BLOCK)
    inside = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", block)
    rows = rows.select("*", *[F.expr(f"{kind}({c})").over(inside).alias(name) for name, (c, kind) in sums.items()])
    long = df.withColumn("_block", block + 1).groupBy(*keys, "_block").agg(*[F.expr(f"{kind}({c})").alias(f"_{name}") for name, (c, kind) in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    # Only keys of more than a block have anything before a block: their last total is for no block.
    more = Window.partitionBy(*keys).orderBy("_block")
    totals = long.select(*keys, "_block", *[F.expr(f"{kind}(_{name})").over(before).alias(f"_{name}") for name, (_, kind) in sums.items()], F.lead("_block").over(more).alias("_next")).where("_next is not null").drop("_next")
    joined = rows.join(totals, [*keys, "_block"], "left")
    whole = {name: F.coalesce(F.col(name) + F.col(f"_{name}") if kind == "sum" else F.col(name).bitwiseXOR(F.col(f"_{name}")), F.col(name)) for name, (_, kind) in sums.items()}
    return joined.withColumns(whole).drop("_block", *[f"_{name}" for name in sums])


def numbered(df: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``place``: the number of each row among those of its key, from 0.

    Rows are dealt by ranges of (key, order), so a key of any size spreads; each range is numbered, and
    the rows of a key in the ranges before are added. A key that goes over ranges is the first or last
    of each, so these sums are two rows a range at most.
    """
    dealt = scratch.written(df.repartitionByRange(*[F.asc_nulls_first(c) for c in (key, *order)]).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(key, "_range").orderBy(*[F.asc_nulls_first(c) for c in order])
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    wide = counts.groupBy(key).agg(F.count("*").alias("_ranges"), F.collect_list(F.struct("_range", "_n")).alias("_each")).where("_ranges > 1")
    before = wide.select(key, F.explode("_each").alias("_x")).select(
        key, F.col("_x._range").alias("_range"), (F.sum("_x._n").over(Window.partitionBy(key).orderBy("_x._range")) - F.col("_x._n")).alias("_before")
    )
    return dealt.withColumn("place", F.row_number().over(inside) - 1).join(before, [key, "_range"], "left").withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``turns`` (conv_id, place from 0, digest, ...) with the first turns of another conversation each.

    Conversation c gets the first h turns of c - c % group (all if that has fewer, none if there is none),
    h = crc32(decimal c) % most, and its own from place h on. What is left without turns has no rows here.
    """
    convs = turns.groupBy("conv_id").agg(F.count("digest").alias("length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where(F.col("place") < most - 1).where(F.col("conv_id") % group == 0)
    lengths = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.col("length").alias("has"))
    plan = convs.select("conv_id", h.alias("h"), first.alias("first")).join(lengths, "first", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    lent = plan.where("taken > 0").join(heads.withColumnRenamed("conv_id", "first"), "first").where("place < taken").drop("first", "h", "has", "taken")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("taken")).drop("h", "taken")
    return lent.unionByName(own)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    ``turns``: conv_id, place (from 0, without gaps), ``digest`` (hex digits of the turn's role and text), ``size``;
    ``convs``: conv_id of all conversations, those without turns too.
    """
    scratch = Scratch(turns.sparkSession)
    placed = F.sha2(F.concat_ws(" ", F.col("place").cast("string"), F.col("digest")), 256)
    marks = turns.select("conv_id", "place", "size", long_of(placed, 1).alias("x"), long_of(placed, 17).alias("y"))
    prefixes = running(marks, ["conv_id"], "place", {"px": ("x", "bit_xor"), "py": ("y", "bit_xor")})
    prefixes = prefixes.select("conv_id", (F.col("place") + 1).alias("depth"), "px", "py", F.col("px").bitwiseXOR(F.col("x")).alias("ux"), F.col("py").bitwiseXOR(F.col("y")).alias("uy"), "size")
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "px", "py", "ux", "uy", "size")])
    rows = scratch.written(prefixes.unionByName(root), "prefixes")

    key = ["depth", "px", "py"]
    above = [(F.col("depth") - 1).alias("depth"), F.col("ux").alias("px"), F.col("uy").alias("py")]
    nodes = scratch.written(rows.groupBy(*key, "ux", "uy").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")), "nodes")
    children = nodes.where("depth > 0").select(*above).groupBy(*key).agg(F.count("*").alias("n_children"))
    # The root is the parent of all nodes of depth 1, its path that of the smallest conversation: no join for these.
    first = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv")))  # one row
    owners = nodes.where("depth > 0").select(*key, F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").withColumns({"d": F.col("depth") - 1}).join(owners.toDF("d", "ux", "uy", "parent_conv_id"), ["d", "ux", "uy"]).drop("d")
    shallow = nodes.where("depth <= 1").join(first).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv"))).drop("root_conv")
    whole = scratch.written(
        deep.unionByName(shallow).join(children, key, "left").select(
            *key, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("own")
        ),
        "whole",
    )
    received = peeled(whole, scratch)
    # Along each path, from its end: what its nodes have and what they received.
    given = whole.join(received, ["conv_id", "depth"], "left").select(
        *whole.columns, (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("leaves", F.lit(0))).cast("long").alias("leaf"), (F.col("own") + F.coalesce("saved", F.lit(0))).cast("long").alias("save")
    )
    ends = whole.groupBy("conv_id").agg(F.max("depth").alias("last"))
    given = given.join(ends, "conv_id").withColumn("from_end", F.col("last") - F.col("depth")).drop("last")
    totals = running(given, ["conv_id"], "from_end", {"n_leaves": ("leaf", "sum"), "saved_tokens": ("save", "sum")})
    return totals.join(ended(rows, key), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )


def peeled(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """What each node receives from the paths that hang on it: conv_id, depth, ``leaves`` and ``saved``."""
    paths = nodes.groupBy("conv_id").agg(
        F.min_by(F.struct(F.col("parent_conv_id").alias("over"), (F.col("depth") - 1).alias("at")), "depth").alias("top"),
        F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
        F.sum("own").alias("saved"),
    ).select("conv_id", F.col("top.over").alias("over"), F.col("top.at").alias("at"), "leaves", "saved")
    hanging = paths.where("over is not null").groupBy(F.col("over").alias("conv_id")).agg(F.count("*").alias("waits"))
    left = scratch.written(paths.join(hanging, "conv_id", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))), "paths")
    sent: list[DataFrame] = []
    while not left.where("over is not null").isEmpty():
        messages = scratch.written(
            left.where("waits = 0").groupBy(F.col("over").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")),
            "messages",
        )
        sent.append(messages)
        came = messages.groupBy("conv_id").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n"))
        left = scratch.written(
            left.where("waits > 0").join(came, "conv_id", "left").select(
                "conv_id", "over", "at", *[(F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))], (F.col("waits") - F.coalesce("n", F.lit(0).cast("long"))).alias("waits")
            ),
            "paths",
        )
    if not sent:
        return nodes.select("conv_id", "depth", F.lit(0).alias("leaves"), F.lit(0).alias("saved")).limit(0)
    every = sent[0]
    for more in sent[1:]:
        every = every.unionByName(more)
    return every.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def ended(rows: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of the conversations that end at each node: their ids in order, joined by commas.

    Ids are hashed as they come, in the order that Spark sorted them in: nothing holds those of a node.
    """
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("at")).select("at.*", "conv_id")
    fields = [pa.field("depth", pa.int64()), pa.field("px", pa.int64()), pa.field("py", pa.int64()), pa.field("ends_sha256", pa.string())]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for *at, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if at == node:
                    digest.update(b",%d" % conv)
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(b"%d" % conv)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * 4, fields, strict=True)], schema=pa.schema(fields))
        if node is not None:
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip((*node, digest.hexdigest()), fields, strict=True)], schema=pa.schema(fields))

    return last.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(digest, "depth long, px long, py long, ends_sha256 string")


def conversation_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place, digest and size of each turn of ``rows`` (conv_id, turn, role, text); texts stay where they are."""
    empty = F.lit("")
    role, text = F.coalesce("role", empty), F.coalesce("text", empty)
    slim = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    return numbered(slim, "conv_id", ["turn", "digest"], scratch).drop("turn")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    scratch = Scratch(rows.sparkSession)
    turns = scratch.written(conversation_turns(rows, scratch), "turns")
    return trie(scratch.written(rebuilt(turns), "rebuilt"), turns.select("conv_id").distinct())


# SQL has no crc32: a fold over the bytes of the number, each followed by its eight shifts.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place, digest, size
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size
        FROM conversations WHERE conv_id IS NOT NULL)
), steps AS (
  SELECT conv_id, length, flatten([[4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]) AS s
  FROM (SELECT conv_id, count(*) AS length FROM turns GROUP BY conv_id)
), convs AS (
  SELECT conv_id, length,
         xor(list_reduce(s, lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h
  FROM steps
), plan AS (
  SELECT c.conv_id, c.h, b.conv_id AS base, least(c.h, coalesce(b.length, 0)) AS taken
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), rebuilt AS (
  SELECT p.conv_id, t.place, t.digest, t.size FROM plan p JOIN turns t ON t.conv_id = p.base AND t.place < p.taken
  UNION ALL
  SELECT p.conv_id, t.place - p.h + p.taken, t.digest, t.size FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.place >= p.h
), prefixes AS (
  SELECT conv_id, place + 1 AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, size FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT prefix, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS own,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY prefix, p.depth
), links AS (
  SELECT n.*, m.conv_id AS parent_conv_id, count(c.prefix) OVER (PARTITION BY n.prefix) AS n_children, c.prefix AS child
  FROM nodes n LEFT JOIN nodes m ON m.depth = n.depth - 1 AND m.prefix = left(n.prefix, length(n.prefix) - 64)
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND left(c.prefix, length(c.prefix) - 64) = n.prefix
), whole AS (
  SELECT DISTINCT prefix, depth, conv_id, parent_conv_id, n_convs, n_children, own, ends_sha256 FROM links
), totals AS (
  SELECT a.prefix, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.own)::BIGINT AS saved_tokens
  FROM whole w JOIN prefixes a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.prefix
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM whole JOIN totals USING (prefix)
"""
