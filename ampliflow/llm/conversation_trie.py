"""The prefix trie of conversations, without a node ever gathering its members.

Conversations that begin alike share nodes. The smallest member of a node owns it, and also owns every node below it on its own
path: each conversation owns a suffix of its path. So one number a conversation, the depth where its suffix begins, says of each
of its turns whether the node is its own. Summed along a conversation by windows, its tokens from a turn on, less those of
nodes that it owns, are what it adds to the savings of the node at that turn; the conversation adds one leaf to every node on its path if
it owns a leaf. One group-by over prefixes then has all figures of a node, combined in the tasks that read the turns.

Prefixes are known by two XORs of hashes of (depth, turn), which windows over blocks of a conversation extend turn by turn; that equal
prefixes end in equal turns is checked. No window or join has more than a block of a conversation in one task, and no group-by more
than partial sums of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliflow.llm.common import materialize
from ampliflow.operators.staging import join_group

#: Shared turns: a conversation takes up to so many, less one, of the first of its hundred.
DRAWS, FAMILY = 6, 100
#: Turns of a conversation in one window, as a power of two.
BLOCK_BITS = 10
#: Members whose ids agree but for so many low bits are listed together.
SEGMENT_BITS = 14
NODE = ["depth", "x1", "x2"]


def _digest(role: Column, text: Column) -> list[Column]:
    """120 bits of the SHA-256 of a turn, as two longs; the length keeps role and text apart."""
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(whole, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"t{k + 1}") for k in (0, 1)]


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, t1, t2, chars) sorted over all ranges, and (conv_id, part, lo, n, before) of the ranges of each conversation.

    The 0-based place of a turn is ``at - lo + before``. A conversation may span many ranges; no task holds more than one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *_digest(role, text), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "t1", "t2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("turn"), "op13-turns")
    spans = rows.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, materialize(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "op13-spans")


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, length, t1, t2, chars): the turns of each conversation in order, depth 1 and on, and its root of depth 0."""
    rows, spans = _numbered(conversations)
    sizes = spans.groupBy("conv_id").agg(F.sum("n").alias("length"))
    own = rows.join(spans.join(sizes, "conv_id"), ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("lo") + F.col("before") + 1).alias("depth"), "length", "t1", "t2", "chars")
    return own.unionByName(_roots(sizes))


def _roots(lengths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return lengths.select("conv_id", zero.alias("depth"), "length", zero.alias("t1"), zero.alias("t2"), zero.alias("chars"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """As ``paths``, of conversations that begin with turns of the first of their hundred.

    Conversation c takes the first h = crc32(c) % 6 turns of c - c % 100, all if that has fewer, and goes on with its own turns after the first h.
    """
    rows, spans = _numbered(conversations)
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    drawn = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % DRAWS, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    info = drawn.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))
    info = materialize(info, "op13-info")
    placed = rows.join(spans.join(info.drop("base"), "conv_id"), ["conv_id", "part"]).withColumn("r", F.col("at") - F.col("lo") + F.col("before"))
    own = placed.where("r >= h").select("conv_id", (F.col("taken") + F.col("r") - F.col("h") + 1).alias("depth"), "length", "t1", "t2", "chars")
    first = spans.where(F.col("before") < DRAWS - 1).select("conv_id", "part", "lo", "before")
    heads = rows.join(first, ["conv_id", "part"]).withColumn("r", F.col("at") - F.col("lo") + F.col("before")).where(F.col("r") < DRAWS - 1)
    heads = heads.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "r", "t1", "t2", "chars")
    shared = info.join(heads, "base").where("r < taken").select("conv_id", (F.col("r") + 1).alias("depth"), "length", "t1", "t2", "chars")
    return own.unionByName(shared).unionByName(_roots(info.select("conv_id", "length")))


def _with_prefixes(path: DataFrame) -> DataFrame:
    """Adds the prefix (x1, x2), that of the parent (p1, p2) and the code points up to and with each turn (so_far)."""
    block = F.shiftright("depth", BLOCK_BITS)
    keys = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "t1", "t2")).alias(f"k{k}") for k in (1, 2)]
    rows = path.select("*", block.alias("block"), *keys)
    inner = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.withColumns({"x1": F.bit_xor("k1").over(inner), "x2": F.bit_xor("k2").over(inner), "so_far": F.sum("chars").over(inner)})
    ends = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("chars").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    none = F.lit(0).cast("long")
    ends = ends.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), none).alias(c) for c, f in (("b1", F.bit_xor), ("b2", F.bit_xor), ("b", F.sum))])
    rows = rows.join(ends, ["conv_id", "block"])
    x1, x2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return rows.select("conv_id", "depth", "block", "length", "t1", "t2", "chars", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("k1")).alias("p1"), x2.bitwiseXOR(F.col("k2")).alias("p2"), (F.col("so_far") + F.col("b")).alias("so_far"))


def _lists_hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined lists of each node, from rows sorted by node and segment; one list is held at a time."""
    now, state = None, None
    for batch in batches:
        out = []
        for node, ids in zip(zip(batch["depth"], batch["x1"], batch["x2"]), batch["ids"]):
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end. Ids that share their high bits are joined first: at most 2^14 of them, then lists stream."""
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    segments = last.groupBy(*NODE, F.shiftright("conv_id", SEGMENT_BITS).alias("segment")).agg(ids.alias("ids"))
    ordered = segments.repartition(*NODE).sortWithinPartitions(*NODE, "segment")
    return ordered.select(*NODE, "ids").mapInPandas(_lists_hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(path: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, from ``paths``.

    A node is named by its smallest member and its depth. ``saved_tokens`` is what storing each turn of the subtree once saves, in code points.
    """
    path = materialize(_with_prefixes(path), "op13-paths")
    nodes = path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), *[f(t).alias(f"{n}{t}") for t in ("t1", "t2") for n, f in (("lo", F.min), ("hi", F.max))])
    alike = (F.col("lot1") == F.col("hit1")) & (F.col("lot2") == F.col("hit2"))
    owner = F.when(alike, F.col("owner")).otherwise(F.raise_error(F.lit("different prefixes share a hash")).cast("long"))
    nodes = materialize(nodes.select(*NODE, owner.alias("owner"), (F.col("deepest") == F.col("depth")).cast("long").alias("leaf")), "op13-nodes")

    # Where the suffix that a conversation owns begins, and whether a leaf is at its end.
    starts = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("depth"), F.max("leaf").alias("leaf"))
    firsts = materialize(path.join(starts, ["conv_id", "depth"]).select("conv_id", "depth", "p1", "p2", "leaf", (F.col("so_far") - F.col("chars")).alias("own_from")), "op13-firsts")
    last = path.where("depth = length").select("conv_id", *NODE, "length", "so_far")
    info = last.join(firsts.select("conv_id", "leaf", "own_from"), "conv_id", "left").select("conv_id", "length", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own_from", "so_far").alias("foreign"))
    info = info.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("length", BLOCK_BITS))).alias("block"), "leaf", "foreign")

    rows = path.join(info, ["conv_id", "block"])
    # Tokens from this turn on that others own: 0 where the node is the conversation's own.
    adds = F.greatest(F.col("foreign") - F.col("so_far") + F.col("chars"), F.lit(0))
    figures = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min_by("length", "conv_id").alias("length"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(adds).alias("saved_tokens"))

    kids = firsts.where("depth > 0").select("conv_id", "depth", (F.col("depth") - 1).alias("up"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    families = kids.groupBy("up", "u1", "u2").agg(F.count(F.lit(1)).alias("size"))
    of = nodes.select(F.col("depth").alias("up"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), "owner")
    families = materialize(families.join(of, ["up", "u1", "u2"]), "op13-families")
    parents = join_group(kids, families, ["up", "u1", "u2"]).select("conv_id", "depth", F.col("owner").alias("parent"))
    born = families.select(F.col("up").alias("depth"), F.col("u1").alias("x1"), F.col("u2").alias("x2"), F.col("size").alias("born"))
    found = figures.join(born, NODE, "left").join(_ends(last), NODE, "left").join(parents, ["conv_id", "depth"], "left")
    children = F.coalesce("born", F.lit(0)) + (F.col("length") > F.col("depth")).cast("long")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; columns as of ``prefix_trie``.

    Turns are ordered by number, null first, then by the hash of role and text; repeated turns count as often as they are there. Null role and
    text are empty. Rows without a conv_id belong to no conversation and are left out. An empty table has no node.
    """
    return prefix_trie(paths(conversations))


def op13_query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt_paths(conversations))


_CRC_STEP = "xor(x >> 1, 3988292384 * (x & 1))"
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {FAMILY} AS base,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: {_CRC_STEP})), 4294967295) % {DRAWS} AS h FROM t GROUP BY conv_id),
i AS (SELECT n.conv_id, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS taken FROM n LEFT JOIN n b ON b.conv_id = n.base),
p AS (SELECT conv_id, 0 AS depth, '' AS role, '' AS text FROM i
  UNION ALL SELECT i.conv_id, r + 1, role, text FROM i JOIN t ON t.conv_id = base WHERE r < taken
  UNION ALL SELECT i.conv_id, taken + r - h + 1, role, text FROM i JOIN t ON t.conv_id = i.conv_id WHERE r >= h),
k AS (SELECT conv_id, depth, length(text) AS chars, max(depth) OVER (PARTITION BY conv_id) AS length,
  sha256(string_agg(sha256(length(role) || ':' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM p),
g AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(length) AS deepest, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256 FROM k GROUP BY ALL),
up AS (SELECT c.depth AS depth, c.node AS node, k.depth AS above_depth, k.node AS above FROM g c JOIN k ON k.conv_id = c.conv_id AND k.depth <= c.depth),
s AS (SELECT above_depth AS depth, above AS node, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (g.depth = deepest) AS n_leaves, count(*) FILTER (g.depth = above_depth + 1) AS n_children
  FROM up JOIN g ON g.depth = up.depth AND g.node = up.node GROUP BY ALL)
SELECT g.conv_id, g.depth, a.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM g JOIN s USING (depth, node) LEFT JOIN (SELECT up.depth, up.node, g.conv_id FROM up JOIN g ON g.depth = above_depth AND g.node = above WHERE above_depth = up.depth - 1) a ON a.depth = g.depth AND a.node = g.node"""
