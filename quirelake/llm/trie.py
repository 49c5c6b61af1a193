"""Prefix trie of conversations, with totals of all subtrees by parallel tree contraction.

Prefixes. A turn is known by the SHA-256 of its role and text; a prefix by its length and 128 bits that are the exclusive or of a hash of
(place, turn) for each of its turns, so running values in chunks of CHUNK turns, and of the chunks before, give every
prefix its key, however long a conversation is, and taking the last turn off gives its parent's. A node is a group of equal keys.

Contraction. In each round childless nodes are raked: their totals are added to their parents and they are gone. At the same time unary
chains are compressed: a unary node under a unary node is spliced out if its depth has, at this round's bit, a 1 and the depth of the node
above a 0, so no two neighbours go at once and a straight chain is halved; its only child hangs on the node above and carries what the spliced node
had gathered. Bits take turns, and between two depths some bit differs that way, so each round or one of the next shortens every chain: a chain of n
nodes takes about log2(n) rounds, not n. Then the rounds are taken back: a raked node's total is what it had; a spliced
node's is what it had and carried plus its child's total, which is known by then. Each round is a few joins on node ids, over what is left.

Rows: turns come in order of `turn`, nulls first, equal ones by their digest, so repeated rows are turns of their own; null role or text is
empty; rows without conv_id belong to no conversation; a conversation may be rebuilt without turns, then it is a member of the root only; very long texts
are read once, digests move on; without conversations there are no nodes. Columns beyond conv_id, turn, role and text aren't read.
A key that holds many rows (a long conversation, a common first turn) is looked up by a bounded broadcast, counted in parts, never gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, id_text, materialize, parallelism, ranked, read_table, text_of

SHARED, FOLDS = 100, 6
CHUNK = 1024
#: Ids of a node's ends are hashed from texts of about so many bytes each.
TEXT = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _long(column: Column) -> Column:
    return column.cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), size (turns of the conversation), digest (16 bytes), length (code points of the text)."""
    role, text = text_of("role"), text_of("text")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(_long(F.col("conv_id")).alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).alias("length"))
    return ranked(rows, "conv_id", ["turn", "digest"], "trie-turns").select("conv_id", (F.col("idx") + 1).alias("place"), "size", "digest", "length")


def rebuilt(own: DataFrame, shared: int = SHARED, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """own: turns. Result: turns (conv_id, depth, digest, length, size) of the rebuilt conversations, and conversations (conv_id, size), both written.

    Conversation c takes the first crc32(c) mod `folds` turns of c - c % shared (a remainder with c's sign), then its own after so many.
    """
    head = F.crc32(id_text("conv_id").cast("binary")) % F.lit(folds)
    convs = own.where("place = 1").select("conv_id", F.col("size").alias("own_size"), head.alias("head"), (F.col("conv_id") - F.col("conv_id") % F.lit(shared)).alias("base"))
    sizes = own.where("place = 1").select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    # at most `shared` conversations, and folds - 1 turns, for a base
    convs = convs.join(sizes.hint("merge"), "base", "left").withColumn("taken", F.least("head", F.coalesce("base_size", F.lit(0))))
    convs = materialize(convs.withColumn("size", F.col("taken") + F.greatest(F.col("own_size") - F.col("head"), F.lit(0))), "trie-conversations")
    heads = own.where(F.col("place") < folds).where(F.col("conv_id") % F.lit(shared) == 0).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "length")
    first = convs.join(heads.hint("merge"), "base").where("depth <= head").select("conv_id", "depth", "digest", "length", "size")
    known = convs.select("conv_id", "head", "taken", F.col("size").alias("full"), F.col("own_size").alias("weight"))
    rest = attach(own, known, ["conv_id"], "weight", own.count()).where(F.col("place") > F.col("head"))
    rest = rest.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "digest", "length", F.col("full").alias("size"))
    return materialize(first.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "size")


def prefixes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows: conv_id, depth (from 1, without gaps), digest, length, size. Result, written: conv_id, depth, length, size, x1, x2 (the prefix), p1, p2 (the prefix without its last turn)."""
    marks = [F.xxhash64(F.lit(f"prefix {k}"), F.col("depth").cast("long"), F.col("digest")) for k in (1, 2)]
    rows = rows.select("conv_id", "depth", "length", "size", F.floor((F.col("depth") - 1) / F.lit(chunk)).cast("long").alias("chunk"), marks[0].alias("f1"), marks[1].alias("f2"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = materialize(rows.select("*", F.bit_xor("f1").over(upto).alias("x1"), F.bit_xor("f2").over(upto).alias("x2")), "trie-chunks")
    # the last row of each full chunk, and of those the running value: a row for every `chunk` turns
    ends = local.where((F.col("depth") % F.lit(chunk) == 0) & (F.col("depth") < F.col("size"))).select("conv_id", F.col("chunk") + 1, "x1", "x2").toDF("conv_id", "chunk", "e1", "e2")
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.select("conv_id", "chunk", F.bit_xor("e1").over(over).alias("e1"), F.bit_xor("e2").over(over).alias("e2"), F.lit(chunk).cast("long").alias("weight"))
    ends = materialize(ends, "trie-chunk-ends")
    local = attach(local, ends, ["conv_id", "chunk"], "weight", local.count())
    x = [F.col(f"x{k}").bitwiseXOR(F.coalesce(f"e{k}", F.lit(0).cast("long"))) for k in (1, 2)]
    out = local.select("conv_id", "depth", "length", "size", x[0].alias("x1"), x[1].alias("x2"), x[0].bitwiseXOR(F.col("f1")).alias("p1"), x[1].bitwiseXOR(F.col("f2")).alias("p2"))
    return materialize(out, "trie-prefixes")


def nodes(keyed: DataFrame, convs: DataFrame) -> DataFrame:
    """keyed: prefixes; convs: conversations. Result, written: conv_id, depth, parent_conv_id, n_convs, n_children, saved (of the node alone), x1, x2."""
    made = keyed.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("length").alias("length"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("length"))
    made = materialize(made.unionByName(root), "trie-keys")
    kids = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    made = made.join(kids.hint("merge"), ["depth", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    made = materialize(made.withColumn("saved", (F.col("n_convs") - 1) * F.col("length")), "trie-counted")
    parents = made.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = attach(made.where("depth > 0"), parents.withColumnRenamed("n_children", "weight"), ["depth", "p1", "p2"], "weight", made.count())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "saved", "x1", "x2"]
    return materialize(below.select(*columns).unionByName(made.where("depth = 0").withColumn("parent_conv_id", none).select(*columns)), "trie-nodes")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """tree: conv_id, depth (together a node's id), parent_conv_id (null: a root), values (long). Result, written: conv_id, depth, and each value summed over the subtree."""
    node, up, child = ["conv_id", "depth"], ["parent_conv_id", "parent_depth"], ["only_conv_id", "only_depth"]

    def plus(first: str, more: str, v: str) -> Column:
        return F.col(f"{first}{v}") + F.coalesce(F.col(f"{more}{v}"), F.lit(0))

    alive = tree.select(*node, "parent_conv_id", (F.col("depth") - 1).alias("parent_depth"), *values, *(F.lit(0).cast("long").alias(f"carry_{v}") for v in values))
    bits = int(alive.agg(F.max("depth")).first()[0] or 1).bit_length()
    alive, rounds = materialize(alive, "trie-alive"), []
    while not alive.isEmpty():
        bit = F.lit(1 << len(rounds) % bits).cast("long")
        # each node with its number of children, and with its child if that is the only one
        kids = alive.where("parent_conv_id IS NOT NULL").groupBy(*up).agg(F.count("*").alias("n"), F.min("conv_id"), F.min("depth")).toDF(*node, "n", *child)
        # a unary node tells its child so; a unary child at the right depth is spliced out and tells its own child
        told = kids.where("n = 1").select(*child, F.lit(True).alias("told")).toDF(*node, "told")
        chosen = F.col("told") & (F.col("n") == 1) & (F.col("depth").bitwiseAND(bit) != 0) & (F.col("parent_depth").bitwiseAND(bit) == 0)
        state = alive.join(kids.hint("merge"), node, "left").join(told.hint("merge"), node, "left").withColumn("spliced", F.coalesce(chosen, F.lit(False)))
        state = materialize(state.drop("told"), "trie-state")
        moved = state.where("spliced").select(*child, *node, *up, *values, *(f"carry_{v}" for v in values))
        moved = moved.toDF(*node, "old_conv_id", "old_depth", *(f"new_{c}" for c in up), *(f"old_{v}" for v in values), *(f"old_carry_{v}" for v in values))
        hung = F.col("old_depth").isNotNull()
        stays = state.where("NOT spliced").join(moved.hint("merge"), node, "left")
        stays = stays.select(
            *node, *(F.when(hung, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in up), *values, (F.col("n").isNull() & ~hung).alias("raked"), "old_conv_id", "old_depth",
            *((plus("carry_", "old_", v) + F.coalesce(f"old_carry_{v}", F.lit(0))).alias(f"carry_{v}") for v in values), *(plus("carry_", "old_", v).alias(f"between_{v}") for v in values),
        )
        stays = materialize(stays, "trie-hung")
        raked = stays.where("raked")
        sums = raked.where("parent_conv_id IS NOT NULL").groupBy(*up).agg(*(F.sum(F.col(v) + F.col(f"carry_{v}")) for v in values)).toDF(*node, *(f"more_{v}" for v in values))
        rest = stays.where("NOT raked").join(sums.hint("merge"), node, "left")
        alive = materialize(rest.select(*node, *up, *(plus("", "more_", v).alias(v) for v in values), *(f"carry_{v}" for v in values)), "trie-alive")
        # a spliced node's total: what it had and what lay between it and its child, with the child's total
        gone = stays.where(F.col("old_depth").isNotNull()).select("old_conv_id", "old_depth", *node, *(f"between_{v}" for v in values))
        rounds.append((raked.select(*node, *values), gone))
    totals = tree.select(*node, *values).limit(0)
    for raked, gone in reversed(rounds):
        known = totals.select(*node, *(F.col(v).alias(f"sub_{v}") for v in values))
        back = gone.join(known.hint("merge"), node).select("old_conv_id", "old_depth", *(F.col(f"between_{v}") + F.col(f"sub_{v}") for v in values)).toDF(*node, *values)
        totals = materialize(totals.unionByName(back).unionByName(raked), "trie-totals")
    return totals


def _id_texts(batches):
    """Ids of each node in order, comma-joined, in texts of bounded size."""
    part, count, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    made: list[tuple] = []

    def close():
        nonlocal held, size, count
        if held:
            made.append((*key, part, count, ",".join(held)))
            held, size, count = [], 0, count + 1

    names = ["depth", "x1", "x2", "part", "nth", "ids"]
    for batch in batches:
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "x1", "x2", "conv_id"))):
            if node != key or size >= TEXT:
                close()
                key = node
            held.append(str(conv))
            size += len(held[-1]) + 1
        if made:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*made))[:5]), pa.array([r[5] for r in made])], names=names)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*made))[:5]), pa.array([r[5] for r in made])], names=names)


def _id_digests(batches):
    """The digest of each node's texts, comma-joined as they come."""
    names, key, digest, made = ["depth", "x1", "x2", "ends_sha256"], None, None, []

    def batch_of():
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in made], pa.int64()) for i in range(3)), pa.array([r[3] for r in made], pa.string())], names=names)

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "x1", "x2", "ids"))):
            if node == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                made.append((*key, digest.hexdigest()))
            key, digest = node, hashlib.sha256(ids.encode())
        if made:
            yield batch_of()
            made.clear()
    if key is not None:
        made.append((*key, digest.hexdigest()))
        yield batch_of()


def end_digests(keyed: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of every node at which conversations end. The ids of a node are put in order by ranges and joined in parts; its one digest then reads these parts, a few thousandths of the rows."""
    zero, key = F.lit(0).cast("long"), ["depth", "x1", "x2"]
    ends = keyed.where("depth = size").select(*key, "conv_id").unionByName(convs.where("size = 0").select(*(zero.alias(c) for c in key), "conv_id"))
    parts = parallelism(keyed.sparkSession)
    ordered = ends.repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    texts = ordered.mapInArrow(_id_texts, "depth long, x1 long, x2 long, part long, nth long, ids string")
    return texts.repartition(parts, *key).sortWithinPartitions(*key, "part", "nth").mapInArrow(_id_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: int = SHARED, folds: int = FOLDS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text), with their totals."""
    rows, convs = rebuilt(turns(conversations), shared, folds)
    keyed = prefixes(rows)
    tree = nodes(keyed, convs)
    own = tree.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    out = tree.join(end_digests(keyed, convs).hint("merge"), ["depth", "x1", "x2"], "left").join(totals.hint("merge"), ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = """
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS place, h, length(t) AS length
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT *, conv_id - conv_id % 100 AS base,
    -- unsigned crc32: bytes are xor-ed in, -1 is one of the eight shifts after each
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS head
  FROM (SELECT conv_id, count(*) AS size FROM o GROUP BY conv_id)),
k AS (SELECT c.*, least(c.head, coalesce(b.size, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT k.conv_id, o.place AS depth, h, length FROM k JOIN o ON o.conv_id = k.base AND o.place <= k.head
  UNION ALL
  SELECT k.conv_id, o.place - k.head + k.taken, h, length FROM k JOIN o ON o.conv_id = k.conv_id AND o.place > k.head
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM k),
p AS (SELECT conv_id, depth, length, string_agg(h, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r),
l AS (SELECT *, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, (count(*) - 1) * any_value(length) AS saved,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends
  FROM l GROUP BY depth, prefix),
m AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n d WHERE d.depth = n.depth + 1 AND d.above = n.prefix) AS n_children
  FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.prefix = n.above),
s AS (
  SELECT p.depth, p.prefix, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.prefix)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s USING (depth, prefix)
"""
