"""Merkle manifest of a dataset by time-forward processing: a tree for each source, a tree over the sources, and every document's proof.

A node's label is (level, place). Its digest is a message to its parent, its parent's proof suffix is a message to it; messages
are taken in label order. Up to BAND levels at a time, the messages stay inside a block of 3 ** BAND neighbours: a task reads
the nodes of its blocks in order and a queue ordered by label hands children's digests to their parents, up to the block's top.
Between bands Spark's sorted shuffle is the queue, on disk if it must be: the tops are rows that are dealt and sorted by the
label of the block that they go to next. A source of n documents takes log(n) / (BAND log 3) turns, each with 1 / 3 ** BAND of the rows
of the one before. Then the sweep runs backwards: the suffix of each block's top joins the block's nodes in one sorted shuffle (it comes
first), and inside a block labels in descending order hand suffixes down. At the lowest band the suffix of a leaf is its proof.

A proof is the digests of the leaf's siblings, 32 bytes each, from its own run up to the root; with the leaf's place and the
sizes of the two trees it says where each one stands, so folding needs nothing else.

Rows: a null in any column is `-` in the leaf; null sources are a source of their own, the first; null doc_ids come first in it and
count as the empty text for tampering; rows that repeat a doc_id are leaves of their own, in order of their digests (equal rows are
interchangeable); empty texts are `0:`; very long texts are hashed whole where they are read, only digests move on; an empty table gives no rows. Columns
beyond doc_id, source, lang, n_chars and text don't count.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialize, parallelism, ranked, read_table

RUN = 3
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BATCH = 4096


def digest_of(texts: list[bytes]) -> bytes:
    """The digest (as lower-case hex, in bytes) of the inputs one after another."""
    return hashlib.sha256(b"".join(texts)).hexdigest().encode()


def levels(size: int) -> int:
    """How often a row of so many nodes is shortened until one remains."""
    n = 0
    while size > 1:
        size, n = -(-size // RUN), n + 1
    return n


def sweep(digests: list[bytes], first: int, top: int) -> dict[tuple[int, int], bytes]:
    """Digests of a block's nodes by label, from its leaves (their places begin at first) up to level `top`, by a queue in label order."""
    queue = [((0, first + i), 0, h) for i, h in enumerate(digests)]  # sorted, hence a heap
    made: dict[tuple[int, int], bytes] = {}
    while queue:
        label, inputs = queue[0][0], []
        while queue and queue[0][0] == label:
            inputs.append(heappop(queue)[2])
        level, at = label
        made[label] = inputs[0] if level == 0 else digest_of(inputs)
        if level < top:
            heappush(queue, ((level + 1, at // RUN), at % RUN, made[label]))
    return made


def suffixes(made: dict[tuple[int, int], bytes], top: int, suffix: bytes) -> dict[tuple[int, int], bytes]:
    """The reversed sweep: from the suffix of a block's top, that of every node in it (hex digests of siblings, lowest first)."""
    given: dict[tuple[int, int], bytes] = {}
    for label in sorted(made, reverse=True):
        level, at = label
        if level == top:
            given[label] = suffix
            continue
        start = at - at % RUN
        others = [made[level, i] for i in range(start, start + RUN) if i != at and (level, i) in made]
        given[label] = b"".join(others) + given[level + 1, at // RUN]
    return given


def _blocks(batches, columns: list[str]):
    """Runs of rows with the same tree and block, across batches, as lists of tuples."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield from zip(*(part.column(c).to_pylist() for c in ("tree", "block", *columns)))

    for (tree, block), some in groupby(rows(), key=lambda r: r[:2]):
        yield tree, block, [r[2:] for r in some]


def _emit(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _climb(band: int):
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])

    def climb(batches):
        def tops():
            for tree, block, rows in _blocks(batches, ["idx", "size", "digest"]):
                size = rows[0][1]
                top = min(band, levels(size))
                made = sweep([r[2].hex().encode() for r in rows], rows[0][0], top)
                yield tree, block, -(-size // RUN**top), bytes.fromhex(made[max(made)].decode())

        yield from _emit(tops(), schema)

    return climb


def _dealt(nodes: DataFrame, *first: str) -> DataFrame:
    return nodes.repartition(parallelism(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", *first, "idx")


def bands(nodes: DataFrame, band: int = BAND) -> list[DataFrame]:
    """The nodes (tree, idx, size, digest) of every band-th level above the given ones, theirs first; the last has one row a tree."""
    out, block = [nodes], F.floor(F.col("idx") / F.lit(RUN**band)).cast("long")
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        rows = _dealt(out[-1].select("tree", block.alias("block"), "idx", "size", "digest"))
        out.append(materialize(rows.mapInArrow(_climb(band), "tree string, idx long, size long, digest binary"), "merkle-band"))
    return out


ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _schema(columns: list[tuple[str, str]]) -> tuple[str, pa.Schema]:
    return ", ".join(f"`{c}` {kind}" for c, kind in columns), pa.schema([(c, ARROW[kind]) for c, kind in columns])


def _descend(band: int, schema: pa.Schema, extra: list[str], notes: list[str]):
    def descend(batches):
        def proven():
            for tree, _, rows in _blocks(batches, ["idx", "size", "digest", "suffix", *notes, *extra]):
                told, rows = rows[0], rows[1:]
                top = min(band, levels(rows[0][1]))
                given = suffixes(sweep([r[2].hex().encode() for r in rows], rows[0][0], top), top, told[3].hex().encode())
                for r in rows:
                    yield tree, *r[:3], bytes.fromhex(given[0, r[0]].decode()), *told[4 : 4 + len(notes)], *r[4 + len(notes) :]

        yield from _emit(proven(), schema)

    return descend


def with_suffixes(climbed: list[DataFrame], tops: DataFrame, extra: list[str], notes: list[str], band: int = BAND) -> DataFrame:
    """The lowest band's nodes (tree, idx, size, digest, extra) with `suffix`, their proof, and their tree's notes. tops: tree, suffix and notes of each tree's root."""
    kinds = dict(climbed[0].dtypes) | dict(tops.dtypes)
    below, block = tops.select("tree", F.lit(0).cast("long").alias("block"), "suffix", *notes), F.floor(F.col("idx") / F.lit(RUN**band)).cast("long").alias("block")

    def none(columns):
        return [F.lit(None).cast(kinds.get(c, "bigint")).alias(c) for c in columns]

    for nodes in climbed[-2::-1]:
        own = extra if nodes is climbed[0] else []
        rows = nodes.select("tree", block, "idx", "size", "digest", *none(["suffix", *notes]), *own)
        told = below.select("tree", "block", *none(["idx", "size", "digest"]), "suffix", *notes, *none(own))
        columns = [("tree", "string"), ("idx", "bigint"), ("size", "bigint"), ("digest", "binary"), ("suffix", "binary"), *((c, kinds[c]) for c in [*notes, *own])]
        ddl, schema = _schema(columns)
        made = _dealt(rows.union(told)).mapInArrow(_descend(band, schema, own, notes), ddl)
        if nodes is climbed[0]:
            return made
        below = materialize(made.select("tree", F.col("idx").alias("block"), "suffix", *notes), "merkle-suffix")
    # every tree is a single node
    return climbed[0].select("tree", "idx", "size", "digest", *extra).join(below.drop("block").hint("merge"), "tree")


def fold(leaf: bytes, places: list[tuple[int, int]], path: bytes) -> bytes:
    """The root that a leaf (hex) and its proof (hex digests one after another) lead to; places: (place, size) in each tree, lowest first."""
    at, h = 0, leaf
    for i, n in places:
        while n > 1:
            left = i % RUN
            run = min(RUN, n - i + left)
            mid, end = at + 64 * left, at + 64 * (run - 1)
            h = digest_of([path[at:mid], h, path[mid:end]])
            at, i, n = end, i // RUN, -(-n // RUN)
    return h


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """The leaf of a document's row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(replaced.get(c, F.col(c))) for c in FIELDS)), 256))


def manifest(leaves: DataFrame, extra: list[str], band: int = BAND) -> DataFrame:
    """leaves: doc_id, source, leaf (binary), extra (long, text or binary). Result: doc_id, leaf, place and size (in its source), source_place, sources, subroot, root, proof (binary), extra."""
    # a source's tree has a name that is never null and sorts as the source does, null first
    rows = leaves.select(F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"), "doc_id", F.col("leaf").alias("digest"), *extra)
    climbed = bands(ranked(rows, "tree", ["doc_id", "digest"], "merkle-leaves"), band)
    subroots = climbed[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    over = bands(ranked(subroots, "tree", ["source"], "merkle-sources"), band)
    root = over[-1].select("digest").first()
    proven = with_suffixes(over, over[-1].select("tree", F.unhex(F.lit("")).alias("suffix")), ["source"], [], band)
    proven = proven.select(F.col("source").alias("tree"), F.col("idx").alias("source_place"), F.col("size").alias("sources"), F.col("digest").alias("subroot"), "suffix")
    notes = ["source_place", "sources", "subroot"]
    below = with_suffixes(climbed, materialize(proven, "merkle-subroots"), ["doc_id", *extra], notes, band)
    whole = F.lit(bytes(root.digest) if root else None).cast("binary").alias("root")
    return below.select("doc_id", F.col("digest").alias("leaf"), F.col("idx").alias("place"), "size", *notes, whole, F.col("suffix").alias("proof"), *extra)


_FOLDED = ("leaf", "place", "size", "source_place", "sources", "proof")


def _folder(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            roots = []
            for leaf, *places, proof in zip(*(part.column(c).to_pylist() for c in _FOLDED)):
                roots.append(fold(leaf.hex().encode(), [tuple(places[:2]), tuple(places[2:])], proof.hex().encode()).decode())
            rest = [c for c in part.schema.names if c not in _FOLDED]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(roots, pa.string())], names=[*rest, "folded_root"])


def with_folded_root(proofs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and `folded_root`: the root (hex) that leaf and proof lead to, each row by itself; proofs as from manifest, its leaf perhaps another."""
    kinds = dict(proofs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "folded_root string"])
    return proofs.select(*keep, *_FOLDED).mapInArrow(_folder, ddl)


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and what its leaf, half of them tampered with, folds to."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(id_text().cast("binary")) % 2 == 0, leaf_digest(text=F.regexp_replace("text", "\n", "")))
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"), tampered.alias("tampered"))
    proofs = manifest(leaves, ["tampered"])
    out = proofs.select(
        "doc_id", _hex("leaf").alias("_leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), F.sha2(_hex("proof").cast("binary"), 256).alias("proof_sha256"),
        F.coalesce("tampered", "leaf").alias("leaf"), "place", "size", "source_place", "sources", "proof",
    )
    kept = ["doc_id", "_leaf", "subroot", "root", "proof_sha256"]
    return with_folded_root(out, kept).withColumnRenamed("_leaf", "leaf").withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('+' || source, '') AS tree,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS other,
    -- unsigned crc32: bytes are xor-ed in, -1 is one of the eight shifts after each
    CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) END AS crc
  FROM documents),
leaves AS (SELECT row, doc_id, tree, sha256(head || body) AS h, CASE WHEN crc % 2 = 0 THEN sha256(head || other) ELSE sha256(head || body) END AS changed FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, idx, n, h FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 3, n),
sources AS (SELECT tree, level, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, idx, n, h FROM sources
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY level, idx // 3, n),
nodes AS (SELECT tree, level, idx, n, h FROM up UNION ALL SELECT NULL, level, idx, n, h FROM over),
steps AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT row, tree, 0 AS level, idx, changed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT row, tree, level, idx, h, proof FROM (
    SELECT w.row, s.tree, s.level + 1 AS level, s.idx // 3 AS idx, sha256(s.l || w.h || s.r) AS h, w.proof || s.l || s.r AS proof
    FROM walk w JOIN steps s ON w.tree IS NOT DISTINCT FROM s.tree AND w.level = s.level AND w.idx = s.idx
    UNION ALL
    SELECT w.row, NULL, 0, s.idx, w.h, w.proof FROM walk w JOIN sources s ON w.tree = s.tree AND w.level = s.level)),
root AS (SELECT h FROM over WHERE n = 1),
ends AS (SELECT row, h, proof FROM walk WHERE tree IS NULL AND level = (SELECT max(level) FROM over))
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN ends e USING (row) JOIN sources s USING (tree) CROSS JOIN root
"""
