"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources win blocks of equally many words by highest quotient target / (2 * won + 1). A block has `block_tokens` words, or
fewer if a source is small: a source's and its shards' quotas are whole blocks, so the smallest source's target must be
`shards * 50` blocks at least for each source to come within 1 % of its target, or within a word, as blocks of one word are. A source's
blocks go to its shards in the same way, in proportion to their words, which gives each cell
(source, shard) an integer quota. Inside a cell the documents lie in a seeded order on a line of
words that is cut into blocks of equal size (to a word); the first `quota` ones are taken, a second
round over the line beginning when all have been taken once. So the seeded order says which documents
are taken, whole, and a round's last block ends inside one document of the cell at most: of that one
the words before the end are taken, in one run.

Rows: doc_id may be null or repeat (each row is a document of its own); a null or empty text has
size 0 and takes 0; a null source is a source of its own, last in order; a very long text is one row,
of which the mix may take its first words; equal places on a line are ordered by doc_id and size; an
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fits_broadcast, materialize, read_table, text_of

#: Cells (source, shard) whose plan is broadcast at most: one short row each, never a document.
MAX_BROADCAST = 1_000_000
CELLS = "source string, _shard int, source_size long, target double, line long, n_blocks long, rounds long, picks long"


@dataclass(frozen=True)
class MixPlan:
    """Weights repeat over the sources in code-point order; `share` is the mix's size over all sizes; no source exceeds `cap` times its size."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    block_tokens: int = 64
    min_shards: int = 64
    docs_per_shard: int = 4_000_000
    seed: int = 17


def targets(sizes: dict[str | None, int], plan: MixPlan = MixPlan()) -> dict[str | None, float]:
    """Words wanted from each source: shares by weight, stopped at cap * size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: plan.weights[i % len(plan.weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, active = plan.share * sum(sizes.values()), list(order)
    while active:
        total = sum(weight[s] for s in active)
        share = {s: rest * weight[s] / total for s in active}
        full = [s for s in active if share[s] > plan.cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = plan.cap * sizes[s]
            rest -= out[s]
        active = [s for s in active if s not in out]
    return out


def apportion(wants: list[float], blocks: int) -> list[int]:
    """Sainte-Lague: blocks seats, each to the highest wants[i] / (2 * seats[i] + 1), ties to the lower i."""
    total = sum(wants)
    if total <= 0 or blocks <= 0:
        return [0] * len(wants)
    seats = [int(w * blocks / total + 0.5) for w in wants]  # right up to the last few seats
    short = blocks - sum(seats)
    if short > 0:
        heap = [(-w / (2 * q + 1), i) for i, (w, q) in enumerate(zip(wants, seats)) if w > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            seats[i] += 1
            heapq.heapreplace(heap, (-wants[i] / (2 * seats[i] + 1), i))
    elif short < 0:
        heap = [(wants[i] / (2 * q - 1), -i) for i, q in enumerate(seats) if q > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            seats[-i] -= 1
            if seats[-i] > 0:
                heapq.heappush(heap, (wants[-i] / (2 * seats[-i] - 1), i))
    return seats


def _picked_words() -> Column:
    """Words of the document that are in the blocks of the last round; block j begins at floor(line * j / n_blocks)."""
    end = F.floor(F.col("line") * F.col("picks") / F.col("n_blocks")).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - F.col("start")))


def block_size(wanted: dict[str | None, float], shards: int, plan: MixPlan = MixPlan()) -> int:
    """Words of a block: as many as leave every source with words 50 blocks for each of its shards, between 1 and block_tokens."""
    least = min((w for w in wanted.values() if w > 0), default=0)
    return max(1, min(plan.block_tokens, int(least // (50 * shards))))


def _plan_cells(plan: MixPlan, block: int):
    """The quotas of one source's shards, from (source, _shard, words, source_size, target, won)."""

    def cells(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_shard")
        size, target, won = int(own["source_size"].iloc[0]), float(own["target"].iloc[0]), int(own["won"].iloc[0])
        words = [int(w) for w in own["words"]]
        n_blocks = [max(1, round(w / block)) if w else 0 for w in words]
        blocks = round(won * block * sum(n_blocks) / size) if size else 0
        quotas = apportion([float(n) for n in n_blocks], min(blocks, int(plan.cap * sum(n_blocks))))
        rows = []
        for source, shard, line, n, quota in zip(own["source"], own["_shard"], words, n_blocks, quotas):
            rounds, picks = divmod(quota, n) if n else (0, 0)
            rows.append((source, shard, size, target, line, n, rounds, picks))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return cells


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), keep: tuple[str, ...] = (), max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, start (of the document on its
    cell's line of words), the cell's line (words), n_blocks, rounds and picks, and the columns in keep.

    `rounds` whole rounds are taken plus the first `picks` blocks of the line.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"), *keep)
    sized = materialize(sized, "mix-sizes")
    n_docs = sized.count()
    shards = max(plan.min_shards, -(-n_docs // plan.docs_per_shard))
    sized = sized.withColumn("_at", F.xxhash64(F.lit(plan.seed), "doc_id", "size")).withColumn("_shard", F.pmod("_at", F.lit(shards)).cast("int"))
    cells = materialize(sized.groupBy("source", "_shard").agg(F.sum("size").alias("words")), "mix-cells")
    sizes: dict[str | None, int] = {r["source"]: r["words"] for r in cells.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    wanted = targets(sizes, plan)
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    block = block_size(wanted, shards, plan)
    won = apportion([wanted[s] for s in sources], round(sum(wanted.values()) / block))
    shares = spark.createDataFrame([(s, sizes[s], float(wanted[s]), w) for s, w in zip(sources, won)], "_source string, source_size long, target double, won long")
    shares = F.broadcast(shares) if fits_broadcast(shares, max_broadcast) else shares.hint("merge")
    shared = cells.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan_df = materialize(shared.groupBy("source").applyInPandas(_plan_cells(plan, block), CELLS), "mix-plan")
    before = Window.partitionBy("source", "_shard").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    p = plan_df.withColumnsRenamed({"source": "_source", "_shard": "_cell"})
    p = F.broadcast(p) if fits_broadcast(p, max_broadcast) else p.hint("merge")
    joined = placed.join(p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_cell")))
    taken = F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + F.when(F.col("picks") > 0, _picked_words()).otherwise(0)).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "line", "n_blocks", "rounds", "picks", *keep)


def apply_mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself, with the columns of docs: each document once for every whole round, and once more if the last
    round takes it; the one that this round ends in has its first words only. n_chars, if there, is the new length."""
    mixed = mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), plan, keep=("_row",))
    text = F.col("_row.text")
    pieces = F.regexp_extract_all(text_of(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    words = F.col("taken") - F.col("rounds") * F.col("size")
    partial = F.when((F.col("size") > 0) & (words == F.col("size")), text).when(words > 0, F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    whole = F.when(F.col("size") > 0, F.array_repeat(text, F.col("rounds").cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(whole, F.filter(F.array(partial), lambda t: t.isNotNull() & (t != F.lit(""))))
    out = mixed.withColumn("_texts", texts).withColumn("_text", F.explode("_texts"))
    n_chars = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    columns = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(n_chars)} if n_chars else {})
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
