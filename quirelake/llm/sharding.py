"""Consistent sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots (offset and stride from a hash of its name, the
table's size is prime); shards take turns, each claiming its next free slot, until the table is
full. A document's key hashes to a slot, the slot names the shard. The table has `slots` rows
whatever the data, so it is broadcast. Adding or removing a shard moves few keys.

Rows: a null key places like the empty text; equal keys go to one shard; an empty or null text
doesn't matter, only the key is read; an empty table gives an empty result. `shard` and `slot`
columns that the input has already are replaced by shard_documents' own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read_table

N_SHARDS, SLOTS = 64, 65_537


def _hash(text: str, seed: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{text}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index in each slot. slots: a prime, best over 100 times the number of shards."""
    if not is_prime(slots) or not 0 < len(shards) <= slots:
        raise ValueError("slots must be a prime not below the number of shards, of which there is at least one")
    at = [_hash(s, "offset") % slots for s in shards]
    stride = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def shard_documents(docs: DataFrame, shards: list[str] | int = N_SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """docs with `slot` (int) and `shard` (int, the index of the shard)."""
    names = [f"shard-{k}" for k in range(shards)] if isinstance(shards, int) else shards
    rows = list(enumerate(lookup_table(names, slots)))
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard int")
    slot = (F.conv(F.substring(F.md5(id_text(key).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")
    rest = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    return docs.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*rest, "slot", "shard")  # slots rows


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; each shard's rows are dealt to files_per_shard tasks, so no shard is one task's work alone."""
    dealt = sharded.repartition(F.col("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard)))
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return shard_documents(read_table(spark, sf_dir, "documents").select("doc_id"))
