"""A written inverted index: keyword search that reads the posting lists of the query's words and nothing else.

`terms` has a row for each token with its document frequency, `postings` a row for each token and document with the token's share
of every field (occurrences, damped by the field's length), a column a field. Both lie in folders by a hash of the token, sorted by
token, so a word's list is some row groups of one folder, however large the corpus. A folder is written by a task for each
200,000 documents, by a hash of the document, so a token that every document has is spread over tasks and files like any other.
On the way there postings are lists of a token, as many as were counted at once, and only in the files' order they become rows.

A search looks up its words' frequencies (as many rows as it has words), begins with the rarest word's list and meets the
others one after another; no list of candidates is ever longer than the rarest one's, whose length is known before it is read. It gives the rank of
search.keyword to the last few bits, for any weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .search import FIELDS, query_tokens, spaced

BUCKETS = 64
#: Candidates are broadcast up to so many rows (document id and rank), by the rarest word's frequency.
MAX_BROADCAST = 200_000
DAMPING = 100.0
#: A bucket of the index is one task's for each so many documents.
TASK_DOCUMENTS = 200_000
#: Rows whose words are counted at once.
ROWS_AT_ONCE = 500
#: Postings that are put together to lists at once.
BLOCK_POSTINGS = 1_000_000


def bucket_of(token: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(token.encode()) % buckets


def _row_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches of document_uuid, part, once_0 .. and words_0 .. (of n fields; a field's words with a blank between two) to rows of token, document_uuid,
    part, share_0 ..: equal words of a row become one."""
    # a few hundred rows at a time: sorting and coding their words stays in the processor's cache
    for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
        lists = [pc.split_pattern(batch.column(f"words_{i}"), " ") for i in range(n)]
        row = np.concatenate([pc.list_parent_indices(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        flat = [pc.list_flatten(x) for x in lists]
        coded = pa.chunked_array(flat).combine_chunks().dictionary_encode()
        field = np.repeat(np.arange(n), [len(x) for x in flat])
        words = max(len(coded.dictionary), 1)
        keys, at = np.unique(row * words + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        # what lies beside blanks is empty where a field begins or ends with one, or has no words
        keep = np.flatnonzero(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[keys % words])
        of_row = keys[keep] // words
        out = {"token": coded.dictionary.take(pa.array(keys[keep] % words)), "document_uuid": batch.column("document_uuid").take(pa.array(of_row)), "part": batch.column("part").take(pa.array(of_row))}
        for i in range(n):
            times = np.bincount(at[field == i], minlength=len(keys))[keep]
            out[f"share_{i}"] = pa.array(times * batch.column(f"once_{i}").to_numpy()[of_row], mask=times == 0)
        yield pa.RecordBatch.from_pydict(out)


def _block(rows: list[pa.RecordBatch], shares: list[str]) -> pa.RecordBatch:
    """Rows of _row_counts as one row for each token and part, with the list of its postings."""
    table = pa.Table.from_batches(rows).combine_chunks()
    token, document, part, *share = (pa.concat_arrays(c.chunks) for c in table.columns)
    coded = token.dictionary_encode()
    key = part.to_numpy().astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(begin, len(key)).astype(np.int32)
    at, own = pa.array(order), pa.array(order[begin])
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([x.take(at) for x in (document, *share)], ["document_uuid", *shares]))
    return pa.RecordBatch.from_arrays([token.take(own), part.take(own), listed], ["token", "part", "postings"])


def _blocks(batches: Iterator[pa.RecordBatch], shares: list[str]) -> Iterator[pa.RecordBatch]:
    rows: list[pa.RecordBatch] = []
    for counted in _row_counts(batches, len(shares)):
        rows.append(counted)
        if sum(x.num_rows for x in rows) >= BLOCK_POSTINGS:
            yield _block(rows, shares)
            rows = []
    if sum(x.num_rows for x in rows):
        yield _block(rows, shares)


def _worded(df: DataFrame, used: list[str], parts: int) -> DataFrame:
    """document_uuid, part (by a hash of it) and for each field of df what an occurrence of a word adds to the rank, and its words with a blank between two."""
    once = [(F.lit(1.0) / (F.lit(1.0) + F.length(F.coalesce(F.col(f), F.lit(""))) / DAMPING)).alias(f"once_{i}") for i, f in enumerate(used)]
    part = F.pmod(F.xxhash64("document_uuid"), F.lit(parts)).cast("int").alias("part")
    return df.select("document_uuid", part, *once, *[spaced(F.col(f)).alias(f"words_{i}") for i, f in enumerate(used)])


def postings(df: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """token, document_uuid and for each field of df `share_` and its name: what the field adds to the rank of a row with that word at weight 1, null if
    the word isn't in it. Words are counted in batches of rows, so nothing is shuffled for it."""
    used = [f for f in fields if f in df.columns]
    shares = ", ".join(f"share_{i} double" for i in range(len(used)))
    schema = f"token string, document_uuid {dict(df.dtypes)['document_uuid']}, part int, {shares}"
    counted = _worded(df, used, 1).mapInArrow(lambda batches: _row_counts(batches, len(used)), schema).drop("part")
    return counted.withColumnsRenamed({f"share_{i}": f"share_{f}" for i, f in enumerate(used)})


def _listed(df: DataFrame, used: list[str], parts: int) -> DataFrame:
    """postings as a row for each token, part and block of rows that were counted at once: token, part, list of document_uuid and shares."""
    shares = [f"share_{f}" for f in used]
    row = StructType([df.schema["document_uuid"], *[StructField(s, DoubleType()) for s in shares]])
    block = StructType([StructField("token", StringType()), StructField("part", IntegerType()), StructField("postings", ArrayType(row))])
    return _worded(df, used, parts).mapInArrow(lambda batches: _blocks(batches, shares), block)


def write_index(df: DataFrame, path: str, fields: dict[str, float] = FIELDS, buckets: int = BUCKETS) -> None:
    """Index the given fields of df (document_uuid and columns of text) under path. A table without any of the fields has no words."""
    spark, own = df.sparkSession, [f for f in fields if f in df.columns]
    if not own:
        raise ValueError("none of the fields is a column")
    shares = [f"share_{f}" for f in own]
    ids = df.groupBy("document_uuid").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    # a bucket is as many tasks' as there are documents for, so a word that all of them have is several tasks', and no sample has to be drawn
    spread = -(-ids["n"] // TASK_DOCUMENTS) or 1
    folder = (F.crc32(F.col("token").cast("binary")) % F.lit(buckets)).cast("int")
    if (ids["most"] or 0) > 1:  # rows with one id are one document
        once = postings(df, fields).groupBy("token", "document_uuid").agg(*[F.sum(s).alias(s) for s in shares])
        part = F.pmod(F.xxhash64("document_uuid"), F.lit(spread)).cast("int").alias("part")
        lists = once.select("token", part, F.array(F.struct("document_uuid", *shares)).alias("postings"))
    else:
        lists = _listed(df, own, spread)
    lists = lists.withColumn("bucket", folder)
    ordered = lists.repartitionById(buckets * spread, F.col("bucket") * spread + F.col("part")).sortWithinPartitions("bucket", "token", F.get("postings", F.lit(0))["document_uuid"])
    # a task has one bucket, so the order that partitionBy asks for leaves the rows of a list and the lists as they are
    ordered.select("bucket", "token", F.inline("postings")).write.partitionBy("bucket").parquet(f"{path}/postings")
    listed = spark.read.schema("token string, bucket int").parquet(f"{path}/postings")
    terms = listed.groupBy("bucket", "token").agg(F.count("*").alias("documents"))
    terms.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/terms")


def _of_token(table: DataFrame, token: str, buckets: int) -> DataFrame:
    """The rows of one token: its folder, and in it the row groups that may hold it."""
    return table.where((F.col("bucket") == bucket_of(token, buckets)) & (F.col("token") == token))


def frequencies(spark: SparkSession, path: str, wanted: list[str], buckets: int = BUCKETS) -> dict[str, int]:
    """How many documents hold each of the words; a row a word comes to the driver."""
    terms = spark.read.schema("token string, documents long, bucket int").parquet(f"{path}/terms")
    some = terms.where(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in wanted})) & F.col("token").isin(wanted))
    return {r["token"]: r["documents"] for r in some.collect()}


def lookup(spark: SparkSession, path: str, query: str, fields: dict[str, float] = FIELDS, buckets: int = BUCKETS, max_broadcast: int = MAX_BROADCAST, id_type: str = "long", known: dict[str, int] | None = None) -> DataFrame:
    """document_uuid (of the given type) and rank of the documents that hold every word of the query; known: the words' frequencies, if they were read."""
    # a field that the index lacks is null
    columns = ", ".join([f"token string, document_uuid {id_type}", *[f"share_{f} double" for f in fields], "bucket int"])
    listed = spark.read.schema(columns).parquet(f"{path}/postings")
    wanted = query_tokens(query)
    if known is None:
        known = frequencies(spark, path, wanted, buckets) if wanted else {}

    def ranked(token: str) -> DataFrame:
        rank = sum((F.lit(float(w)) * F.coalesce(F.col(f"share_{f}"), F.lit(0.0)) for f, w in fields.items()), F.lit(0.0))
        return _of_token(listed, token, buckets).select("document_uuid", rank.alias("rank"))

    if not wanted or len(known) < len(wanted):
        return listed.where(F.lit(False)).select("document_uuid", F.lit(0.0).alias("rank"))
    order = sorted(wanted, key=lambda t: (known[t], t))
    found, small = ranked(order[0]), known[order[0]] <= max_broadcast
    for token in order[1:]:
        more = ranked(token).withColumnRenamed("rank", "more")
        met = more.join(F.broadcast(found), "document_uuid") if small else found.hint("merge").join(more.hint("merge"), "document_uuid")
        found = met.select("document_uuid", (F.col("rank") + F.col("more")).alias("rank"))
    return found


def keyword(df: DataFrame, path: str, query: str, fields: dict[str, float] = FIELDS, buckets: int = BUCKETS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """As search.keyword, by the index under path: the rows of df that hold every word, with `rank`."""
    wanted = query_tokens(query)
    known = frequencies(df.sparkSession, path, wanted, buckets) if wanted else {}
    found = lookup(df.sparkSession, path, query, fields, buckets, max_broadcast, dict(df.dtypes)["document_uuid"], known)
    few = min(known.values(), default=0) <= max_broadcast
    return df.join(F.broadcast(found) if few else found.hint("merge"), "document_uuid")
