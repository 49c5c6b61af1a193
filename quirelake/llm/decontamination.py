"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions alone.

A benchmark item's windows are its runs of 13 words (a shorter item is one window). Windows with the
same words are one, whatever items hold them. A document that holds a window holds all of its
neighbouring word pairs, so one pair, the window's rarest in the corpus, is the necessary prefix. The
windows are joined with the pairs of the documents on it; the place of the pair in the document and
in the window says where the window would begin and end, and it is compared word by word. A window
with a pair that no document has is out before the join; an item of one word goes by this word.

Items come in after the join: a window knows the set of items that hold it, by a digest; a document the
digests of its windows; and each combination of digests that documents have is resolved to a list of
items once. A passage that many items and many documents share costs their sum, not their product.

Documents are cut into chunks of 64 words with 12 words of context on each side, so that no row carries
a whole long text. The windows are broadcast up to `max_broadcast` rows and 128 MB, both counted first;
beyond that pairs and places are joined by a shuffle, and the chunks are fetched for the places that match.

Rows: a null or empty text has no words and is clean; an item without words is ignored; items that
share an item_id count once, a null item_id counts as the empty text; doc_id may be null, and rows
that share doc_id but not the text are judged apart; empty tables give empty or clean results.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, attach, fits_broadcast, materialize, read_table, text_of

N = 13
#: What separates words here: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 64
MAX_BROADCAST = 1_000_000
MIN_SHARE = 20  # contaminated if 20 * n_hit >= n_words


def item_words(column: str) -> Column:
    return F.filter(F.split(ascii_lower(text_of(column)), BETWEEN, -1), lambda w: w != F.lit(""))


def corpus_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), at (place of the chunk's first word with context), lo and hi (own words in it, from 0, hi excluded), w."""
    words = docs.select("doc_id", F.xxhash64(text_of("text")).alias("h"), item_words("text").alias("_words"))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(CHUNK)))
    first = lambda s: F.greatest(F.lit(0), s - (N - 1))
    chunk = lambda s: F.struct(
        first(s).alias("at"), (s - first(s)).alias("lo"), (F.least(s + CHUNK, F.size("_words")) - first(s)).alias("hi"),
        F.slice("_words", first(s) + 1, s - first(s) + CHUNK + N - 1).alias("w"),
    )
    return words.select("doc_id", "h", F.explode(F.transform(starts, chunk)).alias("c")).select("doc_id", "h", "c.*")


def own_tokens(chunks: DataFrame, *keep: str, singles: bool) -> DataFrame:
    """A row for each token that a chunk owns: token, k (the place of its first word in the chunk) and the columns in keep.

    Tokens are hashes of the word pairs, and with `singles`, in a pass of their own, of the words.
    """
    placed = chunks.select(*keep, "lo", F.col("w").alias("_w"), F.posexplode(F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo"))).alias("pos", "word"))
    k, following = F.col("lo") + F.col("pos"), F.get("_w", F.col("lo") + F.col("pos") + 1)
    pairs = placed.where(following.isNotNull()).select(*keep, k.alias("k"), F.xxhash64("word", following).alias("token"))
    return pairs.unionByName(placed.select(*keep, k.alias("k"), F.xxhash64("word").alias("token"))) if singles else pairs


def windows(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame, bool]:
    """The distinct windows that documents may hold: token (the rarest), off (its place in the window), size, words, holders (digest
    of the items that hold it); the items of each such digest: holders, items; and whether some windows have one word only."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words("text").alias("iw")).where(F.size("iw") > 0)
    placed = items.select("item_id", F.xxhash64("item_id", "iw").alias("item"), F.size("iw").alias("length"), F.posexplode("iw").alias("a", "word"))
    # texts that repeat under one id are one item
    placed = placed.dropDuplicates(["item_id", "item", "a"])
    order = Window.partitionBy("item_id", "item").orderBy("a")
    following = F.lead("word").over(order)
    token = F.when(F.col("length") == 1, F.xxhash64("word")).when(following.isNotNull(), F.xxhash64("word", following))
    placed = materialize(placed.withColumn("token", token), "bench-placed")
    singles = not placed.where("length = 1").isEmpty()
    vocabulary = materialize(placed.where("token IS NOT NULL").select("token").distinct(), "bench-tokens")
    hint = F.broadcast if fits_broadcast(vocabulary, max_broadcast) else (lambda df: df.hint("merge"))
    whole = docs.select(item_words("text").alias("w")).select("w", F.lit(0).alias("lo"), F.size("w").alias("hi"))
    seen = own_tokens(whole, singles=singles).join(hint(vocabulary), "token").groupBy("token").count()
    rarity = materialize(seen.withColumnRenamed("count", "n"), "bench-rarity")
    # a token that no document has: no window of its
    known = placed.join(hint(rarity), "token", "left").withColumn("rank", F.when(F.col("token").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "a")))
    size = F.least(F.lit(N), F.col("length"))
    starts = known.select(
        "item_id", "length", "a", size.alias("size"), F.min("rank").over(order.rowsBetween(0, N - 2)).alias("r"), F.collect_list("word").over(order.rowsBetween(0, N - 1)).alias("words")
    ).where((F.col("a") <= F.col("length") - F.col("size")) & (F.col("r.n") > 0))
    # equal windows have equal tokens, so the same one is the rarest, at the same place
    held = starts.groupBy("words", "size", F.col("r.token").alias("token"), (F.col("r.a") - F.col("a")).alias("off")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    held = materialize(held.withColumn("holders", F.sha2(F.to_json("items"), 256)), "bench-windows")
    return held.drop("items"), held.groupBy("holders").agg(F.first("items").alias("items")), singles


def hits(docs: DataFrame, marks: DataFrame, singles: bool, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, h, start, size, holders: the places in the documents where windows begin."""
    chunks = corpus_chunks(docs)
    if fits_broadcast(marks, max_broadcast):
        found = own_tokens(chunks, "doc_id", "h", "at", "w", singles=singles).join(F.broadcast(marks), "token")
    else:
        # tokens and places meet the windows by a shuffle; the chunks come after, for the places that are left
        met = own_tokens(chunks, "doc_id", "h", "at", singles=singles).join(marks.hint("merge"), "token").withColumnsRenamed({"doc_id": "_id", "h": "_h", "at": "_at"})
        here = chunks.select("doc_id", "h", "at", "w").distinct()
        found = met.join(here.hint("merge"), (F.col("_h") == F.col("h")) & (F.col("_at") == F.col("at")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    first = F.col("k") - F.col("off")  # the window's start in the chunk
    fits = (first >= 0) & (first + F.col("size") <= F.size("w"))
    equal = F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("size")) == F.col("words")
    return found.where(fits & equal).select("doc_id", "h", (F.col("at") + first).alias("start"), "size", "holders")


def covered(places: DataFrame) -> DataFrame:
    """Per document that holds a window: doc_id, h, n_hit, sets (the sorted digests of its windows' holders)."""
    # a place has at most one window of each size
    spots = places.groupBy("doc_id", "h", "start").agg(F.max("size").alias("size"), F.collect_set("holders").alias("sets"))
    before = Window.partitionBy("doc_id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh_words = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return (
        spots.withColumn("n", fresh_words).groupBy("doc_id", "h")
        .agg(F.sum("n").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sets")))).alias("sets"))
    )


def item_lists(classes: DataFrame, holders: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """class and its sets to class and items, the sorted ids of all items in these sets."""
    hint = F.broadcast if fits_broadcast(holders, max_broadcast) else (lambda df: df.hint("merge"))
    each = classes.select("class", F.explode("sets").alias("holders")).join(hint(holders), "holders")
    return each.groupBy("class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marks, holders, singles = windows(docs, benchmark, max_broadcast)
    found = materialize(covered(hits(docs, marks, singles, max_broadcast)).withColumn("class", F.sha2(F.concat_ws(",", "sets"), 256)), "bench-found")
    classes = materialize(found.groupBy("class").agg(F.first("sets").alias("sets"), F.count("*").alias("n")), "bench-classes")
    lists = item_lists(classes, holders, max_broadcast).select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    digests = materialize(classes.select("class", "n").join(lists.hint("merge"), "class"), "bench-digests")
    judged = attach(found.drop("sets"), digests, ["class"], "n", found.count()).drop("class").withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    base = docs.select("doc_id", F.xxhash64(text_of("text")).alias("h"), F.size(item_words("text")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(judged.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    marks, _, singles = windows(docs, benchmark, max_broadcast)
    found = covered(hits(docs, marks, singles, max_broadcast)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n_hit")
    row = docs.select(F.struct("*").alias("_row"))
    n_words, h = F.size(item_words("_row.text")), F.xxhash64(text_of("_row.text"))
    bad = found.hint("shuffle_hash")
    left = row.join(bad, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (h == F.col("_h")), "left").where(F.col("n_hit").isNull() | (MIN_SHARE * F.col("n_hit") < n_words))
    return left.select("_row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words hit by benchmark windows, items found and verdict."""
    return report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


#: The same in DuckDB: windows of the items against all runs of as many words of the documents.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT d.r, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) AS s FROM d, sizes z WHERE len(d.w) >= z.n)),
found AS (SELECT runs.r, runs.s, runs.n, win.item_id FROM runs JOIN win ON runs.n = win.n AND runs.t = win.t),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN items i ON d.r = i.r
"""
