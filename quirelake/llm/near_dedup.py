"""Near-duplicate documents: MinHash bands for candidates, odd sketches to verify them, full shingle sets to confirm.

1. Documents with the same words in the same order are one class (128-bit hash); everything below
   works on classes, so copies never meet in pairs.
2. A class has `bands * rows` MinHash values over its 5-word shingles. They give the band keys, and
   they are folded into an odd sketch: a bitmap whose bits flip for each (place, value), so that the
   popcount of the XOR of two sketches tells how many values differ: J = 1 + n / 4k * ln(1 - 2x / n).
3. Classes that share a band key form a bucket. Each bucket links its members to one of them (a star,
   not all pairs); candidates whose sketches say well under the threshold go, the others are
   confirmed on their full shingle sets, and links make components.
4. Members of buckets that still hold several components get a second star with other centres. What
   is left in mixed buckets is compared exactly and without regard to buckets: a class that links
   with another shares one of its rarest quarter of shingles with it (shingles ordered by how many
   of these classes have them), so only classes of different components that share such a shingle,
   and whose sketches agree, are confirmed. Passages that many documents share are frequent, come
   last in that order, and make no pairs.

The chance that a pair with similarity 0.75 shares no band is (1 - 0.75^5)^40 = 2e-5.

Rows: a null or empty text has no shingles and is linked with nothing; with 1 to 4 words the whole
sequence is the one shingle; rows that repeat a doc_id are one document as far as links go; a row
without doc_id is linked with nothing, has no component and is kept; a pair at exactly 75 in 100 is
linked; a very long text is one set, compared whole; an empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, temporary, text_of
from .components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Candidates whose sketches estimate less than this are dropped: 4.75 standard deviations under the threshold, 1 link in a million.
SKETCH_FLOOR = 0.553
STARS, SEEN = 2, 64

_MASK = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; with fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    rolled = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = mix64(rolled * _GOLD + h[k : len(h) - width + 1 + k])
    return np.unique(rolled)


def words_of_bytes(text: bytes | None) -> list[bytes]:
    """bytes.lower touches A-Z only and bytes.split cuts at the ASCII white space only, as wanted."""
    return (text or b"").lower().split()


def min_hashes(shingles: np.ndarray, multipliers: np.ndarray, masks: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), _MASK, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[None, at : at + 2048] ^ masks) * multipliers[:, None]).min(axis=1), out=low)
    return low


def _families() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    return mix64(k * _GOLD) | np.uint64(1), mix64(k * _GOLD + np.uint64(77))[:, None]


def band_keys(mins: np.ndarray) -> np.ndarray:
    """documents x bands: each band's values and number in one 64-bit key."""
    by = mins.reshape(len(mins), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), by.shape[:2])
    for r in range(ROWS):
        key = mix64(key * _GOLD + by[:, :, r])
    return key


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """documents x SKETCH_BITS / 64 words: bit p holds the parity of the values that hash to p."""
    bit = (mix64(mins + np.arange(1, mins.shape[1] + 1, dtype=np.uint64) * _GOLD) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = bit + np.arange(len(mins))[:, None] * SKETCH_BITS
    parity = (np.bincount(flat.ravel(), minlength=len(mins) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(mins), SKETCH_BITS), axis=1).view(np.uint64)


def sketch_limit(floor: float = SKETCH_FLOOR) -> int:
    """The popcount of the XOR at which the estimated similarity falls to floor."""
    k = BANDS * ROWS
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * k * (1 - floor) / SKETCH_BITS)))


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_DESCRIBED = "doc_id long, k1 long, k2 long, n long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def _describe(batches):
    """Per document the class key, the number of shingles, band keys and sketch; at most 512 texts at a time."""
    multipliers, masks = _families()
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys, sizes, mins = [], [], np.full((part.num_rows, BANDS * ROWS), _MASK, np.uint64)
            for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                words = words_of_bytes(text)
                keys.append(xxhash.xxh3_128_intdigest(b" ".join(words)))
                shingles = shingle_hashes(words)
                sizes.append(len(shingles))
                if len(shingles):
                    mins[i] = min_hashes(shingles, multipliers, masks)
            bands, sketches = band_keys(mins), odd_sketches(mins)
            k1, k2 = (np.array([(k >> s) & _MASK for k in keys], np.uint64) for s in (64, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) * BANDS + 1, BANDS, dtype=np.int32)), signed(bands.ravel()))
            columns = [part.column(0), signed(k1), signed(k2), pa.array(sizes, pa.int64()), lists, *[signed(sketches[:, i]) for i in range(len(_SKETCH))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "bands", *_SKETCH])


def _sets(batches):
    """The shingle set of each text whose class key is the wanted one."""
    for batch in batches:
        wanted = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        for at in range(0, batch.num_rows, 512):
            cids, sets = [], []
            for (cid, k1, k2), text in zip(wanted[at : at + 512], batch.column(3).slice(at, 512).cast(pa.binary()).to_pylist()):
                words = words_of_bytes(text)
                if xxhash.xxh3_128_intdigest(b" ".join(words)) == ((k1 & _MASK) << 64 | (k2 & _MASK)):
                    cids.append(cid)
                    sets.append(shingle_hashes(words).view(np.int64))
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["cid", "shingles"])


def describe(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): class key (k1, k2), n shingles, bands and sketch."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(_describe, _DESCRIBED)


def _both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both ends, as a_x and b_x."""
    for end in ("a", "b"):
        pairs = pairs.join(_named(of, end, columns).hint("merge"), end)
    return pairs


def _named(of: DataFrame, end: str, columns: list[str]) -> DataFrame:
    return of.select(F.col("cid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def _sketch_distance() -> Column:
    return sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"a_{_SKETCH[0]}").bitwiseXOR(F.col(f"b_{_SKETCH[0]}"))))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sketches don't say that they are far apart."""
    return _both(pairs, classes, _SKETCH).where(_sketch_distance() <= sketch_limit()).select("a", "b")


def _confirm(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link, by their full sets."""
    full = _both(materialize(near, "nd-near"), sets, ["shingles"])
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    counted = full.select("a", "b", common.alias("common"), (F.size("a_shingles") + F.size("b_shingles")).alias("total"))
    return counted.where(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b")


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with its centre, for the order of this turn; bands fall into 4 orders, so that members meet several centres."""
    order = F.xxhash64("cid", F.lit(turn), F.pmod("key", F.lit(4)))
    centre = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "cid", "root")).alias("c"))
    centre = centre.select("key", F.col("c.cid").alias("b"), F.col("c.root").alias("b_root"))
    met = members.join(centre.hint("merge"), "key").where(F.col("root") != F.col("b_root"))
    return met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def _mixed(members: DataFrame, roots: DataFrame | None, *more: str) -> DataFrame:
    """The members of buckets that hold several components, with `minor` false in the bucket's largest one, and more columns."""
    if roots is not None:
        labelled = members.select("key", "cid").join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")).hint("merge"), F.col("cid") == F.col("_n"), "left")
        members = materialize(labelled.select("key", "cid", F.coalesce("_r", "cid").alias("root")), "nd-labelled")
    per = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("top")).where(F.col("roots") > 1)
    kept = members.join(per.hint("merge"), "key").select("key", "cid", "root", "members", (F.col("root") != F.col("top.root")).alias("minor"), *more)
    return materialize(kept, "nd-mixed")


def _rare_shingles(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """key (a shingle), cid, root: of each class in mixed buckets the rarest shingles, one of which any class that links with it has too.

    Shingles that only one class has come first in the order and lead nowhere, so they are only counted. With n, the size of
    the class's set, how many shingles that others have too stand before (`before`) and from here on (`left`), and whether the
    shingle is among the fewer ones that a link with a set that isn't smaller must hit (`short`): such a link shares 6 / 7 of the set.
    `earlier` holds the last SEEN of the keys before, by which a pair is made once and not for each key that it shares.
    """
    own = mixed.select("cid", "root").distinct().join(sets.hint("merge"), "cid").select("cid", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    shared = own.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1")
    rows = own.join(shared.hint("merge"), "key")
    of = Window.partitionBy("cid")
    order = of.orderBy("classes", "key")
    nth, earlier = F.row_number().over(order), F.collect_list("key").over(order.rowsBetween(-SEEN, -1))
    must_share = F.floor((PERCENT * F.col("n") + 99) / 100)
    ranked = rows.withColumn("nth", nth).withColumn("earlier", earlier).withColumn("shared", F.count("*").over(of)).where(F.col("nth") <= F.col("shared") - must_share + 1)
    place, short = F.col("nth") - 1, F.col("nth") <= F.col("shared") - F.floor((6 * F.col("n") + 6) / 7) + 1
    return materialize(ranked.select("key", "cid", "root", "n", place.alias("before"), (F.col("shared") - place).alias("left"), short.alias("short"), "earlier"), "nd-rare")


def _across(rare: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a key, can have enough in common by the sizes of their sets and the
    key's place in both, and whose sketches agree; in a key's largest component nothing is paired.

    What two classes share lies before the key in both or from the key on in both; a link needs 3 / 7 of both sizes.
    """
    columns = ("n", "before", "left", "short", "minor", "earlier", *_SKETCH)
    sketched = rare.join(classes.select("cid", *_SKETCH).hint("merge"), "cid")
    end = lambda df, x: df.select("key", F.col("root").alias(f"{x}_root"), F.col("cid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    enough = 7 * (F.least("a_before", "b_before") + F.least("a_left", "b_left")) >= 3 * (F.col("a_n") + F.col("b_n"))
    short = F.when((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b"))), F.col("a_short")).otherwise(F.col("b_short"))
    once = (~F.col("b_minor") | (F.col("a") < F.col("b"))) & ~F.arrays_overlap("a_earlier", "b_earlier")
    minor, other = end(sketched.where("minor"), "a"), end(sketched, "b")
    met = minor.join(other.hint("merge"), (minor["key"] == other["key"]) & (F.col("a_root") != F.col("b_root")) & short & enough & once & (_sketch_distance() <= sketch_limit()))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described rows, classes): classes have k1, k2 and component_id. The tables on the way there are deleted."""
    described = materialize(describe(docs), "nd-docs", keep=True)
    with temporary(docs.sparkSession):
        return described, _classes(docs, described)


def _classes(docs: DataFrame, described: DataFrame) -> DataFrame:
    """The classes of described rows with their component_id."""
    whole = described.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = [F.first(c).alias(c) for c in ("n", "bands", *_SKETCH)]
    classes = whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *first).withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes, "nd-classes")

    banded = classes.select("cid", F.explode("bands").alias("key"))
    shared = materialize(banded.groupBy("key").count().where("count > 1").select("key"), "nd-buckets")
    members = materialize(banded.join(shared.hint("merge"), "key").select("key", "cid", F.col("cid").alias("root")), "nd-members")
    wanted = members.select("cid").distinct().join(classes.select("cid", "doc_id", "k1", "k2").hint("merge"), "cid")
    wanted = materialize(wanted, "nd-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(wanted.hint("shuffle_hash"), "doc_id")
    sets = texts.select("cid", "k1", "k2", "text").mapInArrow(_sets, "cid long, shingles array<long>")
    sets = materialize(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "nd-sets")

    links, roots = None, None
    for turn in range(STARS + 1):
        mixed = _mixed(members, roots)
        if mixed.isEmpty():
            break
        near = _near(_stars(mixed, turn), classes) if turn < STARS else _across(_mixed(_rare_shingles(mixed, sets), None, "n", "before", "left", "short", "earlier"), classes)
        found = materialize(_confirm(near, sets), "nd-links")
        links = found if links is None else links.union(found)
        roots = components(links)
    if roots is not None:
        labelled = classes.join(roots.select(F.col("node").alias("_n"), "root").hint("merge"), F.col("cid") == F.col("_n"), "left").drop("_n")
    else:
        labelled = classes.withColumn("root", F.col("cid"))
    labelled = labelled.select("k1", "k2", "doc_id", F.coalesce("root", "cid").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return materialize(labelled.join(smallest.hint("merge"), "root").select("k1", "k2", "component_id"), "nd-components", keep=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    described, classes = near_classes(docs)
    rows = described.select("doc_id", "k1", "k2", "n").join(classes.hint("merge"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of docs: the one whose doc_id is the component's. Rows that repeat a
    doc_id are one document, of which the row with the smallest hash stays; rows without doc_id all stay."""
    keep = near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_keep")).distinct()
    keep = materialize(keep, "nd-keep")
    rows = docs.select(F.struct("*").alias("_row"))
    kept = rows.join(keep.hint("shuffle_hash"), F.col("_row.doc_id") == F.col("_keep"))
    one = Window.partitionBy("_keep").orderBy(F.xxhash64("_row"))
    kept = kept.withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return kept.select("_row.*").union(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, component and whether it stays."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
