"""Shared helpers of the training-data operators: patterns, scratch tables, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word for most operators: a run without the ASCII white space 0x20, 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column, spaces: str = SPACES) -> Column:
    """The words of a text as an array; no words: an empty array."""
    return F.filter(F.split(column, spaces, -1), lambda w: w != F.lit(""))


def id_text(column: str = "doc_id") -> Column:
    """A document id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(folds)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; its own folder only if that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside go when the block is left, but for those that are kept: what comes out must not read them."""
    made: list[str] = []
    _TEMPORARY.append(made)
    try:
        yield
    finally:
        _TEMPORARY.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if _TEMPORARY and not keep:
        _TEMPORARY[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


MAX_BROADCAST_MB = 128


def fits_broadcast(df: DataFrame, max_rows: int, max_mb: int = MAX_BROADCAST_MB) -> bool:
    """Whether df, counted and measured, has at most so many rows and so many bytes: 16 a value, and the bytes of its texts."""

    def size(column: Column, kind) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(column, F.lit(0), lambda acc, x: acc + size(x, kind.elementType).cast("int")), F.lit(0)) + 16
        return F.lit(16)

    total = sum((size(F.col(f.name), f.dataType).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))
    rows, width = df.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows <= max_rows and width <= max_mb << 20


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_KEYS = 1000


def attach(rows: DataFrame, table: DataFrame, key: list[str], weight: str, total: int, max_rows: int = 500_000, max_mb: int = 64) -> DataFrame:
    """rows left joined with table, which has one row a key; weight: how many rows each key of table has, total: at least their sum.

    A small table, counted and measured, is broadcast. Else only the keys that hold more than one row in HOT_KEYS of all are
    (fewer than HOT_KEYS, whatever the data), and the rest is a merge join without any hot key. Keys that hold many rows
    must be in table.
    """
    own = table.drop(weight)
    if fits_broadcast(own, max_rows, max_mb):
        return rows.join(F.broadcast(own), key, "left")
    is_hot = F.col(weight) * F.lit(HOT_KEYS) > F.lit(total)
    hot = table.where(is_hot).drop(weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot).drop(weight).hint("merge"), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `idx` (from 0, the place in its group by order, nulls first) and `size` (the rows of the group), written and read back.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks; a group's rows in each range are
    counted, and running sums of these counts (a row for each range that a group is in) place the ranges. group must not be null.
    """
    spark, by = rows.sparkSession, [group, *order]
    sorted_rows = rows.repartitionByRange(parallelism(spark), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(sorted_rows.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name)
    runs = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("_part", group, (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("size")), f"{name}-runs")
    runs = F.broadcast(runs) if fits_broadcast(runs, 500_000, 64) else runs.hint("merge")
    return placed.join(runs, ["_part", group]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
