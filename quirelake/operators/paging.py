"""Keyset paging over a written, range-sorted layout: any page reads the one or two parts that hold it.

The rows are dealt to parts by ranges of the order's columns and sorted in them; `layout` has a row for each part: its number of rows
and its first and last key. A page after a given key, or the page with a given number, is found in the layout, and its parts are read by their
folder, put in order and cut to the page: page 500 reads what page 1 reads. The number of rows in all is a sum over the layout.

An order is a list of (column, descending); its last columns must make it total, as a document's id does. Nulls come last in
a descending order and first in an ascending one, as in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SIZE = 20
PART_ROWS = 50_000
Order = list[tuple[str, bool]]
#: Newest first, as the archive lists documents, and as it lists those that wait for confirmation.
CHRONOLOGY: Order = [("sort_date", True), ("created_at", True), ("document_uuid", True)]
UNCONFIRMED: Order = [("created_at", True), ("document_uuid", True)]


def after(order: Order, key: dict, prefix: str = "") -> Column:
    """Whether a row comes behind the key."""
    out = F.lit(False)
    for c, down in reversed(order):
        column, value = F.col(prefix + c), F.lit(key[c])
        if key[c] is None:
            behind = F.lit(False) if down else column.isNotNull()
        else:
            behind = ((column < value) | column.isNull()) if down else F.coalesce(column > value, F.lit(False))
        out = behind | (column.eqNullSafe(value) & out)
    return out


def write_pages(df: DataFrame, path: str, order: Order, part_rows: int = PART_ROWS) -> None:
    """Lay df out in the order under path, in parts of about so many rows."""
    spark, by = df.sparkSession, [F.desc(c) if down else F.asc(c) for c, down in order]
    parts = max(1, -(-df.count() // part_rows))
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    placed.write.partitionBy("part").parquet(f"{path}/rows")
    key = F.struct(*[F.col(c) for c, _ in order])
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    rows.groupBy("part").agg(F.count("*").alias("rows"), F.min_by(key, "at").alias("first"), F.max_by(key, "at").alias("last")).coalesce(1).write.parquet(f"{path}/layout")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, first, last of every part."""
    return spark.read.parquet(f"{path}/layout")


def total(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows in all, as `total`; the rows themselves aren't read."""
    return layout(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))


def _cut(spark: SparkSession, path: str, parts: list[int], where: Column, skip: int, size: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(parts)).where(where)
    return rows.orderBy("at").offset(skip).limit(size).drop("part", "at")


def _enough(candidates: list, size: int, skip: int = 0) -> list[int]:
    """The first parts that have a page's rows among them, though of the first one all but a row may be passed over."""
    parts, have = [], -skip
    for r in candidates:
        if have >= size:
            break
        have += r["rows"] if parts or skip else 1
        parts.append(r["part"])
    return parts


def page_after(spark: SparkSession, path: str, order: Order, key: dict | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind the row with the given key (the order's columns), or the first page; empty behind the last row."""
    there = layout(spark, path)
    if key is not None:
        there = there.where(after(order, key, "last."))
    # each part has a row, so a page and a half-read part are size + 1 parts at most
    parts = _enough(there.orderBy("part").limit(size + 1).select("part", "rows").collect(), size)
    return _cut(spark, path, parts, F.lit(True) if key is None else after(order, key), 0, size)


def page_number(spark: SparkSession, path: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """The page with this number, from 1; its parts are found by the parts' numbers of rows."""
    skip = (number - 1) * size
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    there = layout(spark, path).withColumn("before", before).where((F.col("before") + F.col("rows") > skip) & (F.col("before") < skip + size))
    found = there.orderBy("part").limit(size + 1).select("part", "rows", "before").collect()
    return _cut(spark, path, [r["part"] for r in found], F.lit(True), skip - found[0]["before"] if found else 0, size)


def key_of(row, order: Order) -> dict:
    """The key by which the page behind this row is found."""
    return {c: row[c] for c, _ in order}
