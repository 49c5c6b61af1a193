"""Archive queries over document tables: filters, chronologies, grouped summaries, facility joins.

A document table has patient_uuid, document_uuid, document_type, document_date, date_verified,
archive_status, created_at and healthcare_facility; every function takes and returns DataFrames.
Filters are ranges and equalities on plain columns, so that they reach the Parquet scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = "ACTIVE"
PAGE_SIZE = 20


def effective_sort_date() -> Column:
    """The confirmed document date, else the time of creation."""
    return F.when(F.col("date_verified") & F.col("document_date").isNotNull(), F.col("document_date").cast("timestamp")).otherwise(F.col("created_at"))


def age_on(born: Column, day: Column) -> Column:
    """Age in whole years on a day."""
    before = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(born), F.dayofmonth(born))
    return F.year(day) - F.year(born) - before.cast("int")


def is_minor(born: Column, day: Column) -> Column:
    return age_on(born, day) < 18


def archive_card(df: DataFrame) -> DataFrame:
    """The columns that an archive list shows, the facility nested."""
    facility = F.when(F.col("healthcare_facility").isNotNull(), F.struct(F.col("healthcare_facility").alias("uuid"), F.col("facility_display").alias("name")))
    return df.select("document_uuid", "document_type", "title", "document_date", "date_verified", "created_at", facility.alias("healthcare_facility"))


def active(df: DataFrame, patient=None) -> DataFrame:
    """Active documents, of one patient or of a DataFrame of patient_uuid."""
    kept = df.where(F.col("archive_status") == ACTIVE)
    if patient is None:
        return kept
    if isinstance(patient, DataFrame):
        return kept.join(patient.select("patient_uuid"), "patient_uuid", "left_semi")
    return kept.where(F.col("patient_uuid") == patient)


def by_type(df: DataFrame, document_type: str | None) -> DataFrame:
    return df if document_type is None else df.where(F.col("document_type") == document_type)


def by_facility(df: DataFrame, facility) -> DataFrame:
    return df if facility is None else df.where(F.col("healthcare_facility") == facility)


def by_year(df: DataFrame, year: int) -> DataFrame:
    """Dated in the year, as a half-open range that the scan can push down."""
    return df.where((F.col("document_date") >= F.lit(date(year, 1, 1))) & (F.col("document_date") < F.lit(date(year + 1, 1, 1))))


def by_month(df: DataFrame, year: int, month: int) -> DataFrame:
    end = date(year + month // 12, month % 12 + 1, 1)
    return df.where((F.col("document_date") >= F.lit(date(year, month, 1))) & (F.col("document_date") < F.lit(end)))


def chronology(df: DataFrame) -> DataFrame:
    """Newest first: sort date, time of creation, uuid, all descending."""
    return df.withColumn("sort_date", effective_sort_date()).orderBy(F.desc("sort_date"), F.desc("created_at"), F.desc("document_uuid"))


def unconfirmed_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("document_uuid"))


def page(ordered: DataFrame, number: int, size: int = PAGE_SIZE) -> tuple[DataFrame, int]:
    """One page of an ordered table, counted from 1, and the number of rows in all."""
    return ordered.offset((number - 1) * size).limit(size), ordered.count()


def with_facility(df: DataFrame, facilities: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Documents with their facility's columns (facility_uuid is the key); the dimension is broadcast while it is small."""
    side = facilities.withColumnRenamed("facility_uuid", "_facility")
    side = F.broadcast(side) if facilities.count() <= max_broadcast else side
    return df.join(side, F.col("healthcare_facility") == F.col("_facility"), "left").drop("_facility")


def unconfirmed(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Active documents with a page that waits for confirmation, once each."""
    return active(df).join(pending_pages(pages).select("document_uuid"), "document_uuid", "left_semi")


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("processing_status") == "AWAITING_CONFIRMATION") & ~F.col("date_verified"))


def verified(df: DataFrame) -> DataFrame:
    return active(df).where(F.col("date_verified") & F.col("document_date").isNotNull())


def count_by_year(df: DataFrame) -> DataFrame:
    return verified(df).groupBy(F.year("document_date").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def count_by_month(df: DataFrame) -> DataFrame:
    months = verified(df).groupBy(F.year("document_date").alias("year"), F.month("document_date").alias("month"))
    return months.agg(F.count("*").alias("n")).orderBy(F.desc("year"), F.desc("month"))


def year_tree(df: DataFrame) -> DataFrame:
    """A row for each year, newest first, with its months nested, newest first."""
    months = count_by_month(df).groupBy("year").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("month", "n")), False).alias("months"))
    return months.orderBy(F.desc("year"))


def count_by_type(df: DataFrame) -> DataFrame:
    return active(df).groupBy("document_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_type")


def count_by_facility(df: DataFrame, name: str = "facility_display") -> DataFrame:
    placed = active(df).where(F.col("healthcare_facility").isNotNull())
    return placed.groupBy("healthcare_facility", name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def unconfirmed_count(df: DataFrame, pages: DataFrame) -> DataFrame:
    """How many pages (not documents) of each patient wait for confirmation."""
    return pending_pages(pages).join(active(df).select("document_uuid", "patient_uuid"), "document_uuid").groupBy("patient_uuid").agg(F.count("*").alias("n"))


def summary_cells(df: DataFrame) -> DataFrame:
    """Every patient's counts by year, month, type and facility in one scan: patient_uuid, dimension, year, month, value, n.

    Years and months count confirmed dates, types and facilities all active documents.
    """
    dated = F.col("date_verified") & F.col("document_date").isNotNull()
    rows = active(df).select(
        "patient_uuid", F.when(dated, F.year("document_date")).alias("year"), F.when(dated, F.month("document_date")).alias("month"),
        "document_type", F.col("healthcare_facility").cast("string").alias("facility"), dated.alias("dated"),
    )
    cells = rows.groupingSets(
        [[F.col("patient_uuid"), F.col("year")], [F.col("patient_uuid"), F.col("year"), F.col("month")], [F.col("patient_uuid"), F.col("document_type")], [F.col("patient_uuid"), F.col("facility")]],
        "patient_uuid", "year", "month", "document_type", "facility",
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # the id's bits, from the left: patient, year, month, type, facility; 1 where the column isn't grouped by
    kind = F.when(F.col("g") == 0b00111, "year").when(F.col("g") == 0b00011, "month").when(F.col("g") == 0b01101, "type").otherwise("facility")
    value = F.when(kind == "type", F.col("document_type")).when(kind == "facility", F.col("facility"))
    kept = cells.where(~(kind.isin("year", "month") & F.col("year").isNull()) & ~((kind == "facility") & F.col("facility").isNull()))
    return kept.select("patient_uuid", kind.alias("dimension"), "year", "month", value.alias("value"), "n")


def summary(df: DataFrame, pages: DataFrame) -> DataFrame:
    """One record for each patient: nested years, types and facilities, and the number of pages that wait."""
    cells = summary_cells(df)
    pick = lambda kind, *cols: F.collect_list(F.when(F.col("dimension") == kind, F.struct(*cols)))
    nested = cells.groupBy("patient_uuid").agg(
        F.sort_array(pick("year", "year", "n"), False).alias("years"), F.sort_array(pick("month", "year", "month", "n"), False).alias("months"),
        F.sort_array(pick("type", F.negative("n").alias("minus_n"), F.col("value").alias("document_type"))).alias("types"),
        F.sort_array(pick("facility", F.negative("n").alias("minus_n"), F.col("value").alias("facility"))).alias("facilities"),
    )
    waiting = unconfirmed_count(df, pages).withColumnRenamed("n", "unconfirmed_count")
    return nested.join(waiting, "patient_uuid", "full").withColumn("unconfirmed_count", F.coalesce("unconfirmed_count", F.lit(0)))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def earliest_other(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows of keys that several rows share, with `earliest_other`: the value of the earliest of the other rows.

    Only the two earliest rows of a key matter, and they are found by partial aggregates, whatever the key's size.
    """
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    first = df.groupBy(*keys).agg(F.min(pair).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    joined = df.join(first, keys)
    second = joined.where(pair != F.col("first")).groupBy(*keys).agg(F.min(pair).alias("second"))
    met = joined.join(second, keys)
    return met.withColumn("earliest_other", F.when(pair == F.col("first"), F.col("second.v")).otherwise(F.col("first.v"))).drop("first", "second", "rows")


def next_pending(df: DataFrame) -> DataFrame:
    """For each row of a queue the next one: the first created later, else the queue's first. A queue is one reviewer's list."""
    order = Window.partitionBy("queue").orderBy("created_at", "document_uuid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.lead("document_uuid").over(order)
    first = F.first("document_uuid").over(whole)
    return df.withColumn("next_uuid", F.coalesce(follower, F.when(first != F.col("document_uuid"), first)))
