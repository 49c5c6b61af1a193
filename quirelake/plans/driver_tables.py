"""The driver's tables in the shapes that the archive operators take, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents: patient = customer, type = priority, facility = the customer's nation; F: verified, P: deleted."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_uuid"), F.col("c_nationkey").alias("healthcare_facility"), F.col("c_mktsegment").alias("department"), F.col("c_name").alias("physician_name"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_uuid"), F.col("o_custkey").alias("patient_uuid"), F.col("o_orderpriority").alias("document_type"), F.col("o_orderdate").cast("date").alias("document_date"),
        (F.col("o_orderstatus") == "F").alias("date_verified"), F.when(F.col("o_orderstatus") == "P", "DELETED").otherwise("ACTIVE").alias("archive_status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("amount"),
    )
    return orders.join(customers, "patient_uuid", "left")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region as facilities."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region_name"))
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), "n_regionkey", "left")  # 25 and 5 rows at any size
    return nation.select(F.col("n_nationkey").alias("facility_uuid"), F.col("n_name").alias("facility_display"), "region_name")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pages: R is ready, A failed, N waits; the ship date is the page's date."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"),
        F.when(flag == "R", "READY").when(flag == "A", "FAILED").otherwise("AWAITING_CONFIRMATION").alias("processing_status"),
        F.col("l_shipdate").cast("date").alias("document_date"), (flag == "R").alias("date_verified"), F.col("l_partkey").alias("part"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: the user is the document's owner and the patient."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("uuid"), F.col("user_id").alias("document_uuid"), F.col("user_id").alias("patient"), "event_type", F.col("event_type").alias("action"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("metadata"), "value",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metric points: a service for each type, a metric for each user, seconds as time."""
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(10)).cast("string")).alias("metric"), ts.alias("ts"), "value", F.col("event_id").alias("arrival"))


DOCS = """docs AS (
  SELECT o_orderkey AS document_uuid, o_custkey AS patient_uuid, o_orderpriority AS document_type, CAST(o_orderdate AS DATE) AS document_date, o_orderstatus = 'F' AS date_verified,
         CASE WHEN o_orderstatus = 'P' THEN 'DELETED' ELSE 'ACTIVE' END AS archive_status, o_orderdate AS created_at, c_nationkey AS healthcare_facility, c_mktsegment AS department,
         c_name AS physician_name, n_name AS facility_display, r_name AS region_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
PAGES = """pages_ AS (
  SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, CASE l_returnflag WHEN 'R' THEN 'READY' WHEN 'A' THEN 'FAILED' ELSE 'AWAITING_CONFIRMATION' END AS processing_status,
         CAST(l_shipdate AS DATE) AS document_date, l_returnflag = 'R' AS date_verified FROM lineitem)"""
POINTS = """points AS (
  SELECT event_type AS service, 'm' || CAST(user_id % 10 AS VARCHAR) AS metric, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS arrival FROM events)"""
SERIES = POINTS + """,
series AS (SELECT service, metric, ts, arg_max(value, arrival) AS value FROM points GROUP BY ALL)"""
