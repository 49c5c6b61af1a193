"""Metric series: points (service, metric, ts in seconds, value); batch forms that the streams use too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("service", "metric")
MAX_POINTS, MIN_STALE_SECONDS = 720, 30


def dedupe_series(points: DataFrame, arrival: str | None = "arrival") -> DataFrame:
    """The last value of each second; points whose time or value is no number are skipped."""
    clean = points.select(*KEY, F.floor(F.col("ts").try_cast("double")).cast("long").alias("ts"), F.col("value").try_cast("double").alias("value"), *([arrival] if arrival else []))
    clean = clean.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    last = F.max_by("value", arrival) if arrival else F.max("value")
    return clean.groupBy(*KEY, "ts").agg(last.alias("value"))


def read_series(points: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """The first points of each series in ascending order, so the oldest ones."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("ts"))
    return points.withColumn("_nth", nth).where(F.col("_nth") <= max_points).drop("_nth")


def to_rate(points: DataFrame) -> DataFrame:
    """Counters in GB to rates in MB a second; a counter that falls gives 0, steps of no time are skipped."""
    order = Window.partitionBy(*KEY).orderBy("ts")
    dt, dv = F.col("ts") - F.lag("ts").over(order), F.col("value") - F.lag("value").over(order)
    steps = points.withColumn("dt", dt).withColumn("dv", dv).where("dt > 0")
    return steps.select(*KEY, "ts", F.greatest(F.lit(0.0), F.col("dv") / F.col("dt") * 1024).alias("value"))


def within(points: DataFrame, now: Column, seconds: int) -> DataFrame:
    return points.where(F.col("ts") >= now - seconds)


def current_peak(points: DataFrame) -> DataFrame:
    """Each series' last value and highest value."""
    return points.groupBy(*KEY).agg(F.max_by("value", "ts").alias("current"), F.max("value").alias("peak"))


def stale(points: DataFrame, now: Column, sample_seconds: int = 5, status: Column | None = None) -> DataFrame:
    """Each service's last time, and whether it is stale: its status isn't OK, or it is older than three samples and 30 seconds."""
    limit = max(3 * sample_seconds, MIN_STALE_SECONDS)
    bad = F.coalesce(status != "OK", F.lit(True)) if status is not None else F.lit(False)
    per = points.groupBy("service").agg(F.max("ts").alias("last_ts"), F.bool_or(bad).alias("bad"))
    return per.select("service", "last_ts", (F.col("bad") | (now - F.col("last_ts") > limit)).alias("stale"))
