"""Structured Streaming forms: metric ingest, last-wins dedupe, live peaks and rates, latest stage, incremental extraction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import series
from ..operators.audit import latest_event
from ..sources import io
from ..sources.io import read_metric_payload

POINT = "service string, metric string, ts long, value double"


def read_points(spark: SparkSession, path: str, schema: str = POINT, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of metric points from files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def read_payloads(spark: SparkSession, path: str, measurements: list[str]) -> DataFrame:
    """A stream of points from JSON payload files (service, payload)."""
    return read_metric_payload(spark.readStream.schema("service string, payload string").json(path), measurements)


def run(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append"):
    """All input that is there now, through `batch`, with the offsets in the checkpoint folder."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
    return query


def dedupe_stream(points: DataFrame, retention_seconds: int, path: str, checkpoint: str, slot_seconds: int = 3600):
    """Keep a table of points under path, the last arrival of each second winning, for as long as the retention.

    Rows lie by slots of time. A batch reads and writes the slots that its points fall into, and drops those that the
    retention has passed; points older than that count as too late. A repeated batch changes nothing. With a column
    `arrival`, it orders the points of a batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        inner = F.col("arrival").cast("long") if "arrival" in df.columns else F.lit(0).cast("long")
        clean = df.select(*series.KEY, F.floor(F.col("ts").try_cast("double")).cast("long").alias("ts"), F.col("value").try_cast("double").alias("value"), F.struct(F.lit(number).cast("long").alias("batch"), inner.alias("at")).alias("arrival"))
        clean = clean.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).withColumn("slot", F.floor(F.col("ts") / slot_seconds))
        old = io.existing(spark, path)
        newest = [x for x in (d.agg(F.max("ts")).first()[0] for d in (clean, old) if d is not None) if x is not None]
        if not newest:
            return
        begin = max(newest) - retention_seconds
        slots = [r["slot"] for r in clean.where(F.col("ts") >= begin).select("slot").distinct().collect()]  # bounded by the retention
        if old is not None:
            clean = clean.unionByName(old.where(F.col("slot").isin(slots)).withColumn("slot", F.col("slot").cast("long")))
        kept = clean.where(F.col("ts") >= begin).groupBy(*series.KEY, "ts", "slot").agg(F.max(F.struct("arrival", "value")).alias("x"))
        io.overwrite_parts(kept.select(*series.KEY, "ts", "x.value", "x.arrival", "slot"), path, ["slot"])
        for r in spark.read.parquet(path).where(F.col("slot") < begin // slot_seconds).select("slot").distinct().collect():
            io.delete(spark, f"{path.rstrip('/')}/slot={r['slot']}")

    return run(points, checkpoint, batch)


def stream_rates(points: DataFrame) -> DataFrame:
    """Counters in GB to rates in MB a second across batches: the state of a series is its last point, and a batch's points
    after that give rates; what is older than the state is too late. For append mode."""

    def rates(key, frames, state):
        frame = pd.concat(list(frames)).sort_values(["ts", "arrival"]).drop_duplicates("ts", keep="last")
        last = state.getOption
        if last is not None:
            frame = frame[frame["ts"] > last[0]]
        if len(frame):
            before = ([] if last is None else [last[0]], [] if last is None else [last[1]])
            ts, value = np.append(before[0], frame["ts"]), np.append(before[1], frame["value"])
            state.update((int(ts[-1]), float(value[-1])))
            rate = np.maximum(0.0, np.diff(value) / np.diff(ts) * 1024)
            yield pd.DataFrame({"service": key[0], "metric": key[1], "ts": ts[1:].astype(np.int64), "value": rate})

    return points.groupBy(*series.KEY).applyInPandasWithState(rates, POINT, "ts long, value double", "append", "NoTimeout")


class CounterRates(StatefulProcessor):
    """Rates of a counter by event time. A series' state is its last settled point, and the points that the watermark hasn't passed yet; a timer
    at the earliest of these fires once it has, and then all that are due are put in order, the last arrival of a second winning, and give their
    rates. A series without points for `retention_seconds` is forgotten by a timer of its own, so state doesn't grow with names that were once seen.
    """

    def __init__(self, retention_seconds: int):
        self.retention = retention_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, value double")
        # points in blocks, each three arrays of numbers as bytes
        self.pending = handle.getListState("pending", "ts binary, arrival binary, value binary")

    _KINDS = (np.int64, np.int64, np.float64)

    def _block(self, *arrays):
        return tuple(np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(arrays, self._KINDS))

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for frame in rows:
            if len(frame):
                self.pending.appendList([self._block(frame["ts"], frame["arrival"], frame["value"])])
                first = int(frame["ts"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        blocks = list(self.pending.get()) if self.pending.exists() else []
        ts, arrival, value = (np.concatenate([np.frombuffer(b[i], kind) for b in blocks]) if blocks else np.empty(0, kind) for i, kind in enumerate(self._KINDS))
        late = ts * 1000 > passed
        left = int(late.sum())
        last = self.last.get() if self.last.exists() else None
        if blocks and left < len(ts):
            self.pending.put([self._block(ts[late], arrival[late], value[late])]) if left else self.pending.clear()
        if left:
            self.handle.registerTimer(int(ts[late].min()) * 1000)
        due = ~late if last is None else ~late & (ts > last[0])
        ts, arrival, value = ts[due], arrival[due], value[due]
        order = np.lexsort((arrival, ts))
        ts, value = ts[order], value[order]
        if len(ts):
            final = np.append(ts[1:] != ts[:-1], True)  # the last of each second
            ts, value = ts[final], value[final]
            self.last.update((int(ts[-1]), float(value[-1])))
            self.handle.registerTimer((int(ts[-1]) + self.retention) * 1000)
            if last is not None:
                ts, value = np.append(np.int64(last[0]), ts), np.append(last[1], value)
            rate = np.maximum(0.0, np.diff(value) / np.diff(ts) * 1024)
            if len(rate):
                yield pd.DataFrame({"service": key[0], "metric": key[1], "ts": ts[1:], "value": rate})
        elif last is not None and not left and (last[0] + self.retention) * 1000 <= passed:
            self.last.clear()

    def close(self) -> None:
        pass


def settled_rates(points: DataFrame, lateness: str, retention_seconds: int) -> DataFrame:
    """Counters (service, metric, ts, value, arrival) to rates, each point once the watermark has passed it: points may come as late as `lateness`
    in any order and give the rates that sorted points would; later ones are left out. For append mode; state is kept in RocksDB and
    restored from the checkpoint."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = points.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    return timed.groupBy(*series.KEY).transformWithStateInPandas(CounterRates(retention_seconds), POINT, "append", "eventtime")


def live_current_peak(points: DataFrame, window_seconds: int, now) -> DataFrame:
    """Current value and peak of each series over the trailing window of the retained points."""
    return series.current_peak(series.within(points, now, window_seconds))


def live_rates(points: DataFrame, window_seconds: int, now) -> DataFrame:
    """Counter rates over the trailing window of the retained points, across batches."""
    return series.to_rate(series.within(points, now, window_seconds))


def stream_current_peak(points: DataFrame) -> DataFrame:
    """The running form: current value and peak of each series, for update or complete mode."""
    return series.current_peak(points)


def first_wins(points: DataFrame, retention: str) -> DataFrame:
    """Points (event_time, service, metric) without repeats, the first one staying; state is kept for the retention."""
    return points.withWatermark("event_time", retention).dropDuplicatesWithinWatermark(["service", "metric", "ts"])


def stream_latest_event(events: DataFrame) -> DataFrame:
    """Each document's latest stage so far, for update or complete mode."""
    return latest_event(events)


def incremental(pages: DataFrame, job: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str, buckets: int = 256):
    """Run a batch job on new pages and replace its rows of their keys in the table under path, bucket by bucket; a repeated
    batch changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        io.replace_rows(job(df), path, keys, df, buckets=buckets)

    return run(pages, checkpoint, batch)
