"""Continuous indexing: debounced events, micro-batches and incremental passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Events that follow each other within the gap, as one burst: batch or streaming."""
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesced(events: DataFrame, ts: str, width: str, reason: str, order: str) -> DataFrame:
    """One pass for each window of time: how many events, and the last one's reason."""
    grouped = events.groupBy(F.window(ts, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max_by(reason, F.struct(ts, order)).alias("reason")).select(F.col("w.start").alias("start"), "n", "reason")


def watch(events: DataFrame, ts: str, key: str, gap: str, late: str, index_pass: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that runs index_pass(bursts, batch id) once a burst is over.

    every: run until stopped, with a pass at most this often; events that come during a pass wait for the
    next one. Without it, what is there is drained in one run, as with a single pass; restart it with the
    same checkpoint to go on. index_pass must be idempotent for a batch id.
    """
    closed = bursts(events.withWatermark(ts, late), key, ts, gap)
    started = closed.writeStream.outputMode("append").foreachBatch(index_pass).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if every is None else started.trigger(processingTime=every)).start()


def drain(query) -> None:
    """Wait until all events so far are indexed, then stop."""
    query.processAllAvailable()
    query.stop()


def with_feed(index_pass: Callable[[DataFrame, int], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A pass that also leaves its counters, one JSON line for each batch; a batch that is run again replaces its own."""

    def run(rows: DataFrame, batch: int) -> None:
        index_pass(rows, batch).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").json(f"{folder}/batch-{batch}")

    return run


def burst_rows(events: DataFrame, key: str, ts: str, seconds: int, order: str) -> DataFrame:
    """Events with the number of their burst, where each row is wanted: by windows over a key's events."""
    w = Window.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = (micros - F.lag(micros).over(w)) >= seconds * 1_000_000
    return events.withColumn("burst", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(w))
