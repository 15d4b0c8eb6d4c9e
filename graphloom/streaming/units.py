"""Incremental intake of scanned units, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intake(blocks: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a query that hands each micro-batch, files read once, to ``commit``.

    A batch is committed whole: after a failure Spark replays it under the same
    number, so ``commit`` writes by that number.
    """

    def each(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("path").agg(F.min("unit").alias("unit"))
        commit(batch.join(first, ["path", "unit"]), number)

    writer = blocks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tumbling(events: DataFrame, width: str, delay: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by window; on a stream late events past ``delay`` are dropped (an addition of this engine)."""
    e = events.withWatermark(time, delay) if events.isStreaming else events
    return e.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def latest_per_key(events: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Last event of each key."""
    from graphloom.operators.symbols import latest

    return latest(events, list(keys), list(order))
