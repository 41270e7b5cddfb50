"""The editor loop as streams: bursts of changes, the latest content of each file, whole results published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(changes: DataFrame, key: str, ts: str, gap: str = "750 milliseconds", late: str | None = None) -> DataFrame:
    """Bursts of changes of a key with less than `gap` between them: key, first, last (when it is quiet), n. Streams need `late`, the watermark."""
    rows = changes.withWatermark(ts, late) if late else changes
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def latest(changes: DataFrame) -> DataFrame:
    """(path, run, content) -> the content of the last run for each path; on a stream, in complete mode."""
    return changes.groupBy("path").agg(F.max_by("content", "run").alias("content"), F.max("run").alias("run"))


def publish(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Calls run(latest contents, batch) for each batch; a batch replaces what earlier ones gave, so a late one is dropped by its number."""
    state = {"last": -1}

    def each(batch: DataFrame, number: int) -> None:
        if number > state["last"]:
            state["last"] = number
            run(batch, number)

    writer = latest(changes).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="750 milliseconds")).start()


def cancel(changes: DataFrame, group: str) -> None:
    """Ends what still runs for a root when a newer change comes."""
    changes.sparkSession.sparkContext.cancelJobGroup(group)
