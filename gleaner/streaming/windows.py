"""Streaming forms of the volume operators; an extension, as batch is all that is asked elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling_counts(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each window; those later than the watermark are left out."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.window("__ts", size), *keys).agg(F.count("*").alias("rows"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows")


def sliding_counts(events: DataFrame, size: str, slide: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", size, slide)).agg(F.count("*").alias("rows")).select("window.start", "window.end", "rows")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(key, F.session_window("__ts", gap)).agg(F.count("*").alias("rows")).select(key, "session_window.start", "session_window.end", "rows")


def encode_new(stream: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Encodes rows as they come and appends them to a table; what was written is not encoded again."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
