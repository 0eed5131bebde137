"""Incremental forms: the growing verdict cache, and event windows (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verdict import judged


def grow_cache(targets: DataFrame, cache_path: str, client: Callable, checkpoint: str, **options):
    """Stream of targets -> cache (t, v) at cache_path, batch by batch; what is there is not asked again, so a batch that is
    run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        own = df.select(F.col("target").alias("t")).distinct()
        try:
            own = own.join(spark.read.schema("t string, v string").json(cache_path), "t", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        judged(own, client, **options).write.mode("append").json(cache_path)

    return targets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by time window and type; events later than the watermark are left out of a stream."""
    t = events.withWatermark("ts", late) if events.isStreaming else events
    return t.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    t = events.withWatermark("ts", late) if events.isStreaming else events
    return t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
