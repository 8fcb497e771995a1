"""Event-time windows with a watermark (sections 2.17 and 2.19).

A window is emitted once, when the watermark has passed its end, and its state is
dropped then. Rows that come after that are late: they are in no window, and are
counted as what came in and was in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.streaming.state import use_rocksdb


def tumbling(events: DataFrame, ts: str, size: str, delay: str, by: list[str], **figures: Column) -> DataFrame:
    """Figures of each window of ``size`` and group; rows up to ``delay`` behind the newest are waited for."""
    use_rocksdb(events.sparkSession)
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *figures)


def sessions(events: DataFrame, ts: str, gap: str, delay: str, by: list[str], **figures: Column) -> DataFrame:
    """Figures of each run of a group's rows that follow each other within ``gap``; a session ends ``gap`` after its last row."""
    use_rocksdb(events.sparkSession)
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *figures)


def run(windows: DataFrame, table: str, checkpoint: str) -> dict:
    """Write closed windows to a Parquet table, exactly once; gives the rows that came in, the windows in state at the end and at most, and the last watermark.

    Windows that are open at the end wait in the checkpoint for the next call. A
    heartbeat, a row of a group of its own with a later time, closes them.
    """
    query = windows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    state = [s for p in progress for s in p["stateOperators"]]
    return {
        "rows": sum(p["numInputRows"] for p in progress),
        "open": state[-1]["numRowsTotal"] if state else 0,
        "most_open": max((s["numRowsTotal"] for s in state), default=0),
        "watermark": max((p["eventTime"].get("watermark", "") for p in progress), default=""),
    }


def closed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The windows that have been emitted, as the sink's own log names them."""
    return spark.read.schema(schema).parquet(table)


def late(came_in: int, windows: DataFrame, waiting: int = 0) -> int:
    """Rows that came too late for any window: those that came in, without those in closed windows and the ``waiting`` ones in open windows."""
    return came_in - waiting - int(windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
