"""Registered queries of the streams: tables are fed as files, a part at a time, and what the stream has made in the end equals SQL over the whole."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.queries import _VOTES, _event_cells
from folioflow.registry import query, t
from folioflow.sources.scratch import scratch
from folioflow.streaming import votes, windows

_AGG03 = "SELECT d.user_id, d.field, CASE WHEN tops = 1 THEN top END AS picked, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN 'majority_vote' ELSE 'tie_to_null' END END AS mode, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN every ELSE tied END END AS values FROM (SELECT DISTINCT user_id, field FROM e) d LEFT JOIN s USING (user_id, field)"


@query(f"{_VOTES} {_AGG03}")
def agg03_streamed_vote(spark, sf):
    """Votes kept as state over three parts of the cells; the last change of each field."""
    cells, base, keys = _event_cells(spark, sf), scratch(spark, "votes"), ["user_id", "field"]
    stream = spark.readStream.schema(cells.schema).parquet(f"{base}/in/*")
    for part in range(3):
        cells.where(F.col("chunk_id") % 3 == part).write.parquet(f"{base}/in/{part}")
        votes.follow(votes.vote_changes(stream, keys), f"{base}/changes", f"{base}/checkpoint")
    return votes.latest(spark, f"{base}/changes", keys).select(*keys, "picked", "mode", F.array_join("values", "|").alias("values"))


def _windowed(spark: SparkSession, sf: str, make, stragglers: str, schema: str) -> tuple[DataFrame, int]:
    """Closed windows over the events, which come in three parts by time, then the stragglers, then a heartbeat of no user and no type; and how many events there were."""
    events, base = t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), scratch(spark, "windows")
    edges = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    third = (edges.high - edges.low) / 3
    in_time = events.where(f"NOT ({stragglers})")
    parts = [in_time.where(F.col("ts") < edges.low + third), in_time.where((F.col("ts") >= edges.low + third) & (F.col("ts") < edges.low + 2 * third)), in_time.where(F.col("ts") >= edges.low + 2 * third), events.where(stragglers)]
    parts.append(spark.createDataFrame([(None, edges.high + timedelta(days=365), None, None)], events.schema))
    stream = make(spark.readStream.schema(events.schema).parquet(f"{base}/in/*"))
    came_in = 0
    for i, part in enumerate(parts):
        part.write.parquet(f"{base}/in/{i}")
        came_in += windows.run(stream, f"{base}/out", f"{base}/checkpoint")["rows"]
    return windows.closed(spark, f"{base}/out", schema), came_in - 1


_DAYS = "WITH m AS (SELECT max(ts) FILTER (event_id % 50 <> 0) - INTERVAL 2 DAY AS w FROM events), d AS (SELECT date_trunc('day', ts) AS start, event_type, event_id, event_id % 50 <> 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > w AS in_time FROM events, m)"


def _days(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    return _windowed(spark, sf, lambda s: windows.tumbling(s, "ts", "1 day", "2 days", ["event_type"], last=F.max("event_id")), "event_id % 50 = 0", "start timestamp, end timestamp, event_type string, n long, last long")


@query(_DAYS + " SELECT start::VARCHAR AS start, event_type, count(*) AS n, max(event_id) AS last FROM d WHERE in_time GROUP BY 1, 2")
def st01_tumbling_windows(spark, sf):
    """Days by type of event. Every fiftieth event comes after all others; those whose day is closed by then are in none."""
    found, _ = _days(spark, sf)
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "last")


@query(_DAYS + " SELECT count(*) AS events, count(*) FILTER (in_time) AS in_windows, count(*) FILTER (NOT in_time) AS late FROM d")
def st02_late_rows(spark, sf):
    found, came_in = _days(spark, sf)
    late = windows.late(came_in, found)
    return spark.createDataFrame([(came_in, came_in - late, late)], "events long, in_windows long, late long")


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS n, max(event_id) AS last FROM s GROUP BY user_id, k")
def st03_sessions(spark, sf):
    """Each user's runs of events that follow each other within eight hours."""
    make = lambda s: windows.sessions(s, "ts", "8 hours", "1 day", ["user_id"], last=F.max("event_id"))
    found, _ = _windowed(spark, sf, make, "false", "start timestamp, end timestamp, user_id long, n long, last long")
    return found.select("user_id", F.unix_micros("start").alias("began"), F.unix_micros(F.col("end") - F.expr("INTERVAL 8 HOURS")).alias("ended"), "n", "last")
