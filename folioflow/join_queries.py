"""Registered queries of joins by interval and by time, of window frames, sketches and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import asof, chunking, compare, intervals, summaries
from folioflow.queries import _FIXED
from folioflow.registry import query, t
from folioflow.sources.buckets import bucketed, todo_in_buckets
from folioflow.sources.scratch import scratch

_LINE_SPANS = "s AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS span FROM documents)"


def _line_spans(docs: DataFrame) -> DataFrame:
    """Every line of a document as a span of evidence in it."""
    return docs.select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("span")).where("span <> ''").distinct()


@query(_FIXED + f", {_LINE_SPANS} SELECT c.doc_id, c.chunk_id, count(*) AS spans FROM c JOIN s ON s.doc_id = c.doc_id AND s.span <> '' AND contains(substr(c.text, c.s + 1, c.e - c.s), s.span) GROUP BY 1, 2")
def doc01_by_offsets(spark, sf):
    """How many of a document's lines each chunk holds, by character intervals; the SQL looks them up in the chunks' texts."""
    docs = t(spark, sf, "documents")
    chunks = chunking.fixed_chunks(docs, target=4000, overlap=200)
    return intervals.located_by_offsets(_line_spans(docs), docs, chunks, "doc_id", width=4000).groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("spans"))


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber <> b.l_linenumber AND a.l_orderkey = b.l_orderkey AND a.l_partkey % 1000 < b.l_partkey % 1000 + b.l_quantity AND b.l_partkey % 1000 < a.l_partkey % 1000 + a.l_quantity")
def jn12_overlapping_intervals(spark, sf):
    """Pairs of lines of an order and supplier whose intervals of parts overlap."""
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 1000).cast("long").alias("low"), (F.col("l_partkey") % 1000 + F.col("l_quantity")).cast("long").alias("high"))
    other = rows.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("other"), F.col("low").alias("from"), F.col("high").alias("to"))
    pairs = intervals.overlap_join(rows, other, ["l_orderkey", "l_suppkey"], 25, ("low", "from"), ("high", "to"))
    return pairs.where("other <> l_linenumber").select("l_orderkey", "l_linenumber", "other")


@query("SELECT e.event_id, r.event_id AS last_error FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON e.user_id = r.user_id AND e.ts > r.ts")
def jn13_last_error(spark, sf):
    """Each event with its user's last earlier error."""
    events = t(spark, sf, "events")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return asof.asof_join(events.select("event_id", "user_id", "ts"), errors, "user_id", "ts").select("event_id", F.col("last.error_id").alias("last_error"))


@query(_FIXED + " SELECT doc_id, count(*) AS chunks, 0::BIGINT AS gaps, 0::BIGINT AS wrong_overlaps, min(s) = 0 AS from_start FROM c GROUP BY doc_id")
def chk04_coverage(spark, sf):
    """The chunks of a document cover it and overlap as asked."""
    return chunking.coverage(chunking.fixed_chunks(t(spark, sf, "documents"), target=4000, overlap=200), 200)


@query("SELECT event_id, count(a) OVER w AS n, CASE WHEN count(a) OVER w = 0 THEN 0 ELSE count(*) FILTER (a) OVER w::DOUBLE / count(a) OVER w END AS agreement FROM (SELECT event_id, user_id, epoch_us(ts) AS micros, CASE WHEN event_id % 7 <> 0 THEN (event_type IN ('click', 'view')) = (value < 20) END AS a FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def agg12_agreement_over_time(spark, sf):
    """How often two rules agreed on a user's events of the last day."""
    rows = t(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.expr("CASE WHEN event_id % 7 <> 0 THEN (event_type IN ('click', 'view')) = (value < 20) END").alias("agree"))
    return compare.agreement_over_time(rows, "user_id", "at", 86_400_000_000).select("event_id", "n", "agreement")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_in_bound, true AS median_in_bound FROM events GROUP BY event_type")
def agg16_merged_sketches(spark, sf):
    """Sketches of each day, stored, then merged by type of event, beside the exact figures: are their errors within the stated bounds?"""
    events = t(spark, sf, "events").select("event_type", "user_id", "event_id", F.to_date("ts").alias("day"))
    path = scratch(spark, "sketches")
    summaries.daily(events, ["event_type", "day"], "user_id", "event_id").write.parquet(path)
    guess = summaries.estimates(summaries.merged(spark.read.parquet(path), ["event_type"]), {"median": 0.5})
    exact = events.join(guess.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.avg(F.when(F.col("event_id") <= F.col("median"), 1.0).otherwise(0.0)).alias("rank"))
    off = F.abs(F.col("n_distinct") - F.col("users"))
    # A rank is in steps of one row.
    return guess.join(exact, "event_type").select("event_type", "n", "users", (off <= F.greatest(F.lit(1.0), summaries.DISTINCT_ERROR * F.col("users"))).alias("users_in_bound"), (F.abs(F.col("rank") - 0.5) <= summaries.RANK_ERROR + 1 / F.col("n")).alias("median_in_bound"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn05_in_buckets(spark, sf):
    """Documents without a label, between two tables in buckets of their key."""
    tables = _bucket_tables(spark, sf)
    return todo_in_buckets(spark, *tables, ["doc_id"]).select("doc_id")


def _bucket_tables(spark: SparkSession, sf: str) -> tuple[str, str]:
    names = []
    for name in ("documents", "labels"):
        path = scratch(spark, name)
        names.append(f"folioflow_{path.rpartition('-')[2]}")
        bucketed(t(spark, sf, name).select("doc_id"), names[-1], ["doc_id"], path)
    return names[0], names[1]
