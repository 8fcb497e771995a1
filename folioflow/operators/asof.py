"""As-of join: each row with the last earlier row of its key on another side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.scratch import scratch


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, name: str = "last", strict: bool = True) -> DataFrame:
    """``left`` with a struct ``name``: the row of ``right`` with equal key and the latest ``at`` that is earlier (or, not strict, not later), null if there is none.

    Both sides are merged into one order by key and time, dealt into ranges of
    equal size and carried forward within each; what a range takes over from those
    before is one row, so that a key with most rows spreads over ranges, and no
    pair of rows is ever made that is not in the result. Of rows on the right with
    the same time the largest counts. Rows without a key or a time have no earlier row.
    """
    spark = left.sparkSession
    others = F.struct(*[F.col(c) for c in right.columns])
    some = F.struct(*[F.col(c) for c in left.columns])
    one = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), some.alias("_left"), F.lit(None).cast(right.select(others.alias("x")).schema["x"].dataType).alias("_right"))
    two = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), others.alias("_right"))
    ordered = one.unionByName(two).repartitionByRange("_key", "_at", "_side").withColumn("_part", F.spark_partition_id())
    path = scratch(spark, "asof")
    ordered.write.parquet(path)
    merged = spark.read.schema(ordered.schema).parquet(path)  # ranges follow a sample: they are written before they are used

    # A key goes on into the next range only if it is the last of its range: of each range the first key, and the last row on the right.
    ends = merged.groupBy("_part").agg(F.min("_key").alias("first"), F.max(F.when(F.col("_right").isNotNull(), F.struct("_key", "_at", "_right"))).alias("last")).orderBy("_part").collect()
    carried, before = [], None
    for r in ends:
        if before is not None and r.first is not None and before["_key"] == r.first:
            carried.append((r["_part"], r.first, before["_right"]))
        before = r["last"] or before
    types = merged.schema
    table = spark.createDataFrame(carried, f"_part int, _key {types['_key'].dataType.simpleString()}, _over {types['_right'].dataType.simpleString()}")
    order = Window.partitionBy("_part", "_key").orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = merged.withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).where(F.col("_left").isNotNull())
    found = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_seen", "_over"))
    return filled.join(F.broadcast(table), ["_part", "_key"], "left").select("_left.*", found.alias(name))  # a row for each range at most
