"""Tables in buckets of a key: resuming without a shuffle (JN05, SNK02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table; both sides of a resume join have as many.
BUCKETS = 16


def bucketed(df: DataFrame, table: str, keys: list[str], path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as a table of the session's catalog in buckets of its keys, each sorted by them."""
    few = df.repartition(buckets, *keys)  # a file a bucket, not one for each task and bucket
    few.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def todo_in_buckets(spark: SparkSession, rows: str, done: str, keys: list[str]) -> DataFrame:
    """JN05 between two tables in equal buckets: rows whose keys are not done yet. Each task reads one bucket of either table; neither side is shuffled or broadcast."""
    left, right = spark.table(rows), spark.table(done).select(*keys)
    return left.hint("merge").join(right.hint("merge"), keys, "left_anti")
