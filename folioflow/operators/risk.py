"""Risk that a field's majority answer is guessed (AGG19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.scalars import rate


def field_risk(cells: DataFrame, field: str = "field", value: str = "value_json") -> DataFrame:
    """Absence rate times majority share, by field; of answers equally frequent the smallest is the majority."""
    counts = cells.groupBy(field, value).agg(F.count(F.lit(1)).alias("n"))
    given = F.col(value).isNotNull()
    rows = counts.groupBy(field).agg(
        F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(value).alias("n_distinct_observed"),
        F.min(F.when(given, F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))).alias("top"),
    )
    rows = rows.select(field, "n_distinct_observed", "support", "null_count", F.col("top.v").alias("majority_answer"), F.coalesce(-F.col("top.k"), F.lit(0)).alias("majority_count"))
    rows = rows.withColumns({"absence_rate": rate(F.col("null_count"), F.col("null_count") + F.col("support")), "majority_share": rate("majority_count", "support")})
    return rows.withColumn("pcl_risk", F.col("absence_rate") * F.col("majority_share"))
