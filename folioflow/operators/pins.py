"""Content pins and drift (SRC13, JN09, CLS06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXIT = {"match": 0, "mismatch": 1, "snapshot_drift": 1, "missing": 2, "snapshot_missing": 2}


def drift(pins: DataFrame, current: DataFrame) -> DataFrame:
    """JN09, CLS06: pinned (path, sha256, optional snapshot) against current (path, sha256).

    A file may match, differ or be missing; then its snapshot, where it has one,
    may be missing or have drifted.
    """
    now = current.select(F.col("path"), F.col("sha256").alias("now"))
    rows = pins.join(now, "path", "left")
    if "snapshot" in pins.columns:
        rows = rows.join(current.select(F.col("path").alias("snapshot"), F.col("sha256").alias("snap")), "snapshot", "left")
    else:
        rows = rows.withColumns({"snapshot": F.lit(None).cast("string"), "snap": F.lit(None).cast("string")})
    status = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("now") != F.col("sha256"), "mismatch")
        .when(F.col("snapshot").isNotNull() & F.col("snap").isNull(), "snapshot_missing")
        .when(F.col("snapshot").isNotNull() & (F.col("snap") != F.col("sha256")), "snapshot_drift")
        .otherwise("match")
    )
    return rows.select("path", "sha256", "now", status.alias("status"))


def heads(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """SRC14: recorded repositories (name, sha) beside their present heads (name, sha): ``moved``, ``unchanged`` or ``not_checked``. A warning only: what a run has read is what its pins say."""
    joined = recorded.join(now.select("name", F.col("sha").alias("now")), "name", "left")
    status = F.when(F.col("sha").isNull() | F.col("now").isNull(), "not_checked").when(F.col("sha") == F.col("now"), "unchanged").otherwise("moved")
    return joined.select("name", "sha", "now", status.alias("status"))


def exit_code(statuses: DataFrame) -> int:
    """0 if all match, 1 if something drifted, 2 if something is missing."""
    return max([EXIT[r.status] for r in statuses.select("status").distinct().collect()], default=0)
