"""Summaries that merge: sketches of a day are stored, and merged later without its rows (AGG13, AGG16, SRT07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the registers' number of a distinct count, and k of a quantile sketch.
LG_K, KLL_K = 14, 400
#: Bounds of the errors that are stated: three standard deviations of a distinct count (1.04 / sqrt(2**LG_K) each), and the rank error of a quantile with 99 % confidence.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0085


def daily(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """A sketch of the distinct values of one column and one of the quantiles of another, for each group; nulls are in neither."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), KLL_K).alias("quantile_sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of finer groups merged into coarser ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch"), F.sum("n").alias("n"))


def estimates(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The figures of sketches: ``n_distinct`` and a quantile for each share."""
    keep = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(*keep, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *[F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(p)).alias(name) for name, p in shares.items()])
