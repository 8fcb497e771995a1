"""Two runs against each other (JN03, SET01, AGG09 to AGG12, SRT03, SRT04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.scalars import rate
from folioflow.operators.scoring import blind_outcome

CORRECT = ("correct_value", "correct_abstain")


def paired_cells(run1: DataFrame, run2: DataFrame, gold: DataFrame, doc: str = "contract_name") -> DataFrame:
    """JN03: cells that both runs and the gold have, with the outcome of each run. One partitioning by (document, field) serves both joins."""
    keys = [doc, "field"]
    cells = run1.select(*keys, F.col("value_json").alias("p1")).join(run2.select(*keys, F.col("value_json").alias("p2")), keys).join(gold.select(*keys, F.col("value_json").alias("g")), keys)
    return cells.withColumns({"o1": blind_outcome("p1", "g"), "o2": blind_outcome("p2", "g")})


def confusion(cells: DataFrame) -> DataFrame:
    """AGG09."""
    return cells.groupBy("o1", "o2").agg(F.count(F.lit(1)).alias("n"))


def outcome_flips(cells: DataFrame) -> DataFrame:
    """SRT04: changes of outcome, most frequent first."""
    return confusion(cells).where("o1 <> o2").orderBy(F.desc("n"), "o1", "o2")


def flips_by_field(cells: DataFrame) -> DataFrame:
    """AGG10: cells of each field on which the runs differ in value."""
    return cells.groupBy("field").agg(F.count_if(~F.col("p1").eqNullSafe(F.col("p2"))).alias("flips"), F.count(F.lit(1)).alias("n"))


def most_volatile(cells: DataFrame, n: int = 10) -> DataFrame:
    """SRT03."""
    return flips_by_field(cells).where("flips > 0").orderBy(F.desc("flips"), "field").limit(n)


def examples(cells: DataFrame, per_field: int = 3, order: str = "contract_name") -> DataFrame:
    """AGG11: the first differing cells of each field. The rank filter becomes a partial top-k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy(order))
    return cells.where(~F.col("p1").eqNullSafe(F.col("p2"))).withColumn("rank", rank).where(F.col("rank") <= per_field)


def agreement(cells: DataFrame) -> DataFrame:
    """AGG12: agreement of values and outcomes, correct cells of each run, their distance (the noise floor), over all cells."""
    n = F.count(F.lit(1))
    c1, c2 = F.count_if(F.col("o1").isin(*CORRECT)), F.count_if(F.col("o2").isin(*CORRECT))
    same, alike = F.count_if(F.col("p1").eqNullSafe(F.col("p2"))), F.count_if(F.col("o1") == F.col("o2"))
    return cells.agg(n.alias("n"), same.alias("same_value"), alias_rate(same, n, "value_agreement"), alias_rate(alike, n, "outcome_agreement"), c1.alias("correct1"), c2.alias("correct2"), F.abs(c1 - c2).alias("delta"), alias_rate(F.abs(c1 - c2), n, "noise_floor"))


def alias_rate(part, whole, name: str):
    return rate(part, whole).alias(name)


def agreement_over_time(rows: DataFrame, key: str, at: str, span: int, agree: str = "agree") -> DataFrame:
    """Each row with the rows of its key in the ``span`` before its time (whole numbers, its own time in it) and the share of them that agree: a RANGE frame, so rows of one time share a figure. Null agreement does not count."""
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(-span, Window.currentRow)
    return rows.withColumns({"n": F.count(agree).over(frame), "agreement": rate(F.count_if(F.col(agree)).over(frame), F.count(agree).over(frame))})
