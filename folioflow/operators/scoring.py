"""Predictions against gold (CLS01, CLS05, AGG07, AGG08, JN02, JN07, FLT05 to FLT07, FLT10, SRT02, SRT05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.scalars import multiset_equal, rate, set_equal

OUTCOMES = ("correct_value", "wrong_value", "hallucination", "over_abstain", "correct_abstain")
SCORED = ("single_choice", "multilabel")


def outcome(pred: Column, gold: Column, equal: Column) -> Column:
    """The five classes; the order of the tests matters."""
    return (
        F.when(pred.isNull() & gold.isNull(), "correct_abstain")
        .when(gold.isNull(), "hallucination")
        .when(pred.isNull(), "over_abstain")
        .when(equal, "correct_value")
        .otherwise("wrong_value")
    )


def _lists(pred: str, gold: str) -> tuple[Column, Column, Column]:
    both = F.startswith(F.ltrim(pred), F.lit("[")) & F.startswith(F.ltrim(gold), F.lit("["))
    return both, F.from_json(pred, "array<string>"), F.from_json(gold, "array<string>")


def cell_outcome(kind: str = "kind", pred: str = "pred_json", gold: str = "gold_json") -> Column:
    """CLS01: by kind; multilabel values are equal as sets, a list against another shape is wrong."""
    both, p, g = _lists(pred, gold)
    equal = F.when(F.col(kind) == "multilabel", both & F.coalesce(set_equal(p, g), F.lit(False))).otherwise(F.col(pred) == F.col(gold))
    return outcome(F.col(pred), F.col(gold), equal)


def blind_outcome(pred: str = "pred_json", gold: str = "gold_json") -> Column:
    """CLS02: whatever the kind; lists are equal as sorted lists, so duplicates count."""
    both, p, g = _lists(pred, gold)
    return outcome(F.col(pred), F.col(gold), F.when(both, F.coalesce(multiset_equal(p, g), F.lit(False))).otherwise(F.col(pred) == F.col(gold)))


def score_cells(preds: DataFrame, golds: DataFrame, fields: DataFrame, *keys: str) -> DataFrame:
    """JN02, FLT05: cells of the records that both sides have, of scored kinds, with their outcome. Keys: the document, or document and chunk (DOC02)."""
    on = [*(keys or ("contract_name",)), "field"]
    kinds = fields.where(F.col("kind").isin(*SCORED)).select("field", "kind", "ordinal")
    pairs = preds.withColumnRenamed("value_json", "pred_json").join(golds.select(*on, F.col("value_json").alias("gold_json")), on)
    return pairs.join(F.broadcast(kinds), "field").withColumn("outcome", cell_outcome())


def outcome_counts() -> list[Column]:
    """AGG07: cells, the five outcomes, correct ones and their rate, as aggregates."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    correct = F.count_if(F.col("outcome").isin("correct_value", "correct_abstain"))
    return [F.count(F.lit(1)).alias("n"), *counts, correct.alias("correct"), rate(correct, F.count(F.lit(1))).alias("accuracy")]


def subset_stats(cells: DataFrame, *by: str) -> DataFrame:
    """AGG07."""
    return cells.groupBy(*by).agg(*outcome_counts()) if by else cells.agg(*outcome_counts())


def overlay_stats(cells: DataFrame) -> DataFrame:
    """AGG08: overall, by kind, top-risk fields or not, substituted gold or not, in one pass of grouping sets.

    Cells have ``is_top`` and ``is_substituted``; the latter is null for fields
    without substituted values, which its two groups leave out.
    """
    sets = cells.groupingSets([[], [F.col("kind")], [F.col("is_top")], [F.col("is_substituted")]], "kind", "is_top", "is_substituted")
    rows = sets.agg(F.grouping_id().alias("g"), *outcome_counts())
    overlay = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "kind").when(F.col("g") == 5, "top_risk").otherwise("substituted")
    group = F.coalesce(F.col("kind"), F.col("is_top").cast("string"), F.col("is_substituted").cast("string"))
    return rows.select(overlay.alias("overlay"), group.alias("group"), "n", *OUTCOMES, "correct", "accuracy").where("overlay <> 'substituted' OR `group` IS NOT NULL")


def few_valued(risk: DataFrame, most: int = 5) -> DataFrame:
    """FLT06: fields of few values that have a risk; unparseable rows are passed over."""
    return risk.where(F.expr(f"try_cast(cardinality AS INT) <= {most} AND try_cast(pcl_risk AS DOUBLE) IS NOT NULL"))


def top_risk_fields(risk: DataFrame, n: int = 10, most: int = 5, ordinal: str = "ordinal") -> DataFrame:
    """SRT02: fields of highest risk among those of few values; ties keep file order."""
    return few_valued(risk, most).orderBy(F.expr("try_cast(pcl_risk AS DOUBLE)").desc(), ordinal).limit(n).select("field")


def with_overlays(cells: DataFrame, top: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN07, CLS05, FLT10: flags for the fields in the top list and for gold values that a dictionary rewrites."""
    flagged = cells.join(F.broadcast(top.select("field", F.lit(True).alias("_top"))), "field", "left")  # not shuffled: cells have few fields
    affected = dictionary.groupBy("field").agg(F.collect_set("canonical").alias("_affected"))
    flagged = flagged.join(F.broadcast(affected), "field", "left")
    labels = F.coalesce(F.when(F.startswith("gold_json", F.lit("[")), F.from_json("gold_json", "array<string>")), F.array(F.get_json_object(F.concat(F.lit('{"v":'), F.coalesce("gold_json", F.lit("null")), F.lit("}")), "$.v")))
    hit = F.when(F.col("_affected").isNotNull(), F.coalesce(F.exists(labels, lambda v: F.array_contains("_affected", v)), F.lit(False)))
    return flagged.select(*cells.columns, F.coalesce("_top", F.lit(False)).alias("is_top"), hit.alias("is_substituted"))


def all_mismatches(cells: DataFrame) -> DataFrame:
    """FLT07: the cells that are not correct."""
    return cells.where(~F.col("outcome").isin("correct_value", "correct_abstain"))


def mismatches(cells: DataFrame, n: int = 50, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """SRT05: the first cells that are not correct, in record and schema order."""
    return all_mismatches(cells).orderBy(*order).limit(n)
