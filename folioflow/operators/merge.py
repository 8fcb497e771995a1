"""Cells of a document's chunks merged into one record (AGG01 to AGG06, AGG14, AGG15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collected(rows: DataFrame, key: str, by: str = "chunk_id") -> DataFrame:
    """AGG01: the rows of a key as one array, in order."""
    others = [c for c in rows.columns if c not in (key, by)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(by, *others))).alias("rows"))


def vote(cells: DataFrame, keys: list[str], value: str = "value_json", order: str = "chunk_id") -> DataFrame:
    """AGG03, AGG06: majority over non-null values; a shared top count gives null.

    Result: keys, ``picked``, ``mode`` (null without a conflict, else
    ``majority_vote`` or ``tie_to_null``), ``values`` (all in first-seen order, or
    only the tied ones), ``vote_distribution``, ``n_votes``. A group of nulls only
    stays, with a null pick. Two aggregations, the first partial on the map side,
    so a hot key moves one row for each of its values and tasks.
    """
    counts = cells.groupBy(*keys, value).agg(F.count(value).alias("n"), F.min(order).alias("first"))
    entry = F.struct("first", F.col(value).alias("v"), "n")
    votes = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), entry)))
    top = counts.groupBy(*keys).agg(votes.alias("votes"), F.max(F.when(F.col(value).isNotNull(), F.col("n"))).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_votes"))
    tied = F.filter("votes", lambda e: e["n"] == F.col("most"))
    rows = top.select("*", tied.alias("tied"))
    conflict = F.size("votes") > 1
    single = F.size("tied") == 1
    return rows.select(
        *keys,
        F.when(single, F.element_at("tied", 1)["v"]).alias("picked"),
        F.when(conflict, F.when(single, "majority_vote").otherwise("tie_to_null")).alias("mode"),
        F.when(conflict, F.transform(F.when(single, F.col("votes")).otherwise(F.col("tied")), lambda e: e["v"])).alias("values"),
        F.map_from_entries(F.transform("votes", lambda e: F.struct(e["v"], e["n"]))).alias("vote_distribution"),
        "n_votes",
    )


def union_labels(cells: DataFrame, keys: list[str], value: str = "value_json") -> DataFrame:
    """AGG04: distinct labels of a group's arrays (JSON text), sorted; none gives null. Values that are not arrays (FLT08) are passed over."""
    labels = F.from_json(value, "array<string>")
    exploded = cells.select(*keys, F.explode_outer(F.when(F.startswith(F.ltrim(value), F.lit("[")), labels)).alias("label"))
    merged = F.array_sort(F.collect_set("label"))
    return exploded.groupBy(*keys).agg(F.nullif(merged, F.array().cast("array<string>")).alias("labels"))


def merge_documents(cells: DataFrame, fields: DataFrame, doc: str = "contract_name") -> tuple[DataFrame, DataFrame]:
    """AGG05: (merged cells, conflict log) of chunk cells; labels of multilabel fields are united, all else is voted on."""
    multi = F.broadcast(fields.where("is_multilabel").select("field"))  # not shuffled: cells have few fields
    voted = vote(cells.join(multi, "field", "left_anti"), [doc, "field"])
    united = union_labels(cells.join(multi, "field", "left_semi"), [doc, "field"])
    merged = voted.select(doc, "field", F.col("picked").alias("value_json")).union(united.select(doc, "field", F.to_json("labels")))
    return merged, voted.where("mode IS NOT NULL").select(doc, "field", "mode", "values", "picked", "vote_distribution")


def conflict_summary(documents: DataFrame, conflicts: DataFrame, doc: str = "contract_name") -> DataFrame:
    """AGG14, AGG22: total, least, mean and most conflicts of a document; those without any count."""
    n = conflicts.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    per = documents.select(doc).distinct().join(n, doc, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("conflicts"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def conflicts_by_mode(conflicts: DataFrame) -> DataFrame:
    """AGG15."""
    return conflicts.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
