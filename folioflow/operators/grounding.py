"""Evidence and answers against chunk texts (JN11, DOC01 to DOC06, AGG20, AGG21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.scalars import order_statistics, rate, split_evidence


def spans_of(evidence: DataFrame, keys: list[str], text: str = "evidence") -> DataFrame:
    """Evidence texts as spans, pieces glued by ``<omitted>`` apart."""
    return evidence.select(*keys, F.explode(split_evidence(text)).alias("span"))


def located(spans: DataFrame, chunks: DataFrame, doc: str = "contract_name") -> DataFrame:
    """JN11: spans with the chunks of the same document that hold them verbatim. An equi-join on the document first; containment is tested inside it."""
    return spans.join(chunks.select(doc, "chunk_id", "text"), doc).where(F.contains("text", F.col("span"))).drop("text")


def grounding_rate(spans: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """DOC04: spans that stand verbatim in their own chunk, and all."""
    own = spans.join(chunks.select(*keys, "text"), keys)
    hit = F.count_if(F.contains("text", F.col("span")))
    return own.agg(F.count(F.lit(1)).alias("spans"), hit.alias("verbatim"), rate(hit, F.count(F.lit(1))).alias("grounding_rate"))


def localized_gold(gold: DataFrame, chunks: DataFrame, evidence: DataFrame, doc: str = "contract_name") -> DataFrame:
    """DOC01: gold by chunk: a value only where some evidence span of the field lies in the chunk, else null."""
    hits = located(evidence, chunks, doc).select(doc, "field", "chunk_id").distinct().withColumn("hit", F.lit(True))
    every = chunks.select(doc, "chunk_id").join(gold.select(doc, "field", "value_json"), doc)
    return every.join(hits, [doc, "chunk_id", "field"], "left").select(doc, "chunk_id", "field", F.when(F.col("hit"), F.col("value_json")).alias("value_json"))


def fabrication(commits: DataFrame, local: DataFrame, evidence: DataFrame, doc: str = "contract_name") -> DataFrame:
    """DOC02, DOC03: commits (non-null chunk answers) on chunks that cannot see the evidence, over all commits; and how many fields have located evidence."""
    keys = [doc, "chunk_id", "field"]
    joined = commits.where("value_json IS NOT NULL").join(local.select(*keys, F.col("value_json").alias("gold")), keys, "left")
    blind = F.count_if(F.col("gold").isNull())
    one = F.lit(0).alias("_all")
    found = local.where("value_json IS NOT NULL").select(doc, "field").distinct().agg(one, F.count(F.lit(1)).alias("located"))
    asked = evidence.select(doc, "field").distinct().agg(one, F.count(F.lit(1)).alias("with_evidence"))
    counts = joined.agg(one, F.count(F.lit(1)).alias("commits"), blind.alias("fabricated"), rate(blind, F.count(F.lit(1))).alias("fabrication_rate"))
    return counts.join(found, "_all").join(asked, "_all").withColumn("coverage", rate("located", "with_evidence")).drop("_all")


def invariant_violations(cells: DataFrame) -> DataFrame:
    """DOC05: cells (``value_json``, ``evidence_json``) where exactly one of answer and evidence is null."""
    return cells.where(F.col("value_json").isNull() != F.col("evidence_json").isNull())


def anchorless(cells: DataFrame, chunks: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """DOC06: answers on chunks that lack the field's key phrase (lower case)."""
    rows = cells.where("value_json IS NOT NULL").join(anchors, "field").join(chunks.select(*keys, "text"), keys)
    return rows.where(~F.contains(F.lower("text"), F.col("phrase"))).drop("text")


def fill_distribution(cells: DataFrame, keys: list[str], many: int = 50) -> DataFrame:
    """AGG20: median (upper), mean and most non-null fields of a chunk, and chunks with more than ``many``."""
    per = cells.groupBy(*keys).agg(F.count("value_json").alias("n"))
    one = F.lit(0).alias("_all")  # one group of all chunks, which is there without any chunk too
    sums = per.agg(one, F.avg("n").alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") > many).alias("full_chunks"), F.count(F.lit(1)).alias("chunks"))
    return sums.join(order_statistics(per.select("n", one), ["_all"], "n", {"median": 0.5}), "_all", "left").select("median", "mean", "most", "full_chunks", "chunks")


def contradictions(cells: DataFrame, doc: str = "contract_name") -> DataFrame:
    """AGG21: fields of each document with more than one distinct answer over its chunks. Distinct pairs first: counting them skews less than a distinct count."""
    distinct = cells.where("value_json IS NOT NULL").select(doc, "field", "value_json").distinct()
    per = distinct.groupBy(doc, "field").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(doc).agg(F.count_if(F.col("k") > 1).alias("contradictory"), F.count(F.lit(1)).alias("fields"))
