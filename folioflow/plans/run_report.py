"""From a run's files to its report in one call: merge, remap, score, overlays, analysis (SNK03, SNK04, SNK06 over JN01 to AGG08)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import cells, fields, scoring
from folioflow.plans import lifecycle, report
from folioflow.schemas import GOLD, PREDICTION
from folioflow.sources import files, sinks
from folioflow.sources.scratch import put

#: Mismatches that a report lists, and fields of highest risk that have figures of their own.
LISTED, TOP = 50, 10


def dictionary_of(spark: SparkSession, path: str) -> DataFrame:
    """A value dictionary file, {field: {canonical: modified}}, as rows."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return text.select(F.explode("m").alias("field", "values")).select("field", F.explode("values").alias("canonical", "modified"))


def report_run(spark: SparkSession, folder: str, schema: str | dict, risk: str, dictionary: str | None = None, title: str = "Run", fmt: str = "jsonl") -> dict[str, DataFrame]:
    """Merge and score the chunk predictions and golds in ``folder``, and write there what a reader wants.

    In: ``predictions.jsonl`` (contract_name, chunk_id, prediction), ``gold.jsonl``
    (contract_name, chunk_id, gold), the JSON Schema of the records, the CSV of the
    fields' risks, and the dictionary that the predictions' values were rewritten
    by, if any. Out: ``merged`` (predictions, golds of merged documents, conflicts),
    ``cells`` (every scored cell with its flags; a table that figures and
    mismatches are read from), ``analysis.json`` (figures overall, by kind, of the
    fields of highest risk and the others, of rewritten gold and the rest), and
    ``analysis.md``. Evidence spans are left out of the merge; a document without
    an answer counts as abstaining.
    """
    name = lambda x: f"{folder}/{x}.{fmt}"
    preds = files.jsonl(spark, name("predictions"), PREDICTION)
    golds = files.jsonl(spark, name("gold"), GOLD)
    dimension = fields.load_fields(spark, schema)
    words = dictionary_of(spark, dictionary) if dictionary else None
    done = lifecycle.merge_and_score(preds, golds, dimension, words)

    first = golds.groupBy("contract_name").agg(F.min_by("gold", "chunk_id").alias("gold"))
    every = preds.select("contract_name").distinct().join(done["merged"], "contract_name", "left")
    records = cells.pivot(every.where("field IS NOT NULL")).select("contract_name", "record")
    sinks.merge_outputs(records, first, done["conflicts"], f"{folder}/merged")

    top = scoring.top_risk_fields(files.with_ordinal(files.csv(spark, risk)), TOP)
    none = spark.createDataFrame([], "field string, canonical string, modified string")
    flagged = scoring.with_overlays(done["scored"], top, none if words is None else words)
    flagged.write.mode("overwrite").parquet(f"{folder}/cells")
    found = spark.read.schema(flagged.schema).parquet(f"{folder}/cells")

    stats = scoring.overlay_stats(found)
    wrong = scoring.all_mismatches(found)
    sinks.stats_document(stats, f"{folder}/analysis.json")
    listed = scoring.mismatches(found, LISTED, ("contract_name", "ordinal")).select("contract_name", "field", "outcome", "pred_json", "gold_json")
    put(spark, f"{folder}/analysis.md", report.markdown(stats, listed, wrong.count(), title))
    return {"stats": stats, "cells": found, "mismatches": wrong, "conflicts": done["conflicts"], "merged": records}


def schema_text(properties: dict) -> str:
    """A JSON Schema of an object with these properties."""
    return json.dumps({"type": "object", "properties": properties}, ensure_ascii=False)
