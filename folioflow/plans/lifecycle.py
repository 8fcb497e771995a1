"""The three flows of the engine as lazy plans: corpus build, extraction with resume, merge and score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import cells, chunking, corpus, extract, fields, merge, scoring
from folioflow.sources import records


def build_corpus(hygiene: DataFrame, targets: DataFrame, texts: DataFrame, target: int = chunking.TARGET, backoff: int = chunking.BACKOFF, overlap: int = chunking.OVERLAP, key: str = "contract_name") -> DataFrame:
    """Usable documents with target and text -> chunk rows with their split; all chunks of a document share it. ``texts``: (key, text)."""
    whole, _ = corpus.assemble(corpus.usable(hygiene).select(key), targets.select(key), texts, key)
    chunks = chunking.chunk(whole.select(key, "text"), key, "text", target, backoff, overlap)
    return corpus.hash_split(chunking.corpus_rows(chunks, targets, hygiene, key), key)


def extract_missing(chunks: DataFrame, done: DataFrame, make_client: Callable, system: str) -> DataFrame:
    """Chunks without an answer yet, through the client."""
    return extract.extract(corpus.todo(chunks, done.where("prediction IS NOT NULL"), ["contract_name", "chunk_id"]), make_client, system)


def resumed_extraction(chunks: DataFrame, path: str, make_client: Callable, system: str, pause: float = 2.0) -> DataFrame:
    """The answers to all chunks (contract_name, chunk_id, input) in the record log at ``path``, after asking for those it lacks.

    Each answer is durable when the client has given it. What a failed run has
    left is taken in first; chunks that only failed are asked for again, and
    their failures stay in the log beside the answer.
    """
    spark, keys = chunks.sparkSession, ["contract_name", "chunk_id"]
    records.recover(spark, path, extract.SCHEMA, keys, "prediction IS NOT NULL")
    answered = records.read_records(spark, path, extract.SCHEMA).where("prediction IS NOT NULL")
    left = corpus.todo(chunks.select("contract_name", F.col("chunk_id").cast("int").alias("chunk_id"), "input"), answered, keys)
    records.append_records(left, path, keys, extract.recorded(make_client, system, pause))
    return records.read_records(spark, path, extract.SCHEMA).where("prediction IS NOT NULL")


def merge_and_score(predictions: DataFrame, golds: DataFrame, dimension: DataFrame, dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chunk predictions and golds (JSON text) -> merged cells, conflicts, scored cells.

    A dictionary, if given, maps modified values back before the vote, so that
    two spellings of one answer do not compete.
    """
    found = cells.observed(predictions, "prediction", ["contract_name", "chunk_id"])
    if dictionary is not None:
        found = fields.remap_json(found, dictionary)
    merged, conflicts = merge.merge_documents(found, dimension)
    ordinal = golds.withColumn("ordinal", F.col("chunk_id"))
    first = ordinal.groupBy("contract_name").agg(F.min_by("gold", "ordinal").alias("gold"))
    gold = cells.over_schema(first, dimension, "gold", ["contract_name"])
    # A document that answered nothing still counts: its cells are abstentions.
    names = [r.field for r in dimension.select("field").collect()]  # the schema's fields: exploded inside the row, not joined
    every = predictions.select("contract_name").distinct().select("contract_name", F.explode(F.array(*map(F.lit, names))).alias("field"))
    preds = every.join(merged, ["contract_name", "field"], "left")
    return {"merged": merged, "conflicts": conflicts, "scored": scoring.score_cells(preds, gold, dimension)}
