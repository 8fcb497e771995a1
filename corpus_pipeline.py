"""The corpus pipeline: quality, near duplicates, benchmark passages, mixing, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents. No SQL expresses a learned classifier, so the whole is
tested against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import line_crf
from folioflow.llm.common import scratch
from folioflow.llm.decontaminate import decontaminate
from folioflow.llm.mixing import mixed
from folioflow.llm.parity_join import one_of_each
from folioflow.llm.token_store import read_store, write_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go. Null and empty texts are scored as one empty line; repeated rows fare alike; an empty table stays empty."""
    model = line_crf.fit(docs, _table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model, only_kept=True).select("_row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id. Texts that only share an id are not copies; rows without an id are copies like others; null and empty texts all stay. Long texts go in whole; an empty table stays empty; columns keep their names, whatever these are."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go. Null and empty texts are clean; repeated rows fare alike; an empty table stays empty."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, put in the order of the schedule: files and rows in them follow its slots. Null sources are one source; repeated rows, null ids and null texts are placed like others; an empty table stays empty."""
    return mixed(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, stored in the order in which they lie in the files, which is the mixed one. Null and empty texts have the end id alone; repeated rows are documents of their own; an empty table makes an empty store."""
    folder = scratch(spark, "store")
    write_store(docs, folder, order=[F.col("_metadata.file_name"), F.col("_metadata.row_index")])
    return read_store(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_store),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
