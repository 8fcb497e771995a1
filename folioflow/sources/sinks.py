"""Writers (SNK01 to SNK10)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.scratch import exists, put


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK01, SNK07: JSON lines, text beyond ASCII as it is, null fields written. Overwriting is the restart that drops earlier output."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


#: Folders that appended rows and chunk texts are dealt into by the hash of their key.
BUCKETS = 64


def append_missing(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """SNK02, JN05: append the rows whose keys the table does not hold yet (Parquet), one for each key; nulls are a key like others.

    The table lies in folders by the hash of the keys, and only keys of folders
    that the rows touch are read. Read it with ``appended``.
    """
    once = df.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()  # what df does may be dear
    try:
        fresh = once
        if exists(df.sparkSession, path):
            touched = [r[0] for r in once.select("_bucket").distinct().collect()]  # at most ``buckets``
            done = df.sparkSession.read.parquet(path).where(F.col("_bucket").isin(touched)).select(F.col("_bucket").alias("_b"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            same = F.col("_bucket") == F.col("_b")
            for i, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
            fresh = once.join(done, same, "left_anti")
        fresh.write.mode("append").partitionBy("_bucket").parquet(path)
    finally:
        once.unpersist()


def appended(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_missing`` has gathered."""
    return spark.read.parquet(path).drop("_bucket")


def stats_document(df: DataFrame, path: str) -> dict:
    """SNK03: a small result as one readable JSON file; gives what it wrote."""
    rows = [json.loads(r) for r in df.toJSON().collect()]
    value = rows[0] if len(rows) == 1 else rows
    put(df.sparkSession, path, json.dumps(value, ensure_ascii=False, indent=2))
    return value


def chunk_texts(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """SNK05: chunk texts as JSON lines with their names, in as many folders as asked, whatever the number of chunks; all chunks of a document are in one of them."""
    dealt = chunks.select("doc_id", "chunk_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    dealt.write.mode("overwrite").partitionBy("bucket").json(path)


def merge_outputs(merged: DataFrame, golds: DataFrame, conflicts: DataFrame, folder: str) -> None:
    """SNK06, JN04: merged records, the golds of merged documents, and the conflict log."""
    jsonl(merged, f"{folder}/predictions")
    jsonl(golds.join(merged.select("contract_name"), "contract_name", "left_semi"), f"{folder}/gold")
    jsonl(conflicts, f"{folder}/conflicts")


def sample_manifest(names: DataFrame, path: str) -> None:
    """SNK08: names, one a line, in order within the files and from file to file; none passes through the driver."""
    column = names.columns[0]
    names.select(F.col(column).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def fill_template(text: str, values: dict) -> str:
    """SNK09: ``{{key}}`` replaced by its value; unknown keys stay."""
    for k, v in values.items():
        text = text.replace("{{" + k + "}}", str(v))
    return text


def run_folder(folder: str, manifest: dict, command: str, config_template: str) -> None:
    """SNK09: a run's manifest, its command as a script, and its filled-in description."""
    os.makedirs(folder, exist_ok=False)
    with open(f"{folder}/manifest.json", "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2)
    with open(f"{folder}/run.sh", "w", encoding="utf-8") as f:
        f.write(f"#!/bin/sh\nset -eu\n{command}\n")
    with open(f"{folder}/CONFIG.md", "w", encoding="utf-8") as f:
        f.write(fill_template(config_template, manifest | {"command": command}))


def console_table(df: DataFrame, width: int = 12) -> str:
    """SNK10: a small table as text, numbers right-aligned with thousands separators."""
    cells = [F.lpad(F.format_number(F.col(c), 0 if t in ("int", "bigint") else 2), width, " ") if t in ("int", "bigint", "double") else F.rpad(F.col(c).cast("string"), width, " ") for c, t in df.dtypes]
    head = " ".join(c.rjust(width) if t in ("int", "bigint", "double") else c.ljust(width) for c, t in df.dtypes)
    return "\n".join([head, *(r[0] for r in df.select(F.concat_ws(" ", *cells)).collect())])
