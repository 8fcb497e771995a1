"""Scans of JSON, text, CSV and binary files (SRC01 to SRC15)."""

from __future__ import annotations

import hashlib
import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.schemas import RISK, RUN_LOG
from folioflow.sources.scratch import exists

#: Bytes of a file up to which it is hashed as one value, and of a block of a larger one.
WHOLE, BLOCK = 1 << 30, 1 << 20


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC01: strict JSON lines; blank lines are skipped, a bad line raises when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A column that rises in file order: files by path, their rows as they stand. Give it right after a scan of files, before any shuffle.

    Spark reads large files first, so row numbers alone do not follow the files.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(place.alias(name), "*")


def last_per_key(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """SRC02, SRC11: of rows with equal keys the last in file order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def first_per_key(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """AGG02: of rows with equal keys the first in file order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(ordinal)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def keyed_or_first(lines: DataFrame, key: str = "contract_name", record: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """SRC03: JSON lines (text) by their value of ``key`` or, where that is missing or holds nothing (null, an empty text, list or object, 0, false), by the value of their first key, be it null; the last line of a name wins. Blank lines are skipped."""
    parsed = F.parse_json(F.nullif(F.trim(record), F.lit("")))
    value = lambda path: F.try_variant_get("_v", path, "string")
    at_key = F.try_variant_get("_v", f"$['{key}']", "variant")
    holds = ~F.coalesce(F.to_json(at_key), F.lit("null")).isin("null", '""', "0", "0.0", "false", "[]", "{}")
    first = F.try_variant_get(F.col("_v"), F.concat(F.lit("$['"), F.get(F.json_object_keys(record), F.lit(0)), F.lit("']")), "string")
    rows = lines.withColumn("_v", parsed).where("_v IS NOT NULL").select(F.when(holds, value(f"$['{key}']")).otherwise(first).alias("name"), F.col(record).alias("record"), ordinal)
    return last_per_key(rows, "name", ordinal)


def done_keys(spark: SparkSession, path: str, key: str = "contract_name") -> DataFrame:
    """SRC04: distinct keys of JSON lines whose tail may be torn; unparseable lines and empty keys are left out, a missing file is empty."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([schema[key]]))
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record IS NULL AND coalesce(r.`" + key + "`, '') <> ''").select(f"r.{key}").distinct()


def run_log(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """SRC05: a log that is one JSON array. Missing gives no rows; corrupt gives none either if tolerant, else it raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], RUN_LOG)
    parsed = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in RUN_LOG.split(', '))}>>", {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})
    return spark.read.text(path, wholetext=True).select(F.inline(parsed))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC06: one JSON document a file, with its stem as ``name``. Join it from the left: a missing file is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(stem(F.col("_metadata.file_name")).alias("name"), "*")


def stem(file_name):
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC07: whole text files as (name, text); any line end counts as one newline, as character offsets need it."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(stem(F.col("_metadata.file_name")).alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def texts_dropping_bad_bytes(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: as ``texts``, with bytes that are not UTF-8 left out rather than replaced. Bytes stand as Latin-1 characters while what is no UTF-8 sequence goes."""
    kept = F.regexp_replace(F.decode("content", "ISO-8859-1"), f"((?:{_UTF8})++)|[\\x{{80}}-\\x{{FF}}]", "$1")
    whole = F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8")
    return spark.read.format("binaryFile").load(path).select(stem(F.element_at(F.split("path", "/"), -1)).alias("name"), F.regexp_replace(whole, "\r\n?", "\n").alias("text"))


# The sequences of UTF-8, as Latin-1 characters.
_TAIL = "[\\x{80}-\\x{BF}]"
_UTF8 = f"[\\x{{00}}-\\x{{7F}}]|[\\x{{C2}}-\\x{{DF}}]{_TAIL}|\\x{{E0}}[\\x{{A0}}-\\x{{BF}}]{_TAIL}|[\\x{{E1}}-\\x{{EC}}\\x{{EE}}\\x{{EF}}]{_TAIL}{{2}}|\\x{{ED}}[\\x{{80}}-\\x{{9F}}]{_TAIL}|\\x{{F0}}[\\x{{90}}-\\x{{BF}}]{_TAIL}{{2}}|[\\x{{F1}}-\\x{{F3}}]{_TAIL}{{3}}|\\x{{F4}}[\\x{{80}}-\\x{{8F}}]{_TAIL}{{2}}"


def listing(spark: SparkSession, folder: str, glob: str = "contract_*.json", but: str = ".pcl.json") -> DataFrame:
    """SRC09, SRT01: names (stems) of the files that match, without those that end in ``but``, in code-point order. File contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return rows.where(~F.endswith("file", F.lit(but))).select(stem(F.col("file")).alias("name")).orderBy("name")


def csv(spark: SparkSession, path: str, schema: T.StructType | str = RISK) -> DataFrame:
    """SRC10: CSV with a header and doubled quotes. Nothing but an empty field is null: ``None`` is a string."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: path, bytes and sha256 of files. Files beyond ``WHOLE`` bytes are read in blocks, one task each, from stores that pyarrow knows."""
    found = spark.read.format("binaryFile").load(path)
    small = found.where(F.col("length") <= WHOLE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > WHOLE).select("path", F.col("length").alias("bytes"))
    if large.limit(1).count() == 0:
        return small

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([block_sha256(x) for x in b.column(0).to_pylist()], pa.string())], names=["path", "bytes", "sha256"])

    return small.union(large.repartition("path").mapInArrow(digest, "path string, bytes long, sha256 string"))


def block_sha256(uri: str) -> str:
    """sha256 of one file, a block at a time."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    found = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            found.update(block)
    return found.hexdigest()


def git_state(folder: str) -> dict:
    """SRC14: commit, branch, uncommitted changes, and distance from the upstream branch. Driver side; a folder without git gives nulls."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    counts = git("rev-list", "--left-right", "--count", "@{upstream}...HEAD")
    behind, ahead = map(int, counts.split()) if counts else (None, None)
    changes = git("status", "--porcelain")
    return {"sha": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if changes is None else bool(changes), "upstream": git("rev-parse", "--abbrev-ref", "@{upstream}"), "ahead": ahead, "behind": behind, "pushed": None if ahead is None else ahead == 0}


def local(uri: str) -> str:
    """The path of a ``file:`` address, for what is read and written on the driver only."""
    return re.sub("^file:/+", "/", uri)


def prompt_text(inline: str | None = None, path: str | None = None) -> str | None:
    """SRC15: a prompt given as text or as a file, not both."""
    if inline is not None and path is not None:
        raise ValueError("give the prompt as text or as a file, not both")
    if path is None:
        return inline
    with open(path, encoding="utf-8") as f:
        return f.read()


