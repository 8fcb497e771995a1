"""Scratch folders that the driver and all executors share, and small files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, the folder all executors share.

    The setting is read from the session. Only where it is unset and the session
    is a local one does a temporary folder stand in; on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioflow/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p, store = _path(spark, path)
        store.delete(p, True)


def put(spark: SparkSession, path: str, content: str | bytes) -> str:
    """Write one small file from the driver, into whatever store the path names; gives the path."""
    p, store = _path(spark, path)
    out = store.create(p, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()
    return path


def get(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    return spark.read.text(path, wholetext=True).first()[0]
