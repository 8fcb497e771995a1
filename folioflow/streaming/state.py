"""Where streams keep their state."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on the executors' disks with changes logged in the checkpoint, instead of in their heaps: it grows with the keys. A provider that the session names stays."""
    if not spark.conf.get(PROVIDER, None) or spark.conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
