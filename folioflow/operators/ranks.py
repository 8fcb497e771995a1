"""Places in a global order, without a task or a driver that sees all rows (SRT01, SMP01, SMP02)."""

from __future__ import annotations

import random
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.scratch import scratch

#: Places whose splits lie in one row of the table of splits.
BLOCK = 1 << 16


def global_ranks(rows: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """``rows`` with each one's place, from 0, in the order of ``by``: ranges are sorted each on its own, and a place is that in the range and the sizes of the ranges before.

    Ranges follow a sample, so that they are written before they are counted;
    what the driver sees is a number for each range. Rows that are equal in
    ``by`` get places in some order. Text is in code-point order, nulls come first.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "ranges")
    ordered.write.parquet(path)
    written = spark.read.schema(ordered.schema).parquet(path)
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((int(r.p), before))
        before += r.n
    first = F.broadcast(spark.createDataFrame(starts, "_p long, _first long"))  # a row for each range
    return written.join(first, part == F.col("_p")).withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_first")


def drawn(n: int, k: int, seed: int) -> list[int]:
    """The places that a seeded generator samples out of n; they depend on n alone."""
    return random.Random(seed).sample(range(n), min(k, n))


def split_codes(n: int, seed: int, train: float, val: float) -> bytearray:
    """For each of n places 0 (train), 1 (val) or 2 (test) by a seeded shuffle of the places: 9 bytes a place on the driver while it runs."""
    order = array("q", range(n))
    random.Random(seed).shuffle(order)
    a, b = int(n * train), int(n * train) + int(n * val)
    codes = bytearray(b"2" * n)
    for i, place in enumerate(order):
        if i < b:
            codes[place] = 48 if i < a else 49
    return codes


def splits(spark, n: int, seed: int, train: float, val: float) -> DataFrame:
    """``block`` and ``codes``, a character for each place in the block."""
    codes = split_codes(n, seed, train, val)
    return spark.createDataFrame([(i // BLOCK, codes[i : i + BLOCK].decode()) for i in range(0, n, BLOCK)], "block long, codes string")
