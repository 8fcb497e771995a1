"""Votes kept as state: an incremental merge (AGG03, AGG05 and AGG06 over section 2.17).

The state of a document's field is how often each value was given and where it
was first seen. A micro-batch adds to it and emits the fields whose outcome has
changed. Fields lie in buckets, which are read and written whole: following the
changes costs what has come in and what shares its buckets, not what there is.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from folioflow.streaming.state import use_rocksdb

BUCKETS = 16_384  # of fields that share a value of the state
PART_ROWS, PART_BYTES = 131_072, 16 << 20  # of cells that a task counts at once
OUTCOME = "picked string, mode string, values array<string>, n_votes long"


def decided(counts: dict[str, tuple[int, int]]) -> dict:
    """The outcome of a vote: value -> (votes, first place), as ``merge.vote`` gives it."""
    most = max((n for n, _ in counts.values()), default=0)
    order = sorted(counts, key=lambda v: (counts[v][1], v))
    tied = [v for v in order if counts[v][0] == most]
    alone, conflict = len(tied) == 1, len(counts) > 1
    return {
        "picked": tied[0] if alone else None,
        "mode": ("majority_vote" if alone else "tie_to_null") if conflict else None,
        "values": (order if alone else tied) if conflict else None,
        "n_votes": sum(n for n, _ in counts.values()),
    }


def partial_counts(cells: DataFrame, keys: list[str], value: str, order: str, buckets: int) -> DataFrame:
    """A row for each bucket of fields and part of a task: lists of keys, values, votes and first places. The map side of the count, so that a hot field sends an entry for each value and part; and few rows, as a stateful processor takes them cell by cell."""
    types = {f.name: f.dataType.simpleString() for f in cells.select(*keys).schema}
    schema = ", ".join([f"`{k}` array<{types[k]}>" for k in keys])

    def by_bucket(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        counts = pa.Table.from_batches(part).group_by(["_bucket", *keys, "v"], use_threads=False).aggregate([("o", "count", pc.CountOptions(mode="all")), ("o", "min")])
        counts = counts.select(["_bucket", *keys, "v", "o_count", "o_min"]).sort_by("_bucket").combine_chunks()
        bucket, *others = [c.chunk(0) for c in counts.columns]
        starts = np.flatnonzero(np.diff(bucket.to_numpy(), prepend=-1))
        ends = pa.array(np.append(starts, len(bucket)), pa.int32())
        return pa.RecordBatch.from_arrays([bucket.take(pa.array(starts)), *[pa.ListArray.from_arrays(ends, c) for c in others]], ["_bucket", *keys, "v", "n", "first"])

    def run(batches):
        part, rows, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                part.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= PART_ROWS or size >= PART_BYTES:
                yield by_bucket(part)
                part, rows, size = [], 0, 0
        if part:
            yield by_bucket(part)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    places = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))).alias("o")
    return cells.select(bucket, *keys, F.col(value).cast("string").alias("v"), places).mapInArrow(run, f"_bucket long, {schema}, v array<string>, n array<long>, first array<long>")


class VoteProcessor(StatefulProcessor):
    """A bucket of (document, field): for each of them a map of values to votes and first places, read and written at once, as a call to the state store costs far more than counting does.

    The outcome that was emitted last is that of the votes before.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        self.votes = handle.getValueState("votes", "votes binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark calls it so
        added: dict[tuple, tuple[tuple, dict[str, tuple[int, int]]]] = {}
        for r in rows:
            for given, v, n, first in zip(zip(*[r[k] for k in self.keys]), r.v, r.n, r.first):
                _, counts = added.setdefault(tuple("NaN" if k != k else k for k in given), (given, {}))  # NaN equals itself in Spark's groups
                if v is not None:
                    votes, place = counts.get(v, (0, first))
                    counts[v] = (votes + n, min(place, first))
        state = self.votes.get()
        fields: dict[tuple, dict[str, tuple[int, int]]] = pickle.loads(state[0]) if state else {}
        changed = []
        for field, (given, counts) in added.items():
            before = fields.get(field)
            after = dict(before or {})
            for v, (n, first) in counts.items():
                votes, place = after.get(v, (0, first))
                after[v] = (votes + n, min(place, first))
            fields[field] = after
            outcome, last = decided(after), None if before is None else decided(before)
            if last is None or any(outcome[k] != last[k] for k in ("picked", "mode", "values")):
                changed.append(Row(**dict(zip(self.keys, given)), **outcome))
        self.votes.update((pickle.dumps(fields),))
        yield from changed

    def close(self) -> None:
        """Nothing is held besides the state."""


def vote_changes(cells: DataFrame, keys: list[str], value: str = "value_json", order: str = "chunk_id", buckets: int = BUCKETS) -> DataFrame:
    """A stream of cells into a stream of changed outcomes: keys, ``picked``, ``mode``, ``values``, and the votes at that time. The last row of a key has the pick, mode and values that ``merge.vote`` gives over all cells so far, in whatever batches they came; more votes for the same outcome emit nothing.

    Null values have no vote, but their field has an outcome; values without a place
    count as the first seen. Write it in update mode. State is read and written by
    buckets of fields; a checkpoint holds for one number of them, which should grow
    with the fields that are expected.
    """
    use_rocksdb(cells.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema)
    return partial_counts(cells, keys, value, order, buckets).groupBy("_bucket").transformWithState(VoteProcessor(keys), f"{schema}, {OUTCOME}", "update", "none")


def follow(changes: DataFrame, table: str, checkpoint: str) -> None:
    """Append the changes of each micro-batch, with its number, under a folder of the batch's own: a batch that is replayed writes over itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/part={number}")

    changes.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The state that the changes lead to: the last row of each key."""
    rows = spark.read.parquet(table).drop("part")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])
