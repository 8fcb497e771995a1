"""Mixing sources to target weights by Pfair scheduling (operator 9).

The documents of a source, in the order of a hash of their ids, are cut into
blocks of about ``block`` characters. A source of weight w is a periodic task:
its block j is released at slot floor(j / w) and due by slot ceil((j + 1) / w).
Earliest deadline first gives every slot to one released block; on one line of
slots that meets all deadlines, so that after any t slots a source has had more
than t w - 1 and less than t w + 1 blocks.

Weights are exact ratios: the given numbers over their sum, never rounded to
slots. The driver runs the schedule over all blocks there are, and each document
finds the slot of its block in it. A block is as large as it takes for at most
``MOST_BLOCKS`` of them, so that the schedule fits the driver at every size of
corpus. Every document is placed once. A source that has run out has no more
blocks: its slots go to blocks that are released, or stay empty. Sources of weight
0 have no share of those slots and follow after the last one.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import append_columns, partitions, quoted, staged, with_rows

#: Characters of a block, about, and blocks of a schedule besides one for each source, at most: 8 bytes each on the driver and in each worker.
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 20


def exact_weights(weights: dict) -> dict:
    """The weights as whole numbers in exactly the proportion of the given ones."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * scale) for k, w in exact.items()}
    part = math.gcd(*whole.values()) or 1
    return {k: n // part for k, n in whole.items()}


def window(j: int, n: int, total: int) -> tuple[int, int]:
    """Release floor(j / w) and deadline ceil((j + 1) / w) of block j of a source with w = n / total."""
    return j * total // n, -(-(j + 1) * total // n)


def layout(weights: dict, blocks: dict | None = None) -> dict:
    """The slots that each source's blocks get by earliest deadline first, for whole weights; one period, a block for each unit of weight, if no ``blocks`` are given."""
    total = sum(weights.values())
    blocks = weights if blocks is None else blocks
    names = sorted(weights, key=str)
    out: dict = {k: array("q") for k in names}
    waiting = [(0, i) for i, k in enumerate(names) if blocks.get(k, 0) > 0]  # (release, source): the next block of each
    ready: list = []
    heapq.heapify(waiting)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])  # nothing is released: slots stay empty
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(len(out[names[i]]), weights[names[i]], total)[1], i))
        deadline, i = heapq.heappop(ready)
        assert slot < deadline, "a block missed its deadline"
        if deadline >= 1 << 63:
            raise ValueError(f"the weight of source {names[i]!r} is too small: its deadlines go beyond 64 bits")
        out[names[i]].append(slot)
        if (j := len(out[names[i]])) < blocks[names[i]]:
            heapq.heappush(waiting, (window(j, weights[names[i]], total)[0], i))
        slot += 1
    return out


def schedule(weights: dict, blocks: dict) -> dict:
    """For each source its first slot, whole weight, the whole weights' sum and its blocks' slots. Sources of weight 0 share the slots after all others equally."""
    out: dict = {}
    start = 0
    for tier in ({k: w for k, w in weights.items() if w > 0}, {k: 1 for k, w in weights.items() if w == 0}):
        if tier:
            whole = exact_weights(tier)
            total = sum(whole.values())
            slots = layout(whole, blocks)
            out |= {k: (start, whole[k], total, array("q", (start + x for x in slots[k]))) for k in tier}
            start += max((x[-1] + 1 for x in slots.values() if x), default=0)
    return out


def scheduled(docs: DataFrame, source: str, text: str, named: list[str], most: int | None) -> tuple[Column, dict]:
    """The source that a document is scheduled under, and the characters (and one for each document) of each, over all documents.

    A source is scheduled as itself, a null one too, however many there are. Only
    a caller who gives ``most`` has those not ``named`` scheduled in so many pools
    by their hash where there are more.
    """
    own = F.col(quoted(source)).cast("string")
    size = docs.groupBy(own.alias("s")).agg(F.sum(F.coalesce(F.length(quoted(text)), F.lit(0)) + 1).alias("n"))
    rows = (size if most is None else size.limit(most + 1)).collect()
    if most is None or len(rows) <= most:
        return own, {r.s: r.n for r in rows}

    def pooled(x: Column) -> Column:
        kept = x.isNull() | x.isin(named) if named else x.isNull()
        return F.when(kept, x).otherwise(F.concat(F.lit("pool "), F.pmod(F.xxhash64(x), F.lit(most)).cast("string")))

    return pooled(own), {r.s: r.n for r in size.groupBy(pooled(F.col("s")).alias("s")).agg(F.sum("n").alias("n")).collect()}


def source_weights(docs: DataFrame, source: str = "source", text: str = "text", temper: float = 0.5, most: int | None = None) -> dict:
    """Weights that flatten the sources' sizes: characters to the power ``temper``, over all documents. A null source is one of its own."""
    return {s: float(n) ** temper for s, n in scheduled(docs, source, text, [], most)[1].items()}


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, carry: list[str] | None = None, temper: float = 0.5, most: int | None = None) -> DataFrame:
    """``_row`` with ``block`` (of its source), ``slot``, ``release``, ``deadline`` and ``place`` (rank within source) of every document.

    Without weights a source's is its characters to the power ``temper``. Sources
    without a given weight get the smallest given one above 0. Sources of weight 0
    come after all others. Null sources are one source; null ids come first among
    equal hashes; repeated rows stay repeated, each with a place of its own; null
    texts count as empty, long ones whole; an empty table gives an empty result.
    Sources are scheduled each on its own unless ``most`` is given (see ``scheduled``):
    the driver and each worker hold their figures, a row for each distinct source.
    Columns named like the results stay apart, inside ``_row``. Order by ``slot,
    place`` for the mixed order.

    Places and offsets within a source are prefix sums in two levels: running
    sums in range partitions of (source, hash), and sums over partitions, of
    which there are few rows. A source with a third of all rows spreads over a
    third of the partitions, also where all of its rows are alike.
    """
    spark = docs.sparkSession
    under, size_of = scheduled(docs, source, text, [k for k in weights or () if k is not None], most)
    block = max(block, -(-sum(size_of.values()) // MOST_BLOCKS))
    given = dict(weights or {s: float(n) ** temper for s, n in size_of.items()})
    if bad := [k for k, v in given.items() if not (v >= 0 and math.isfinite(v))]:
        raise ValueError(f"weights must be finite and not negative: {bad[:5]}")
    least = min((v for v in given.values() if v > 0), default=1.0)
    # All weights hold their share, present or not: targets do not depend on what a corpus happens to lack.
    wanted = given | {k: least for k in size_of if k not in given}

    names = docs.columns if carry is None else carry
    row = F.struct(*[docs[quoted(c)].alias(c) for c in names])
    key = docs.select(
        row.alias("_row"),
        under.alias("_source"),
        F.xxhash64(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))).alias("_hash"),
        F.col(quoted(doc_id)).alias("_id"),
        F.xxhash64(quoted(text)).alias("_text"),
        F.monotonically_increasing_id().alias("_at"),
        (F.coalesce(F.length(quoted(text)), F.lit(0)) + 1).cast("long").alias("_size"),
    )
    by = ["_source", "_hash", "_id", "_text", "_at"]
    ordered = key.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())

    def running(batches):
        at: dict = {}
        for sources, sizes in batches:
            count, total = [], []
            for s, n in zip(sources.to_pylist(), sizes.to_pylist()):
                c, t = at.get(s, (0, 0))
                count.append(c)
                total.append(t)
                at[s] = (c + 1, t + n)
            yield [count, total], None

    fields = [T.StructField("_count", T.LongType()), T.StructField("_before", T.LongType())]
    done = staged(append_columns(ordered, ["_source", "_size"], fields, running, ["_row", "_source", "_size", "_part"], "mix"), "mix")
    flat = done.select("_row._row", "_row._source", "_row._size", "_row._part", "_count", "_before")
    sums = flat.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("c"), F.sum("_size").alias("t")).collect()
    start: dict = {}
    at: dict = {}
    for r in sorted(sums, key=lambda r: (r._source is not None, r._source or "", r._part)):
        c, t = at.get(r._source, (0, 0))
        start[(r._source, r._part)] = (c, t)
        at[r._source] = (c + r.c, t + r.t)
    # Rows of this broadcast: partitions and sources, and 8 bytes for each block.
    plan = schedule(wanted, {s: (t - 1) // block + 1 for s, (_, t) in at.items()})
    shared = spark.sparkContext.broadcast((plan, start))

    def place(batches):
        plan, start = shared.value
        for sources, parts, counts, before in batches:
            rows = []
            for s, p, c, t in zip(*(x.to_pylist() for x in (sources, parts, counts, before))):
                first, offset = start[(s, p)]
                j = (offset + t) // block
                begin, n, total, slots = plan[s]
                release, deadline = window(j, n, total)
                rows.append((j, slots[j], begin + release, begin + deadline, first + c))
            yield [list(x) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, None

    out = [T.StructField(x, T.LongType()) for x in ("block", "slot", "release", "deadline", "place")]
    return append_columns(flat, ["_source", "_part", "_count", "_before"], out, place, ["_row"], "mix").select("_row._row", *[f.name for f in out])


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The documents' own columns in range partitions by slot, sorted within: written, the files are in mixed order."""
    return mixed.repartitionByRange(partitions(mixed.sparkSession), "slot", "place").sortWithinPartitions("slot", "place").select("_row.*")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the schedule, as ``in_mixed_order(mix(docs))`` gives them, with the places found by row key alone: texts are read for their lengths, and then shuffled to their places and into their order, without a way through Python."""
    name = "_key"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    keyed, _ = with_rows(docs, name)
    places = staged(mix(keyed, carry=[name], **options).select(F.col(f"_row.{name}").alias("_at"), F.col("slot").alias("_slot"), F.col("place").alias("_place")), "places")
    # The same plan at every size: places are hashed in the partitions of their keys, and texts are not sorted to meet them.
    rows = keyed.join(places.hint("shuffle_hash"), keyed[name] == places["_at"])
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), places["_slot"], places["_place"]).sortWithinPartitions(places["_slot"], places["_place"])
    return ordered.select(*[keyed[quoted(c)] for c in docs.columns])
