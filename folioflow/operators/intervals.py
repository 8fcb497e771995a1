"""Intervals of characters against intervals (DOC01, DOC03): spans in chunks by their offsets.

Intervals are half open. Both sides are dealt into bins of a width, so that the
keys of the join are places in a document and not the document; a pair is kept in
one bin only, that in which the later of its two starts lies. Empty intervals meet
nothing.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans of a document that are sought together.
TOGETHER = 1_000
#: Rows of a batch whose places are made together, and places that are held before they are sent.
AT_ONCE, PLACES = 64, 1 << 15


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.when(start < end, F.sequence(F.floor(start / width), F.floor((end - 1) / width))).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, starts: tuple[str, str] = ("start", "char_start"), ends: tuple[str, str] = ("end", "char_end"), within: bool = False) -> DataFrame:
    """Pairs of rows with equal keys whose intervals share a character or, with ``within``, whose left one lies in the right one. Other columns of the sides have different names."""
    (ls, rs), (le, re) = starts, ends
    many = left.select("*", F.explode(F.array(F.floor(F.col(ls) / width)) if within else _bins(F.col(ls), F.col(le), width)).alias("_bin"))
    many = many.where(F.col(ls) < F.col(le))
    others = right.select("*", F.explode(_bins(F.col(rs), F.col(re), width)).alias("_bin"))
    joined = many.join(others, [*keys, "_bin"])
    fits = (F.col(rs) <= F.col(ls)) & (F.col(le) <= F.col(re)) if within else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    return joined.where(fits & (F.floor(F.greatest(ls, rs) / width) == F.col("_bin"))).drop("_bin")


def _places(texts: pa.Array, spans: pa.Array):
    """Row, span, start and end of every place where a text holds one of its spans, in lists of at most ``PLACES``."""
    at, found, first, last = [], [], [], []
    for i in range(len(texts)):
        automaton = ahocorasick.Automaton()
        for s in spans[i].as_py():
            automaton.add_word(s, s)
        automaton.make_automaton()
        for end, s in automaton.iter(texts[i].as_py()):
            at.append(i)
            found.append(s)
            first.append(end + 1 - len(s))
            last.append(end + 1)
            if len(at) == PLACES:
                yield at, found, first, last
                at, found, first, last = [], [], [], []
    yield at, found, first, last


def occurrences(docs: DataFrame, spans: DataFrame, doc: str = "contract_name", text: str = "text", span: str = "span", together: int = TOGETHER) -> DataFrame:
    """doc, span, start, end: every place where a document holds one of its own spans, also where places overlap.

    Spans are sought by automata of ``together`` spans, about, so that a document
    with very many is dealt over tasks. Null and empty spans and texts have no
    place; spans that repeat are sought once.
    """
    own = spans.where(F.length(span) > 0).select(doc, F.col(span).alias("_span")).distinct()
    parts = own.groupBy(doc).agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_parts"))
    dealt = own.join(parts, doc).groupBy(doc, F.pmod(F.xxhash64("_span"), F.col("_parts")).cast("int").alias("_part")).agg(F.collect_list("_span").alias("_spans"))
    rows = docs.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("_text")).join(dealt, doc).select(doc, "_text", "_spans")

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, AT_ONCE):
                few = b.slice(low, AT_ONCE)
                for at, found, first, last in _places(few.column(1), few.column(2)):
                    yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=[doc, span, "start", "end"])

    return rows.mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, `{span}` string, start long, end long")


def located_by_offsets(spans: DataFrame, docs: DataFrame, chunks: DataFrame, doc: str = "contract_name", width: int = 8_000) -> DataFrame:
    """JN11 within a document: doc, span and chunk_id of each chunk (``char_start``, ``char_end``) that holds a span. Chunk texts are not read; a text is gone through once."""
    places = occurrences(docs, spans, doc)
    ranges = chunks.select(doc, "chunk_id", "char_start", "char_end")
    return overlap_join(places, ranges, [doc], width, within=True).select(doc, "span", "chunk_id").distinct()
