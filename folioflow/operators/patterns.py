"""Many passages sought in many texts at once (JN11).

An automaton over the first ``ANCHOR`` characters of all passages goes once over
each text; where it stops, the whole passage is compared. It is compiled once in a
worker, from passages that are broadcast in blocks of bounded size; with more than
one block, texts are read once for each. Texts are neither cut into words nor
shuffled, and a short passage costs no more than a long one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a passage that the automaton knows.
ANCHOR = 32
#: Characters in the automaton of a block and bytes of its passages, about.
BLOCK_ANCHORS, BLOCK_BYTES = 1 << 20, 8 << 20

_compiled: dict = {"key": None, "find": None}


def compile_passages(passages: list[str]) -> Callable[[str], list[int]]:
    """A function from a text to the numbers of the distinct passages that it holds verbatim. Passages are not empty.

    Passages that begin alike are told apart by length and whole text, so that a
    place where many of them could begin costs a look for each length among them.
    """
    alike: dict = defaultdict(lambda: defaultdict(dict))
    for i, p in enumerate(passages):
        alike[p[:ANCHOR]][len(p)][p] = i
    automaton = ahocorasick.Automaton()
    for head, by_length in alike.items():
        automaton.add_word(head, (len(head), [(n, members) for n, members in by_length.items()]))
    if not alike:
        return lambda text: []
    automaton.make_automaton()

    def find(text: str) -> list[int]:
        found = set()
        for last, (head, lengths) in automaton.iter(text):
            at = last + 1 - head
            for n, members in lengths:
                if n == head:
                    found.update(members.values())
                elif (i := members.get(text[at : at + n])) is not None:
                    found.add(i)
        return sorted(found)

    return find


def _held(key: str, make: Callable) -> Callable:
    """Workers outlive tasks: the automaton of one block at a time stays."""
    if _compiled["key"] != key:
        _compiled.update(key=None, find=None)
        _compiled.update(key=key, find=make())
    return _compiled["find"]


def passages_in(passages: DataFrame, docs: DataFrame, span: str = "span", text: str = "text", block_anchors: int = BLOCK_ANCHORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """JN11: the other columns of each distinct passage with those of every document that holds it verbatim, once each.

    Null and empty passages match nothing, and nothing is in a null text; rows of
    ``docs`` that repeat give repeated rows. The blocks' number follows the
    passages' size, so that no broadcast grows with them.
    """
    spark = docs.sparkSession
    own, keys = [c for c in passages.columns if c != span], [c for c in docs.columns if c != text]
    given = passages.where(F.length(span) > 0).dropDuplicates()
    size = given.agg(F.sum(F.least(F.length(span), F.lit(ANCHOR))).alias("a"), F.sum(F.octet_length(span)).alias("b")).first()
    blocks = max(1, -(-(size.a or 0) // block_anchors), -(-(size.b or 0) // block_bytes))
    fields = [*[passages.schema[c] for c in own], *[docs.schema[c] for c in keys]]
    labels = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(labels, fields)])
    found = None
    for number in range(blocks):
        table = given.where(F.pmod(F.xxhash64(span), F.lit(blocks)) == number).select(*own, span).toArrow()
        shared, key = spark.sparkContext.broadcast(table), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            block = shared.value
            texts = block.column(len(own)).to_pylist()
            rows: dict[str, list[int]] = defaultdict(list)  # passages that differ in their other columns only
            for i, p in enumerate(texts):
                rows[p].append(i)
            distinct = list(rows)
            find = _held(key, lambda: compile_passages(distinct))
            for b in batches:
                doc, passage = [], []
                for i, x in enumerate(b.column(len(keys))):
                    if x.is_valid:
                        for p in find(x.as_py()):
                            passage += rows[distinct[p]]
                            doc += [i] * len(rows[distinct[p]])
                at, of = pa.array(np.array(doc, np.int64)), pa.array(np.array(passage, np.int64))
                columns = [*[block.column(i).combine_chunks().take(of) for i in range(len(own))], *[b.column(i).take(at) for i in range(len(keys))]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], names=labels)

        part = docs.select(*keys, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found.toDF(*own, *keys)
