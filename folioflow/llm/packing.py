"""Cost-balanced packing of token sequences (operator 12).

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention looks back
within its own piece only. Documents of more than a sequence are cut into whole
sequences and a rest. Rests go, longest first, to the sequence of lowest cost that
has room for them; one that no sequence has room for is cut and fills the sequence
of lowest cost that has any room.

Each task packs what it reads in groups of bounded size, so that nothing is
shuffled and one task's sequences do not depend on another's. The sequences of a
group have just as many tokens as its documents: all are full but a tail, which is
made of sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import arrow_type, in_worker, quoted, spans, task_id, tokenizer_path
from folioflow.llm.tokens import word_tokenizer

#: Tokens of a sequence.
CAPACITY = 4_096
#: Costs of a token and of a pair of tokens: those of a transformer layer of width 2,048, by 4 * width.
LINEAR, QUADRATIC = 6 * 2_048, 1
#: Tokens and documents of a group that is packed together, about. Its sequences are compared for each piece.
GROUP, GROUP_DOCS = 1 << 22, 1 << 16
#: Sequences that a task can number.
NUMBERS = 33


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of sequences that hold ``total`` tokens: full ones, and powers of two, longest first."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) as rows, and the sequences' lengths and costs."""
    whole = lengths // capacity
    rest = lengths - whole * capacity
    owner = np.repeat(np.arange(len(lengths)), whole)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    n_whole = len(owner)
    ready = np.stack([owner, number * capacity, np.full(n_whole, capacity), np.arange(n_whole), np.zeros(n_whole, np.int64)], 1) if n_whole else np.empty((0, 5), np.int64)

    room = np.array(capacities(int(rest.sum()), capacity), np.int64)
    free, cost = room.copy(), np.zeros(len(room))
    pieces = []
    order = np.argsort(-rest, kind="stable")
    for i in order[rest[order] > 0].tolist():
        start, left = int(whole[i]) * capacity, int(rest[i])
        while left:
            j = int(np.argmin(np.where(free >= left, cost, np.inf)))
            if free[j] < left:  # no sequence has room for it
                j = int(np.argmin(np.where(free > 0, cost, np.inf)))
            n = min(left, int(free[j]))
            pieces.append((i, start, n, n_whole + j, int(room[j] - free[j])))
            free[j] -= n
            cost[j] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    full_cost = linear * capacity + quadratic * capacity * capacity
    rows = np.concatenate([ready, np.array(pieces, np.int64).reshape(-1, 5)])
    return rows, np.concatenate([np.full(n_whole, capacity), room]), np.concatenate([np.full(n_whole, full_cost), cost.astype(np.int64)])


def _groups(batches, path: str, end_id: int):
    """Documents in groups: ids of all, each one's first place (with the end), and their ``doc_id``s."""
    tokenizer = word_tokenizer(path)
    ids, sizes, names, held, count = [], [], [], 0, 0

    def group():
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.concat_arrays(names)

    for batch in batches:
        done = 0
        for found, first in tokenizer.ids(batch.column(1)):
            n = np.diff(first) + 1
            ends = np.cumsum(n)
            every = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
            every[np.arange(len(found)) + np.repeat(np.arange(len(n)), np.diff(first))] = found
            ids.append(every)
            sizes.append(n)
            names.append(batch.column(0).slice(done, len(n)))
            done, held, count = done + len(n), held + len(every), count + len(n)
            if held >= GROUP or count >= GROUP_DOCS:
                yield group()
                ids, sizes, names, held, count = [], [], [], 0, 0
    if count:
        yield group()


def _packed(batches, path: str, end_id: int, capacity: int, linear: int, quadratic: int):
    """For each group: its ids, documents, pieces in order of sequence and offset, lengths and costs of the sequences, and the number of the first of these."""
    number = task_id()[0] << NUMBERS
    for ids, first, names in _groups(batches, path, end_id):
        pieces, room, cost = assign(np.diff(first), capacity, linear, quadratic)
        yield ids, first, names, pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))], room, cost, number
        number += len(room)


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


def _gathered(ids: np.ndarray, first: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The ids of all pieces, one after another."""
    return ids[spans(first[pieces[:, 0]] + pieces[:, 1], pieces[:, 2])]


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens, sequence_cost, ids``.

    Every document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone. ``ids`` are little-endian unsigned 32-bit integers. Repeated rows and
    null ids are documents of their own; texts of any length are packed whole; an
    empty table has no piece. Other columns are not read, whatever their names.
    Sequences are numbered within the task that packs them, so numbers follow the
    partitions of ``docs``.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    source = _source(docs, text, doc_id)
    id_type = arrow_type(source.schema["doc_id"].dataType)

    def run(batches):
        for ids, first, names, pieces, room, cost, number in _packed(batches, path, end_id, capacity, linear, quadratic):
            doc, start, length, sequence, offset = pieces.T
            columns = [pa.array(x, pa.int64()) for x in (start, length, np.diff(first)[doc], number + sequence, offset, room[sequence], cost[sequence])]
            ends = np.concatenate([[0], np.cumsum(length)])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)).cast(id_type), *columns, _binaries(_gathered(ids, first, pieces), ends)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost", "ids"])

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost long, ids binary"
    return source.mapInArrow(in_worker("tokens", run), schema)


def sequences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """The packed sequences themselves, as training reads them: ``sequence_id, tokens, cost, ids`` (array), ``lengths`` of the pieces in it (the bounds of attention) and their ``doc_ids``. Edge cases as in ``pack``."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    source = _source(docs, text, doc_id)
    id_type = arrow_type(source.schema["doc_id"].dataType)

    def run(batches):
        for ids, first, names, pieces, room, cost, number in _packed(batches, path, end_id, capacity, linear, quadratic):
            edges = pa.array(np.searchsorted(pieces[:, 3], np.arange(len(room) + 1)), pa.int32())
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(room)]), pa.int32()), pa.array(_gathered(ids, first, pieces).astype(np.int32)))
            lengths = pa.ListArray.from_arrays(edges, pa.array(pieces[:, 2], pa.int32()))
            owners = pa.ListArray.from_arrays(edges, names.take(pa.array(pieces[:, 0])).cast(id_type))
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(room))), pa.array(room, pa.int64()), pa.array(cost, pa.int64()), tokens, lengths, owners], names=["sequence_id", "tokens", "cost", "ids", "lengths", "doc_ids"])

    return source.mapInArrow(in_worker("tokens", run), f"sequence_id long, tokens long, cost long, ids array<int>, lengths array<int>, doc_ids array<{source.schema['doc_id'].dataType.simpleString()}>")
