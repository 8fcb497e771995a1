"""Fill-in-middle transformation (operator 11).

A kernel over Arrow's UTF-8 buffers cuts all rows of a slice together. Each byte
gets a class by table, each pair of adjacent bytes a mark where a unit begins;
the running count of marks, less what stood before a document, numbers the units
in it, and a binary search in that count finds the bytes of all cuts at once.
The rearranged texts are gathered out of the same buffer. What a document gets is
drawn from a digest of its id, so a task that runs again makes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import append_columns, quoted, spans, text_bytes, text_slices

#: What marks the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the documents that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Unit:
    """``kind``: the class of each byte; ``starts[a, b]``: whether a byte of class b after one of class a begins a unit. A document's first byte always does."""

    kind: np.ndarray
    starts: np.ndarray


def _unit(members: list[int], starts: list[list[bool]]) -> Unit:
    return Unit(np.isin(np.arange(256), members).astype(np.uint8), np.array(starts))


UNITS = {
    "character": _unit(list(range(128, 192)), [[True, False], [True, False]]),  # all but what continues a code point
    "word": _unit([9, 10, 11, 12, 13, 32], [[False, False], [True, False]]),  # a word with the white space after it
    "line": _unit([10], [[False, False], [True, True]]),  # a line with its end
}


def unit_count(raw: np.ndarray, at: np.ndarray, unit: Unit) -> np.ndarray:
    """Units that have begun before each byte (with the end), over all texts."""
    kind = unit.kind[raw]
    mask = np.empty(len(raw), bool)
    mask[1:] = unit.starts[kind[:-1], kind[1:]]
    mask[at[:-1][at[:-1] < at[1:]]] = True
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def cut_places(count: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte where unit k of each text begins, or its end where it has no unit k."""
    n = count[at[1:]] - count[at[:-1]]
    return np.where(k < n, np.searchsorted(count[1:], count[at[:-1]] + k + 1), at[1:])


def rearranged(texts: pa.Array, draws: np.ndarray, unit: str = "character", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts. ``draws`` has four integers for each."""
    raw, at = text_bytes(texts)
    count = unit_count(raw, at, UNITS[unit])
    n = count[at[1:]] - count[at[:-1]]
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    cuts = [at[:-1], cut_places(count, at, np.minimum(one, two)), cut_places(count, at, np.maximum(one, two)), at[1:]]
    stays = (n == 0) | (draws[:, 2] % 100 >= 100 - plain)
    for mark in marks:
        stays |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    form = np.where(stays, 0, np.where(draws[:, 3] % 100 < suffix_first, 2, 1))

    # Pieces of every output as (first byte, bytes) in one buffer: all texts, then the marks.
    encoded = [m.encode() for m in marks]
    source = np.concatenate([raw, np.frombuffer(b"".join(encoded), np.uint8)])
    sizes = [len(m) for m in encoded]
    mark_at = [len(raw) + sum(sizes[:i]) for i in range(3)]
    parts = [(cuts[0], cuts[1]), (cuts[2], cuts[3]), (cuts[1], cuts[2])]  # prefix, suffix, middle
    first, size = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for number, order in ((1, (0, 1, 2)), (2, (1, 0, 2))):
        rows = form == number
        for place, p in enumerate(order):
            first[rows, 2 * place], size[rows, 2 * place] = mark_at[p], sizes[p]
            first[rows, 2 * place + 1], size[rows, 2 * place + 1] = parts[p][0][rows], (parts[p][1] - parts[p][0])[rows]
    first[stays, 0], size[stays, 0] = at[:-1][stays], np.diff(at)[stays]
    output = source[spans(first.ravel(), size.ravel())]
    ends = np.concatenate([[0], np.cumsum(size.sum(1))])
    if ends[-1] >= 1 << 31:
        raise ValueError("a text with its marks goes beyond 2 GB")
    made = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(output)])

    chars = count if unit == "character" else unit_count(raw, at, UNITS["character"])
    widths = [pa.array(chars[cuts[i + 1]] - chars[cuts[i]], pa.int64(), mask=stays) for i in (0, 1)]
    return [pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()), *widths, made]


def draws_of(doc_id: str = "doc_id", seed: int = 1) -> Column:
    """The first 16 bytes of the SHA-256 of ``seed:id``, which hold four integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.unhex(F.substring(digest, 1, 32))


def fill_in_middle(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, unit: str = "character", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, carry: list[str] | None = None
) -> DataFrame:
    """``_row`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``, for every document.

    The text is cut before two of its units (``character``, ``word`` or ``line``)
    or at its end. psm: marked prefix, suffix, middle; spm: suffix, prefix, middle.
    Empty and null texts, and those that hold a mark, stay plain, so that
    ``restored`` gives every text back. Null ids draw as an empty id; repeated
    rows come out alike, each on its own; texts of any length are cut whole; an
    empty table gives an empty result. Columns named like the results stay apart,
    inside ``_row``.
    """
    if any(a[:1] in b[1:] for a in marks for b in marks) or len(set(marks)) < 3 or not all(marks):
        raise ValueError("marks must differ, and begin with a character that they do not hold again")
    name = "_draws"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    carry = docs.columns if carry is None else carry
    rows = docs.select("*", draws_of(doc_id, seed).alias(name))

    def compute(batches):
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for texts, drawn in batches:
            done, parts = 0, [[pa.array([], t)] for t in types]
            for part in text_slices(texts):
                draws = np.frombuffer(b"".join(drawn.slice(done, len(part)).to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
                done += len(part)
                for column, x in zip(parts, rearranged(part, draws, unit, marks, plain, suffix_first)):
                    column.append(x)
            yield [pa.concat_arrays(x) for x in parts], None

    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return append_columns(rows, [text, name], fields, compute, carry, "fill")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No mark stands in a rearranged text, so each is found once in its output."""
    o = F.col(output)
    prefix_mark, suffix_mark, middle_mark = marks
    between = lambda a, b: F.substring_index(F.substring_index(o, a, -1), b, 1)
    middle = F.substring_index(o, middle_mark, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(between(prefix_mark, suffix_mark), middle, between(suffix_mark, middle_mark)))
        .when(F.col(form) == "spm", F.concat(between(prefix_mark, middle_mark), middle, between(suffix_mark, prefix_mark)))
        .otherwise(o)
    )
