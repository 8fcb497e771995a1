"""Benchmark decontamination by a prefix-filtered set join (operator 3).

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window). A window is a set of word shingles with positions;
as it must be contained whole, a prefix of one shingle is necessary: the one that
is rarest in the corpus (shingles are ordered by their counts over all
documents). A document's shingle that is some window's prefix gives that window's
only possible start (positional bound), which must lie inside the document
(length bound), and the words there are compared one by one.

Two plans do this. A benchmark of at most ``BLOCK`` bytes of text becomes an index
of arrays (some 25 bytes a word) that is broadcast: documents are mapped, without
a shuffle. A larger one is joined: its windows and the documents' shingles, sieved
by a Bloom filter of fixed size over the prefixes, meet by a shuffle on the prefix
shingle. Neither collects a benchmark of any size, nor passes over the documents
more than twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import ALNUM, Words, append_columns, in_worker, quoted, remove, scratch, spans, staged, text_slices, with_rows, words_of

#: Bytes of item text up to which the index is broadcast.
BLOCK = 2 << 20
#: Words of a shingle; a shorter window has shingles as long as itself.
SHINGLE = 3
#: Candidates that are compared at once.
AT_ONCE = 1 << 19
#: Bits of a Bloom filter, and the ranges in which its parts are merged.
BITS, RANGES = 1 << 26, 64

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@np.errstate(over="ignore")
def shingle_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles of k words (given by their hashes) that begin at the places."""
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out += (h[at + i] ^ (h[at + i] >> _U(29))) * _FACTORS[i]
    return (out ^ (out >> _U(32))) * _FACTORS[0]


def window_bounds(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and texts of the windows of texts whose words begin at ``first`` (with the end)."""
    count = np.diff(first)
    size = np.minimum(count, window)
    many = np.where(count > 0, count - size + 1, 0)
    return spans(first[:-1], many), np.repeat(size, many), np.repeat(np.arange(len(count)), many)


def prefixes(h: np.ndarray, start: np.ndarray, size: np.ndarray, rarity) -> tuple[np.ndarray, np.ndarray]:
    """For each window the offset and the hash of its rarest shingle, the first of equally rare ones. ``rarity`` gives counts for shingle hashes."""
    offset, key, least = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64), np.full(len(start), np.iinfo(np.int64).max)
    for k in range(1, SHINGLE + 1):
        fit = np.flatnonzero(np.minimum(size, SHINGLE) == k)
        for i in range(int(size[fit].max(initial=0)) - k + 1):
            at = fit[size[fit] >= i + k]
            s = shingle_hashes(h, start[at] + i, k)
            n = rarity(s)
            new = n < least[at]
            at, s, n = at[new], s[new], n[new]
            offset[at], key[at], least[at] = i, s, n
    return offset, key


def covered(n_words: int, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of each text's words lie in any of the spans."""
    change = np.bincount(start, minlength=n_words + 1) - np.bincount(end, minlength=n_words + 1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(change)[:n_words] > 0)])[first])


@dataclass
class Index:
    """The windows of a benchmark by their prefixes, ascending: ``offset`` of the prefix in the window, the window's ``start`` in ``words`` (numbers in ``vocabulary``) and ``size``, the number of its item in ``items``."""

    vocabulary: np.ndarray
    words: np.ndarray
    keys: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    items: list[str]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers in the vocabulary; -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == h, at, -1) if len(self.vocabulary) else np.full(len(h), -1)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows: text, first word, word after the last (in all words of the slice), item."""
        h = words.hashes()
        own = self.numbers(h)
        out = [np.empty(0, np.int64)] * 4
        ends = words.first[1:]
        for k in np.unique(np.minimum(self.size, SHINGLE)).tolist():
            if len(h) < k:
                continue
            known = own[: len(own) - k + 1] >= 0
            for i in range(1, k):
                known &= own[i : len(own) - k + 1 + i] >= 0
            at = np.flatnonzero(known)
            text = np.searchsorted(words.first, at, "right") - 1
            inside = at + k <= ends[text]
            at, text = at[inside], text[inside]
            key = shingle_hashes(h, at, k)
            low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            hit = np.flatnonzero(high > low)
            for part in np.split(hit, np.searchsorted(np.cumsum((high - low)[hit]), range(AT_ONCE, int((high - low)[hit].sum()), AT_ONCE))):
                many = (high - low)[part]
                w, who = spans(low[part], many), np.repeat(text[part], many)
                start = np.repeat(at[part], many) - self.offset[w]
                same = (start >= words.first[who]) & (start + self.size[w] <= ends[who])
                w, who, start = w[same], who[same], start[same]
                for i in range(int(self.size.max())):
                    short = self.size[w] <= i
                    place = np.minimum(start + i, len(own) - 1)
                    same = short | (own[place] == self.words[np.minimum(self.start[w] + i, len(self.words) - 1)])
                    w, who, start = w[same], who[same], start[same]
                out = [np.concatenate(x) for x in zip(out, (who, start, start + self.size[w], self.item[w].astype(np.int64)))]
        return tuple(out)


def _count(docs: DataFrame, text: str, vocabulary: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each shingle (sorted hashes) stands in all documents. What comes back is no larger than the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for part in text_slices(batch.column(0)):
                words = words_of(part, ALNUM)
                for _, _, s in document_shingles(words, sizes):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    total += np.bincount(at[known[at] == s], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select(F.col(quoted(text))).mapInArrow(in_worker("decontaminate", run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r.shingle] = r.n
    return out


def document_shingles(words: Words, sizes: list[int]):
    """For each size: the size, the places and the hashes of the shingles that lie within a text."""
    h = words.hashes()
    for k in sizes:
        at = spans(words.first[:-1], np.maximum(np.diff(words.first) - k + 1, 0))
        yield k, at, shingle_hashes(h, at, k)


def build_index(items: list[tuple[str, str]], docs: DataFrame, text: str, window: int) -> Index:
    """The index of (item, text) rows, ordered by the shingles' counts in all documents."""
    names = sorted({i for i, _ in items})
    number = {x: i for i, x in enumerate(names)}
    words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
    h = words.hashes()
    start, size, owner = window_bounds(words.first, window)
    sizes = np.unique(np.minimum(size, SHINGLE)).tolist()
    keys = np.unique(np.concatenate([np.empty(0, np.uint64), *[s for _, _, s in document_shingles(words, sizes)]]))
    counts = _count(docs, text, keys, sizes)
    offset, key = prefixes(h, start, size, lambda s: counts[np.searchsorted(keys, s)])
    order = np.argsort(key, kind="stable")
    vocabulary, numbers = np.unique(h, return_inverse=True)
    item = np.array([number[i] for i, _ in items], np.int32)[owner] if items else np.empty(0, np.int32)
    return Index(vocabulary, numbers.astype(np.int32), key[order], offset[order].astype(np.uint8), start[order].astype(np.int32), size[order].astype(np.uint8), item[order], names)


_SPANS, _ITEMS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_FIELDS = [T.StructField(k, v) for k, v in {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType(), "spans": _SPANS, "items": _ITEMS}.items()]


def _columns(words: Words, who: np.ndarray, start: np.ndarray, end: np.ndarray, item: list[str]) -> list[list]:
    """The result columns of a slice of texts from the occurrences in it."""
    n = len(words.first) - 1
    n_hit = covered(len(words.start), words.first, start, end)
    flat: list[list] = [[] for _ in range(n)]
    found: list[set] = [set() for _ in range(n)]
    for d, a, b, x in sorted(zip(who.tolist(), (start - words.first[who]).tolist(), (end - words.first[who]).tolist(), item)):
        if flat[d][-2:] != [a, b]:
            flat[d] += [a, b]
        found[d].add(x)
    named = [sorted(x) for x in found]
    empty = hashlib.sha256(b"").hexdigest()
    return [np.diff(words.first).tolist(), n_hit.tolist(), [len(x) for x in named], [hashlib.sha256(",".join(x).encode()).hexdigest() if x else empty for x in named], (n_hit > 0).tolist(), flat, named]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the document's columns, or those in ``carry``) with ``n_words, n_hit, n_items, items_sha256, contaminated, spans, items``.

    Null and empty documents have no words and are clean; long ones are compared
    whole; items without an id, text or words match nothing; repeated items count
    once; an empty benchmark leaves every document clean, an empty table of
    documents gives an empty result. Repeated documents give repeated rows.
    Columns with the results' names stay apart, inside ``_row``.
    """
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 words")
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), F.col(quoted(item_text)).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    if size > block:
        return _joined(docs, items, window, text, carry)
    index = build_index([(r.item, r.text) for r in items.collect()], docs, text, window)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def compute(batches):
        index = shared.value
        for (texts,) in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for part in text_slices(texts):
                words = words_of(part, ALNUM)
                who, start, end, item = index.matches(words)
                for column, values in zip(out, _columns(words, who, start, end, [index.items[i] for i in item.tolist()])):
                    column += values
            yield out, None

    return append_columns(docs, [text], _FIELDS, compute, carry, "decontaminate")


# ---------------------------------------------------------------- benchmarks of any size


def _bloom(hashes: DataFrame) -> np.ndarray:
    """A filter of BITS bits over a column of 64-bit hashes: bitmaps by task, merged by range, collected (8 MB at every size)."""

    def fill(batches):
        bits = np.zeros(BITS >> 3, np.uint8)
        for b in batches:
            bit = b.column(0).to_numpy().view(np.uint64) % _U(BITS)
            np.bitwise_or.at(bits, (bit >> _U(3)).astype(np.int64), (1 << (bit & _U(7))).astype(np.uint8))
        parts = [(i, x) for i, x in enumerate(np.split(bits, RANGES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "bits"])

    def merge(batches):
        out: dict = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out[i] = out.get(i, 0) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    whole, step = np.zeros(BITS >> 3, np.uint8), (BITS >> 3) // RANGES
    for r in hashes.mapInArrow(in_worker("bloom", fill), kind).repartitionById(RANGES, F.col("part")).mapInArrow(in_worker("bloom", merge), kind).collect():
        whole[r.part * step : (r.part + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return whole


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % _U(BITS)
    return (bits[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sieved(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Counts, by task, of the documents' shingles that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch.column(0)):
                words = words_of(part, ALNUM)
                every = [s[_passes(shared.value, s)] for _, _, s in document_shingles(words, sizes)]
                keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *every]), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], names=["s", "n"])

    return docs.select("text").mapInArrow(in_worker("decontaminate", run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _joined(docs: DataFrame, items: DataFrame, window: int, text: str, carry: list[str] | None) -> DataFrame:
    """The same by shuffle joins, for a benchmark that is too large to broadcast."""
    spark = docs.sparkSession
    name = "_key"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    keyed, _ = with_rows(docs, name)
    texts = keyed.select(F.col(name).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    sizes = [*range(1, SHINGLE + 1)]

    def shingled(batches):
        """Each item with the hashes of its words and of the shingles that its windows have."""
        for b in batches:
            words = words_of(b.column(1), ALNUM)
            h, count = words.hashes(), np.diff(words.first)
            k = np.minimum(np.minimum(count, window), SHINGLE)
            rows = [shingle_hashes(h, np.arange(a, z - j + 1), j) if j else np.empty(0, np.uint64) for a, z, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), k.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[a:z].tobytes() for a, z in zip(words.first[:-1], words.first[1:])], pa.binary()), pa.array([r.view(np.int64).tolist() for r in rows], pa.list_(pa.int64()))], names=["item", "words", "shingles"])

    cut_path = scratch(spark, "items")
    items.select("item", "text").mapInArrow(in_worker("decontaminate", shingled), "item string, words binary, shingles array<long>").withColumn("row", F.monotonically_increasing_id()).write.parquet(cut_path)
    cut = spark.read.parquet(cut_path)
    used = cut.select(F.explode("shingles").alias("s")).distinct()
    counts = _sieved(texts, _bloom(used), sizes).join(used, "s", "left_semi")
    placed = cut.select("row", F.posexplode("shingles").alias("i", "s")).join(counts, "s", "left").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("counts"))

    def cut_windows(batches):
        """Windows by their rarest shingle."""
        for b in batches:
            for item, packed, n in zip(*[c.to_pylist() for c in b.columns]):
                h, n = np.frombuffer(packed, np.uint64), np.array(n, np.int64)
                start, size, _ = window_bounds(np.array([0, len(h)]), window)
                k = min(len(h), window, SHINGLE)
                keys = shingle_hashes(h, np.arange(len(h) - k + 1), k)
                spread = np.lib.stride_tricks.sliding_window_view(n, int(size[0]) - k + 1)
                offset = spread.argmin(1)
                yield pa.RecordBatch.from_arrays([_signed(keys[start + offset]), pa.array(offset.astype(np.int32)), pa.array([h[s : s + z].tobytes() for s, z in zip(start, size)], pa.binary()), pa.array([item] * len(start), pa.string())], names=["s", "offset", "window", "item"])

    rarest = staged(cut.join(placed, "row").select("item", "words", "counts").mapInArrow(in_worker("decontaminate", cut_windows), "s long, offset int, window binary, item string"), "windows")
    shared = spark.sparkContext.broadcast(_bloom(rarest.select("s")))

    def probe(batches):
        """Shingles that the filter lets through, with the words around them, as far as a window could reach."""
        for batch in batches:
            for at0, part in _with_place(batch.column(1)):
                words = words_of(part, ALNUM)
                h = words.hashes()
                for k, at, s in document_shingles(words, sizes):
                    through = _passes(shared.value, s)
                    at, s = at[through], s[through]
                    who = np.searchsorted(words.first, at, "right") - 1
                    low, high = np.maximum(at - window + 1, words.first[who]), np.minimum(at + window, words.first[who + 1])
                    around = [h[a:z].tobytes() for a, z in zip(low.tolist(), high.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who + at0)), _signed(s), pa.array(at - words.first[who]), pa.array(at - low), pa.array(around, pa.binary())], names=["key", "s", "at", "before", "around"])

    met = texts.mapInArrow(in_worker("decontaminate", probe), f"key {dict(texts.dtypes)['key']}, s long, at long, before long, around binary").join(rarest, "s")
    begin, length = F.col("before") - F.col("offset"), F.octet_length("window")
    same = met.where((begin >= 0) & (F.substring("around", (begin * 8 + 1).cast("int"), length) == F.col("window")))
    hits = same.select("key", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + length / 8).cast("long").alias("end"), "item").distinct()
    found = hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("_spans"), F.collect_set("item").alias("_items")).withColumnRenamed("key", "_hit")
    found = staged(found, "hits")
    remove(spark, cut_path)
    names = docs.columns if carry is None else carry
    row = F.struct(*[keyed[quoted(c)].alias(c) for c in names]) if names else F.struct(F.lit(None).cast("int").alias("_"))
    beside = keyed.select(row.alias("_row"), F.col(quoted(text)).cast("string").alias("_text"), F.col(name).alias("_at")).join(found, F.col("_at") == F.col("_hit"), "left").drop("_at", "_hit")

    def compute(batches):
        for texts, where, who in batches:
            out: list[list] = [[] for _ in _FIELDS]
            at = 0
            for part in text_slices(texts):
                words = words_of(part, ALNUM)
                places, named = where.slice(at, len(part)).to_pylist(), who.slice(at, len(part)).to_pylist()
                rows = [(i, s["start"] + words.first[i], s["end"] + words.first[i]) for i, x in enumerate(places) for s in x or ()]
                doc, start, end = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 3
                values = _columns(words, doc, start, end, [""] * len(rows))
                named = [sorted(x or ()) for x in named]
                values[2], values[3], values[6] = [len(x) for x in named], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], named
                for column, v in zip(out, values):
                    column += v
                at += len(part)
            yield out, None

    return append_columns(beside, ["_text", "_spans", "_items"], _FIELDS, compute, ["_row"], "decontaminate").select("_row._row", *[f.name for f in _FIELDS])


def _with_place(column: pa.Array):
    """``text_slices`` with the place where each begins."""
    at = 0
    for part in text_slices(column):
        yield at, part
        at += len(part)
