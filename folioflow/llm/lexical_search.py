"""Ranked lexical search over document-sharded postings (operator 13).

Index. Documents are dealt into shards of bounded size where they are read. A
shard holds, as compressed sparse rows, for each of its terms the documents that
hold it (by place in the shard, which follows their ids) and the integer impact of
the term in each, which is all of a score that does not depend on the term's own
weight. Impacts need the corpus' number of documents and of terms, so a first pass
counts and a second one, which reads no text, turns counts into impacts. A
dictionary has the number of documents of each term.

Search. The items' terms and weights are broadcast in blocks of bounded size. For
every shard and item, terms are taken one at a time: a term's impacts, times its
weight, are added to an accumulator with a place for each document of the shard.
The best places are selected by ``argpartition``, with all that share the last
place's score, so that ties go by id; tasks keep the best of their shards, and one
window over these ranks the documents of an item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import ALNUM, LARGE_ROWS, arrow_type, in_worker, materialize, quoted, remove, runs, scratch, text_bytes, text_slices

#: Bytes of text and documents of a shard, at most, but for a single text that is longer; places in a shard fit 16 bits.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Bytes of text whose words are held at once.
AT_ONCE = 2 << 20
#: Bytes of items' terms that are broadcast at once, about; an item is in one block whole.
BLOCK_BYTES = 1 << 20
#: Fixed values of the score: a document's m is LEAST + ((SLOPE * n * N) div L), a posting's impact (SCALE * tf) div (1000 * tf + 8 * m).
LEAST, SLOPE, SCALE = 10, 90, 1_000_000_000

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str) -> Column:
    """The terms of a text, in order and with repeats, as a column; a null text has none."""
    folded = F.translate(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(TERMS), F.lit(0))


# ---------------------------------------------------------------- shards


@dataclass
class Counts:
    """Distinct (term, document) pairs of a part of a shard and how often they occur. ``terms`` are binaries, documents go by place."""

    terms: pa.Array
    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def count_terms(data: np.ndarray, at: np.ndarray, first: int) -> Counts:
    """Of folded bytes of texts that begin at ``at`` (with the end); the first of them is document ``first``."""
    solid = data != 32
    start, end = runs(solid, at)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])]).dictionary_encode()
    doc = np.searchsorted(at, start, "right") - 1
    n = len(at) - 1
    pair, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + doc, return_counts=True)
    return Counts(words.dictionary, pair // max(n, 1), first + pair % max(n, 1), tf)


def _parts(texts: pa.Array):
    """(folded bytes, first bytes with the end, documents before, documents that end in it) of parts of the texts. A text beyond ``2 * AT_ONCE`` is cut at blanks."""
    done = 0
    for part in text_slices(texts, AT_ONCE):
        raw, at = text_bytes(part)
        data = ALNUM[raw]
        if len(part) == 1 and len(data) > 2 * AT_ONCE:
            whole, low = data.tobytes(), 0
            while low < len(whole):
                high = whole.find(b" ", low + AT_ONCE)
                high = len(whole) if high < 0 else high
                yield data[low:high], np.array([0, high - low]), done
                low = high
        else:
            yield data, at, done
        done += len(part)


SHARD = ("ids", "n_docs", "n_terms", "lengths", "terms", "ends", "rows", "docs", "tf")


def make_shard(ids: pa.Array, texts: pa.Array) -> list:
    """The columns SHARD of one shard, whose documents are put in the order of their ids, null ones last."""
    parts = [count_terms(*p) for p in _parts(texts)]
    every = pa.concat_arrays([pa.array([], pa.binary()), *[p.terms for p in parts]]).dictionary_encode()
    number, before = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *[len(p.terms) for p in parts]])
    term = np.concatenate([np.empty(0, np.int64), *[number[b + p.term] for b, p in zip(before, parts)]])
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, np.int64)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = place[np.concatenate([np.empty(0, np.int64), *[p.doc for p in parts]])]
    tf = np.concatenate([np.empty(0, np.int64), *[p.tf for p in parts]])
    pair, back = np.unique(term * max(len(ids), 1) + doc, return_inverse=True)  # a text that was cut has a term in several parts
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, back, tf)
    term, doc = pair // max(len(ids), 1), pair % max(len(ids), 1)
    lengths = np.bincount(doc, total, len(ids)).astype(np.int64)
    blob = every.dictionary
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(blob).to_numpy(zero_copy_only=False))]).astype("<u4")
    rows = np.searchsorted(term, np.arange(len(blob) + 1)).astype("<u4")
    text = text_bytes(blob)[0].tobytes()
    return [ids.take(pa.array(order)), int((lengths > 0).sum()), int(lengths.sum()), lengths.astype("<i8").tobytes(), text, ends.tobytes(), rows.tobytes(), doc.astype("<u2").tobytes(), total.astype("<u4").tobytes()]


def _shard_terms(terms: bytes, ends: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) // 4 - 1, [None, pa.py_buffer(ends), pa.py_buffer(terms)])


def shards_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs as shards with the columns SHARD, each made of what one task read."""
    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType
    types = [pa.list_(arrow_type(id_type)), pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def shard(held):
        columns = make_shard(*[pa.concat_arrays(x) for x in zip(*held)])
        return pa.RecordBatch.from_arrays([pa.array([c.to_pylist() if isinstance(c, pa.Array) else c], t) for c, t in zip(columns, types)], names=list(SHARD))

    def run(batches):
        held, size, count = [], 0, 0
        for b in batches:
            done = 0
            for part in text_slices(b.column(1), SHARD_BYTES // 4):
                n, bytes_ = len(part), int(pc.sum(pc.binary_length(part)).as_py() or 0)
                if held and (size + bytes_ > SHARD_BYTES or count + n > SHARD_DOCS):
                    yield shard(held)
                    held, size, count = [], 0, 0
                for low in range(0, n, SHARD_DOCS):
                    if low:
                        yield shard(held)
                        held, size, count = [], 0, 0
                    few = part.slice(low, SHARD_DOCS)
                    held.append((b.column(0).slice(done + low, len(few)), few))
                    count += len(few)
                size += bytes_
                done += n
        if held:
            yield shard(held)

    names = {"ids": f"array<{id_type.simpleString()}>", "n_docs": "long", "n_terms": "long"}
    return source.mapInArrow(in_worker("search", run), ", ".join(f"{c} {names.get(c, 'binary')}" for c in SHARD))


def impacts_of(lengths: np.ndarray, docs: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(SCALE * tf) div (1000 * tf + 8 * m) of postings, in integers."""
    most = SLOPE * int(lengths.max(initial=0)) * n_docs
    wide = lengths.astype(object) if most >= 1 << 63 else lengths  # beyond 64 bits Python's integers go on
    m = (LEAST + SLOPE * wide * n_docs // max(n_terms, 1)).astype(np.int64)
    tf = tf.astype(np.int64)
    return SCALE * tf // (1000 * tf + 8 * m[docs])


@dataclass
class Index:
    """A written index: ``shards`` (ids, terms, ends, rows, docs, impacts), ``dictionary`` (term, df), the documents that hold a term and their terms."""

    shards: DataFrame
    dictionary: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Index every document's whole text under ``folder``.

    Texts are read once. Null and empty texts hold no term and do not count;
    repeated rows are documents of their own, and so are rows with null ids; an
    empty table makes an empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    draft_path = scratch(spark, "draft")
    draft = materialize(shards_of(docs, text, doc_id), draft_path, **LARGE_ROWS)
    sums = draft.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = int(sums.n or 0), int(sums.l or 0)

    def weigh(batches):
        for b in batches:
            out = []
            for lengths, docs_, tf in zip(*[b.column(c).to_pylist() for c in ("lengths", "docs", "tf")]):
                out.append(impacts_of(np.frombuffer(lengths, "<i8"), np.frombuffer(docs_, "<u2"), np.frombuffer(tf, "<u4"), n_docs, n_terms).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("ids", "terms", "ends", "rows", "docs")], pa.array(out, pa.binary())], names=["ids", "terms", "ends", "rows", "docs", "impacts"])

    def count(batches):
        for b in batches:
            for terms, ends, rows in zip(*[b.column(c).to_pylist() for c in ("terms", "ends", "rows")]):
                yield pa.RecordBatch.from_arrays([_shard_terms(terms, ends), pa.array(np.diff(np.frombuffer(rows, "<u4").astype(np.int64)))], names=["term", "df"])

    id_list = draft.schema["ids"].dataType.simpleString()
    shards = materialize(draft.mapInArrow(in_worker("search", weigh), f"ids {id_list}, terms binary, ends binary, rows binary, docs binary, impacts binary"), f"{folder}/shards", **LARGE_ROWS)
    dictionary = materialize(draft.select("terms", "ends", "rows").mapInArrow(in_worker("search", count), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")), f"{folder}/dictionary")
    spark.createDataFrame([(n_docs, n_terms)], "n_docs long, n_terms long").coalesce(1).write.parquet(f"{folder}/corpus")
    remove(spark, draft_path)
    return Index(shards, dictionary, n_docs, n_terms)


def open_index(spark: SparkSession, folder: str) -> Index:
    row = spark.read.parquet(f"{folder}/corpus").first()
    return Index(spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/dictionary"), row.n_docs, row.n_terms)


# ---------------------------------------------------------------- search


class Query:
    """A block of items over shard after shard: the best documents of each item so far."""

    def __init__(self, items: list, terms: list[bytes], weights: list[int], edges: np.ndarray, members: np.ndarray, k: int):
        self.items, self.weights, self.edges, self.members, self.k = items, weights, edges, members, k
        self.terms = pa.array(terms, pa.binary())
        self.best: dict[int, list[tuple]] = {}

    def take(self, ids: pa.Array, terms: pa.Array, rows: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        at = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)
        scaled: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        total = np.zeros(len(ids), np.int64)
        for item, (low, high) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist())):
            touched = False
            for t in self.members[low:high].tolist():
                if (j := at[t]) < 0:
                    continue
                if t not in scaled:
                    some = slice(rows[j], rows[j + 1])
                    scaled[t] = docs[some].astype(np.int64), self.weights[t] * impacts[some].astype(np.int64)
                where, what = scaled[t]
                total[where] += what  # a document stands once in a term's row
                touched = True
            if touched:
                self._keep(item, total, ids)
                total[:] = 0

    def _keep(self, item: int, total: np.ndarray, ids: pa.Array) -> None:
        floor = 1
        if len(total) > self.k:
            some = np.argpartition(total, len(total) - self.k)[len(total) - self.k :]
            floor = max(1, int(total[some].min()))
        held = self.best.get(item, [])
        if len(held) == self.k:
            floor = max(floor, -held[-1][0])
        places = np.flatnonzero(total >= floor)  # with all that share the last score: among them ids decide
        if len(places):
            places = places[np.argsort(-total[places], kind="stable")[: self.k]]
            new = [(-int(s), i is None, i) for s, i in zip(total[places], ids.take(pa.array(places)).to_pylist())]
            self.best[item] = sorted([*held, *new], key=lambda x: x if not x[1] else x[:2])[: self.k]


def item_terms(items: DataFrame, index: Index, item_id: str, text: str) -> DataFrame:
    """item_id, term and weight: floor(1000 ln((2 N + 2) / (2 df + 1))), of the terms that any document holds."""
    terms = items.select(F.col(quoted(item_id)).alias("item_id"), F.explode(F.array_distinct(terms_of(text))).alias("t")).distinct()
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return terms.select("item_id", F.col("t").cast("binary").alias("term")).join(index.dictionary, "term").select("item_id", "term", weight.alias("weight"))


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item, ties by ascending id (null ids last).

    Items that share an id, a null one too, are one item with the terms of all;
    items without a term of the index have no row. Of documents that repeat, each
    has a rank. Blocks of items are sought one after another, all over the whole index.
    """
    spark = items.sparkSession
    wanted = materialize(item_terms(items, index, item_id, text), scratch(spark, "wanted"))
    blocks = -(-(wanted.agg(F.sum(F.octet_length("term") + 16).alias("n")).first().n or 1) // block_bytes)
    ids_type = index.shards.schema["ids"].dataType.elementType
    item_type, doc_type = arrow_type(wanted.schema["item_id"].dataType), arrow_type(ids_type)
    found = None
    for number in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        names = list(dict.fromkeys(r.item_id for r in rows))
        place, terms = {x: i for i, x in enumerate(names)}, {bytes(r.term): r.weight for r in rows}
        at = {x: i for i, x in enumerate(terms)}
        pairs = sorted((place[r.item_id], at[bytes(r.term)]) for r in rows)
        edges = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(names) + 1))
        block = spark.sparkContext.broadcast((names, list(terms), list(terms.values()), edges, np.array([p[1] for p in pairs], np.int64)))

        def run(batches, block=block):
            query = Query(*block.value, k)
            for b in batches:
                for i, (terms, ends, rows, docs, impacts) in enumerate(zip(*[b.column(c).to_pylist() for c in ("terms", "ends", "rows", "docs", "impacts")])):
                    query.take(b.column("ids")[i].values, _shard_terms(terms, ends), np.frombuffer(rows, "<u4"), np.frombuffer(docs, "<u2"), np.frombuffer(impacts, "<u4"))
            out = [(query.items[i], x[2], -x[0]) for i, best in query.best.items() for x in best]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (item_type, doc_type, pa.int64()))], names=["item_id", "doc_id", "score"])

        part = index.shards.mapInArrow(in_worker("search", run), f"item_id {wanted.schema['item_id'].dataType.simpleString()}, doc_id {ids_type.simpleString()}, score long")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
