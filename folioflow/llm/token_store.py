"""Token ids in a content-addressed store (operator 1).

Format. A store is a folder of Parquet tables, written by Spark's committers (so
lost executors leave nothing half done):

* ``records``: one row for each document, in document order within and across
  files: ``part`` and ``pos`` (its place), ``doc_id``, ``start`` (ids before it in
  its part), ``n_tokens``, the recipe (``digests``, 16 bytes for each chunk, and
  ``lengths``, 4 bytes each), ``away`` (numbers of the chunks that another record
  holds), ``lent`` (numbers of the chunks here that others refer to), ``body``
  (the chunks that are stored here, zstd over ids of ``width`` bytes), ``root``.
* ``manifest``: one row for each part: documents, ids, Merkle root over the
  records' roots (fan-out 1,024), and ``width``.

A rolling hash over 16 ids cuts the id stream of each document into chunks of 64
to 2,048 ids. A chunk's address is its digest; it is stored once, in the record
with the lowest number of those that have it. A record's root hashes its recipe.
Reading fetches chunks by digest, checks every digest and root, and holds the
parts' Merkle roots against the manifest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import in_worker, materialize, partitions, quoted, release, remove, scratch, staged, tokenizer_path
from folioflow.llm.tokens import word_tokenizer

#: Chunk bounds in ids, and one cut in so many places that could be one.
LEAST, MOST, MASK = 64, 2_048, 255
WINDOW = 16
DIGEST = 16
FAN_OUT = 1_024

RECORD = "part int, pos long, doc_id {id}, start long, n_tokens long, digests binary, lengths binary, away array<int>, lent array<int>, body binary, root binary"


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Polynomial hash of the WINDOW ids that end at each place (fewer at the start), by doubling."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        factor, k = 0x2C1B3C6D, 1
        while k < WINDOW:
            shifted = np.zeros_like(h)
            shifted[k:] = h[:-k]
            h += shifted * np.uint32(factor)
            factor = factor * factor % (1 << 32)
            k *= 2
        return h ^ (h >> np.uint32(16))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    return _ends((np.flatnonzero((rolling_hash(ids) & np.uint32(MASK)) == 0) + 1).tolist(), n)


def _ends(places: list[int], n: int) -> list[int]:
    """Of the places that could be cuts, those that keep chunks within their bounds."""
    out, last = [], 0
    for c in [*places, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or (c == n and c > last):
            last = c
            out.append(c)
    return out


def all_cuts(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """``cuts`` of each of the streams that begin at ``first`` (the last is the end), with one hash over all: a cut is never within a window of a stream's start, since the window is shorter than a chunk."""
    could = np.flatnonzero((rolling_hash(ids) & np.uint32(MASK)) == 0) + 1
    edges = np.searchsorted(could, first, "right").tolist()
    out = []
    for a, b, lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), edges[:-1], edges[1:]):
        out.append(_ends((could[lo:hi] - a).tolist(), b - a) if b - a > LEAST else [b - a] if b > a else [])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def root(digests: bytes, lengths: bytes) -> bytes:
    return hashlib.sha256(digests + lengths).digest()


def _split(raw: bytes, lengths: np.ndarray, width: int) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) * width
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", order: list[Column] | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the store.

    Documents lie in ascending order of ``order`` (the id, nulls first, if not
    given), ties in the order they were read; repeated rows are documents of
    their own that share all chunks; texts of any length are encoded whole. An empty
    table makes an empty store. Other columns are not read, whatever their names.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"

    def encode(batches):
        tok, press = word_tokenizer(path), zstandard.ZstdCompressor(level=1)
        for b in batches:
            n, digests, lengths, bodies = [], [], [], []
            for ids, first in tok.ids(b.column(3)):
                texts = np.arange(len(first))
                ends = first + texts  # an end id for each text before
                every = np.full(ends[-1], end_id, kind)
                every[np.arange(len(ids)) + np.repeat(texts[:-1], np.diff(first))] = ids
                for a, z, cut in zip(ends[:-1].tolist(), ends[1:].tolist(), all_cuts(every, ends)):
                    raw = every[a:z].tobytes()
                    places = [0, *cut]
                    n.append(z - a)
                    digests.append(b"".join([digest(raw[x * width : y * width]) for x, y in zip(places, cut)]))
                    lengths.append(np.diff(places).astype("<u4").tobytes())
                    bodies.append(press.compress(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(lengths, pa.binary()), pa.array(bodies, pa.binary())], names=["rid", "doc_id", "ord", "n_tokens", "digests", "lengths", "body"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    keys = order or [F.col(quoted(doc_id))]
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(doc_id)).alias("doc_id"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("ord"), F.col(quoted(text)).cast("string").alias("text"))
    ord_type = source.schema["ord"].dataType.simpleString()
    draft_path = scratch(spark, "draft")
    draft = materialize(source.mapInArrow(in_worker("tokens", encode), f"rid long, doc_id {id_type}, ord {ord_type}, n_tokens long, digests binary, lengths binary, body binary"), draft_path)

    def chunks(batches):
        for b in batches:
            rids, ords, out = [], [], []
            for i, x in enumerate(b.column(2).to_pylist()):
                own = {x[k : k + DIGEST] for k in range(0, len(x), DIGEST)}
                rids += [i] * len(own)
                out += own
            at = pa.array(rids, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.binary())], names=["rid", "ord", "digest"])

    used = draft.select("rid", "ord", "digests").mapInArrow(in_worker("store", chunks), f"rid long, ord {ord_type}, digest binary")
    shared = staged(used.groupBy("digest").agg(F.min("rid").alias("owner"), F.count(F.lit(1)).alias("uses")).where("uses > 1").select("digest", "owner"), "shared")
    marks = used.join(shared, "digest").groupBy("rid").agg(F.first("ord").alias("ord"), F.collect_list("digest").alias("known"), F.collect_list(F.col("owner") == F.col("rid")).alias("mine"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", id_type), ("n_tokens", "long"), ("digests", "binary"), ("lengths", "binary"), ("body", "binary"))]
    documents = draft.select("ord", "rid", F.lit(1).alias("kind"), "doc_id", "n_tokens", "digests", "lengths", "body", F.lit(None).cast("array<binary>").alias("known"), F.lit(None).cast("array<boolean>").alias("mine"))
    rows = documents.unionByName(marks.select("ord", "rid", F.lit(0).alias("kind"), *blank, "known", "mine"))
    ordered = rows.repartitionByRange(partitions(spark), "ord", "rid").sortWithinPartitions("ord", "rid", "kind").withColumn("part", F.spark_partition_id())

    def seal(batches):
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        noted: tuple = (None, {})
        pos = start = 0
        for b in batches:
            out: list[list] = [[] for _ in range(11)]
            names = ("part", "rid", "kind", "doc_id", "n_tokens", "digests", "lengths", "body", "known", "mine")
            for part, rid, what, doc, n, digests, lengths, body, known, mine in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names]):
                if what == 0:
                    noted = (rid, dict(zip(known, mine)))
                    continue
                owns = noted[1] if noted[0] == rid else {}
                addresses = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
                if not owns and len(set(addresses)) == len(addresses):  # all chunks are here, once each: the body stays as it is
                    row = (part, pos, doc, start, n, digests, lengths, [], [], body, root(digests, lengths))
                    for column, value in zip(out, row):
                        column.append(value)
                    pos, start = pos + 1, start + n
                    continue
                pieces = _split(unpress.decompress(body, max_output_size=n * width), np.frombuffer(lengths, "<u4"), width)
                away, lent, here, kept = [], [], set(), []
                for i, (d, piece) in enumerate(zip(addresses, pieces)):
                    if d in here:
                        continue
                    if owns.get(d, True):
                        here.add(d)
                        kept.append(piece)
                        if d in owns:
                            lent.append(i)
                    else:
                        away.append(i)
                row = (part, pos, doc, start, n, digests, lengths, away, lent, press.compress(b"".join(kept)), root(digests, lengths))
                for column, value in zip(out, row):
                    column.append(value)
                pos, start = pos + 1, start + n
            fields = [pa.int32(), pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, fields)], names=["part", "pos", "doc_id", "start", "n_tokens", "digests", "lengths", "away", "lent", "body", "root"])

    ordered.mapInArrow(in_worker("store", seal), RECORD.format(id=id_type)).write.option("compression", "none").parquet(f"{folder}/records")
    remove(spark, draft_path)
    del draft, used, marks, documents, rows, ordered
    release(spark)
    records = spark.read.parquet(f"{folder}/records")
    merkle(records).withColumn("width", F.lit(width)).coalesce(1).write.parquet(f"{folder}/manifest")


def merkle(records: DataFrame) -> DataFrame:
    """part, documents, ids and Merkle root of each part, from the roots of its records."""
    leaves = records.groupBy("part", F.floor(F.col("pos") / FAN_OUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "root"))).alias("x"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"))
    level, nodes = leaves.select("part", "node", "docs", "ids", F.sha2(F.concat(F.lit(b""), F.array_join(F.transform("x", lambda r: F.hex(r["root"])), "").cast("binary")), 256).alias("h")), None
    nodes = level.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("node", "h"))).alias("x"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    return nodes.select("part", "docs", "ids", F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("merkle"))


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (and ``ids``), put together from chunks and verified.

    Raises if a chunk, a recipe or a part does not match its digest or root.
    """
    records = spark.read.parquet(f"{folder}/records")
    manifest = {r.part: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    width = next((r.width for r in manifest.values()), 2)
    base, at = {}, 0
    for p in sorted(manifest):  # as many rows as there are parts
        base[p] = at
        at += manifest[p].ids
    shared = spark.sparkContext.broadcast(base)
    id_type = records.schema["doc_id"].dataType.simpleString()

    def own_pieces(digests, lengths, away, body):
        """Number of chunk -> bytes, of the chunks in the record itself; numbers of away chunks."""
        sizes = np.frombuffer(lengths, "<u4")
        gone, first = set(away), {}
        for i in range(len(sizes)):
            first.setdefault(digests[i * DIGEST : (i + 1) * DIGEST], i)
        kept = [i for i in first.values() if i not in gone]
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(sizes.sum()) * width or 1)
        return sizes, first, dict(zip(kept, _split(raw, sizes[kept], width)))

    def lend(batches):
        for b in batches:
            keys, values = [], []
            for digests, lengths, away, lent, body in zip(*[c.to_pylist() for c in b.columns]):
                _, _, pieces = own_pieces(digests, lengths, away, body)
                keys += [digests[i * DIGEST : (i + 1) * DIGEST] for i in lent]
                values += [pieces[i] for i in lent]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["digest", "chunk"])

    lenders = records.where("size(lent) > 0").select("digests", "lengths", "away", "lent", "body").mapInArrow(in_worker("store", lend), "digest binary, chunk binary")
    borrowers = records.where("size(away) > 0")
    wanted = borrowers.select("part", "pos", F.explode("away").alias("i"), "digests").select("part", "pos", "i", F.expr(f"substring(digests, i * {DIGEST} + 1, {DIGEST})").alias("digest"))
    fetched = wanted.join(lenders, "digest").groupBy("part", "pos").agg(F.collect_list(F.struct("i", "chunk")).alias("fetched"))
    columns = ["part", "pos", "doc_id", "start", "n_tokens", "digests", "lengths", "away", "body", "root"]
    whole = records.where("size(away) = 0").select(*columns, F.lit(None).cast("array<struct<i:int,chunk:binary>>").alias("fetched"))
    mended = borrowers.select(*columns).join(fetched, ["part", "pos"]).select(*columns, "fetched")

    def build(batches):
        for b in batches:
            base, rows = shared.value, []
            for part, pos, doc, start, n, digests, lengths, away, body, own_root, got in zip(*[c.to_pylist() for c in b.columns]):
                sizes, first, pieces = own_pieces(digests, lengths, away, body)
                pieces.update({x["i"]: x["chunk"] for x in got or ()})
                for d, i in first.items():
                    if digest(pieces[i]) != d:
                        raise ValueError(f"chunk {i} of record {part}/{pos} does not match its digest")
                if root(digests, lengths) != own_root:
                    raise ValueError(f"recipe of record {part}/{pos} does not match its root")
                raw = b"".join([pieces[first[digests[i * DIGEST : (i + 1) * DIGEST]]] for i in range(len(sizes))])
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                if len(ids) != 4 * n:
                    raise ValueError(f"record {part}/{pos} has {len(ids) // 4} ids, not {n}")
                rows.append((part, pos, doc, base[part] + start, n, zlib.crc32(ids), own_root, ids if with_ids else None))
            types = [pa.int32(), pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "pos", "doc_id", "start", "n_tokens", "ids_crc32", "root", "ids"])

    built = staged(whole.unionByName(mended).mapInArrow(in_worker("store", build), f"part int, pos long, doc_id {id_type}, start long, n_tokens long, ids_crc32 long, root binary, ids binary"), "built")
    seen = {r.part: r for r in merkle(built).collect()}
    if {p: (r.docs, r.ids, r.merkle) for p, r in seen.items()} != {p: (r.docs, r.ids, r.merkle) for p, r in manifest.items()}:
        raise ValueError("the store does not match its manifest")
    return built.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
