"""N-gram Jaccard join by parity sketches (operator 7).

Two documents link when the Jaccard similarity of their sets of 5-word shingles
is at least 3/4; for set sizes a and b that is a symmetric difference of at most
(a + b) / 7. A parity sketch flips one bit for every shingle, so the Hamming
distance of two sketches never exceeds the symmetric difference. Sizes are dealt
with in bands g (2**g to 2**(g+1) - 1, of the larger set); every band has one wide
sketch of B blocks of 2**32 bits each. It is kept in two forms:

* by blocks: a block's value is the XOR of the codes of its flipped bits. Every
  differing shingle spoils at most one block, so linked documents agree on all
  but D = (a + b) / 7 of their non-empty blocks;
* folded to 2**(g+2) bits: folding a sketch XORs its halves, so distances still
  bound the symmetric difference from below.

1. One pass over the texts gives every row's set size, fingerprint (128 bits) and
   folded sketch, and counts the blocks' values in a sketch of ``CELLS`` cells.
   Rows with equal sets form one class: a group of copies, however large, goes on
   as one set.
2. Pigeonhole join: whatever fixed order the values have, two classes that link
   share one of the first D + 1 of each. The order is by counted cell, rare ones
   first, which keeps the passages, lines and phrases that many documents share
   out of the join. These entries are all that is shuffled, once, into buckets of
   about ``BUCKET`` entries, which are met one at a time. A task meets up to
   ``BUCKETS`` of them, and what they give goes out once: near copies share values
   in most buckets.
3. A value that few classes share gives all their pairs. One that many share (a
   large group of near copies) gives pairs with its most central classes, and all
   are put under the first of those, their hub. A value of more than ``HOT``
   classes is split: its central classes are those of its parts' central classes,
   and each part meets them where it lies.
4. Candidates whose folded sketches are farther apart than D go. What is left is
   verified on whole sets. Links contract into components (hash-to-min with
   pointer jumping).
5. Under each hub, the classes that are not in the hub's component are held
   against all classes under it: by folded sketches first, block against block,
   then on the whole sets of those that come near another. Nothing is capped: a
   pair goes unverified only if it is in one component already, or if sizes,
   blocks or sketches rule it out.

A class with no more than D non-empty blocks could escape the pigeonhole (odds
below one in a million); such classes, if any, are held against all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import FOLD, in_worker, materialize, partitions, quoted, release, remove, scratch, spans, text_bytes, text_slices, with_rows, words_of

WORDS = 5
#: Blocks of a band's sketch for each shingle of the band's upper size, and at least.
BLOCKS, LEAST_BLOCKS = 0.42, 2_048
#: Cells of the count sketch: one byte each in the broadcast, at every size of corpus. They are merged in so many ranges.
CELLS, RANGES = 1 << 22, 64
#: Entries of a bucket, about, at 16 bytes each; and entries that a task holds before it sends them.
BUCKET, HELD = 1_000_000, 1_000_000
#: Buckets that a task meets one after another, unless there are cores for fewer; and rows of its results (16 bytes each) that it holds to send each once.
BUCKETS, MET = 16, 500_000
#: A value of at most so many classes gives all its pairs; a larger one goes by central classes and a hub. Either gives at most CENTRAL + 1 rows for each of its entries.
ALL_PAIRS, CENTRAL = 8, 3
#: A value that is counted more often is in no bucket: its entries stay apart, so many in a row of their table, and meet its central classes in a map.
HOT, HOT_ROW = 1 << 17, 1_024
#: Shingles of a block of classes in step 5, about.
BLOCK = 200_000
#: Rows (16 bytes each) up to which a set of row keys is broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of weak classes' sets that are held against all documents in one pass.
WEAK_BYTES = 16 << 20

_U = np.uint64


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_PLACES = _mix(np.arange(1, WORDS + 1, dtype=np.uint64), 7) | _U(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's 5-word shingles, one text after another, and each text's first place (with the end). Fewer words are one shingle, none an empty set."""
    words = words_of(texts, FOLD)
    h, count = words.hashes(), np.diff(words.first)
    size = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(at[-1], np.uint64)
    full = count >= WORDS
    with np.errstate(over="ignore"):
        if full.any():
            total = h[: len(h) - WORDS + 1] * _PLACES[0]
            for k in range(1, WORDS):
                total += h[k : len(h) - WORDS + 1 + k] * _PLACES[k]
            flat[spans(at[:-1][full], size[full])] = _mix(total[spans(words.first[:-1][full], size[full])])
        for i in np.flatnonzero(~full & (count > 0)).tolist():
            n = int(count[i])
            part = h[words.first[i] : words.first[i + 1]]
            flat[at[i] : at[i + 1]] = _mix((_mix(part, n) * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True), n)
    for a, b in zip(at[:-1][size > 1].tolist(), at[1:][size > 1].tolist()):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[at[:-1][size > 0]] = True
    return flat[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def fingerprints(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set; those of an empty one are 0."""
    size = np.diff(first)
    out = np.zeros((len(size), 2), np.uint64)
    if len(flat):
        with np.errstate(over="ignore"):
            out[size > 0, 0] = np.add.reduceat(_mix(flat, 11), first[:-1][size > 0])
            out[size > 0, 1] = np.add.reduceat(_mix(flat, 12), first[:-1][size > 0]) ^ size[size > 0].astype(np.uint64)
    return out


def difference_bound(n, top):
    """Largest symmetric difference of a set of n with any partner of at most ``top`` that it can link with."""
    return (n + np.minimum(4 * n // 3, top)) // 7


def band(n: np.ndarray) -> np.ndarray:
    """Band g of a set of n: 2**g <= n < 2**(g+1)."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1


def reaches_next(n: np.ndarray) -> np.ndarray:
    """Can a set of n link with one of the next band, which begins within 4/3 n? Then it is in both."""
    return 3 * (np.int64(2) << band(n)) <= 4 * n


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the folded sketch of a set of n: those of the highest band that it is in, 64 at least."""
    return np.maximum(np.int64(4) << (band(n) + reaches_next(n)), 64)


def folded_sketches(flat: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The folded parity sketch of each set."""
    n = np.diff(first)
    bits = np.where(n > 0, widths(n), 0)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(at[:-1], n) + (flat & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64)
    flipped = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    packed = np.packbits(flipped, bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


@np.errstate(over="ignore")
def block_keys(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of the non-empty blocks of the sets' sketches, 56 bits with band and block number mixed in, for each set and band one after another; where they begin (with the end); the set and the band."""
    n = np.diff(first)
    one, two = np.flatnonzero(n > 0), np.flatnonzero((n > 0) & reaches_next(n))
    view = np.concatenate([one, two])
    g = np.concatenate([band(n[one]), band(n[two]) + 1])
    order = np.argsort(view, kind="stable")
    view, g = view[order], g[order]
    s = flat[spans(first[:-1][view], n[view])]
    owner = np.repeat(np.arange(len(view)), n[view])
    blocks = np.maximum(((np.int64(2) << g) * BLOCKS).astype(np.int64), LEAST_BLOCKS).astype(np.uint64)
    block = ((s >> _U(32)) * blocks[owner]) >> _U(32)  # ascending in a sorted set
    edge = np.ones(len(s), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(edge)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(view) + 1, np.int64), view, g
    values = np.bitwise_xor.reduceat(_mix(s & _U(0xFFFFFFFF), 300), begin)
    live = values != 0  # else all its bits flipped back
    begin, values = begin[live], values[live]
    keys = _mix(values ^ _mix((g.astype(np.uint64) << _U(40))[owner[begin]] ^ block[begin], 400)) >> _U(8)
    return keys, np.searchsorted(owner[begin], np.arange(len(view) + 1)), view, g


def bounds(n: np.ndarray, view: np.ndarray, g: np.ndarray) -> np.ndarray:
    """D of each set in each of its bands."""
    return difference_bound(n[view], (np.int64(2) << g) - 1)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(56 - CELLS.bit_length() + 1)).astype(np.int64)


def _signed(x) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(x, np.uint64)).view(np.int64)


def _fresh(prints: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """The non-empty sets that the task has not seen, each once."""
    out = []
    for i, (p, k) in enumerate(zip(prints[:, 0].tolist(), n.tolist())):
        if k and p not in seen:
            seen.add(p)
            out.append(i)
    return np.array(out, np.int64)


def _only(flat: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[some]
    return flat[spans(first[:-1][some], n)], np.concatenate([[0], np.cumsum(n)])


SETS = "doc_id {id}, key struct<f:long,r:long>, n long, f1 long, node binary, sketch binary, weak boolean, cells int, counts binary"


def _sets(docs: DataFrame, id_type: str) -> DataFrame:
    """Step 1: of every row its id, key, set size, fingerprint (node, and f1, its first half), folded sketch, and whether it could escape the pigeonhole; and rows with counted cells."""
    none = pa.nulls

    def run(batches):
        cells, seen, kinds = np.zeros(CELLS, np.uint32), set(), []
        for batch in batches:
            at, kinds = 0, [batch.column(0).type, batch.column(1).type]
            for part in text_slices(batch.column(2)):
                flat, first = shingle_sets(part)
                n, prints = np.diff(first), fingerprints(flat, first)
                keys, edges, view, g = block_keys(flat, first)
                weak = np.zeros(len(n), bool)
                weak[view[np.diff(edges) <= bounds(n, view, g)]] = True
                some = np.zeros(len(n), bool)
                some[_fresh(prints, n, seen)] = True
                cells += np.bincount(_cell(keys[np.repeat(some[view], np.diff(edges))]), minlength=CELLS).astype(np.uint32)
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(n), pa.array(_signed(prints[:, 0])), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(folded_sketches(flat, first), pa.binary()), pa.array(weak), none(k, pa.int32()), none(k, pa.binary())],
                    names=["doc_id", "key", "n", "f1", "node", "sketch", "weak", "cells", "counts"],
                )
                at += k
        press = zstandard.ZstdCompressor(level=1)
        if cells.any():
            counts = [press.compress(x.tobytes()) for x in np.split(cells, RANGES)]
            kinds += [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*[none(RANGES, t) for t in kinds], pa.array(range(RANGES), pa.int32()), pa.array(counts, pa.binary())], names=["doc_id", "key", "n", "f1", "node", "sketch", "weak", "cells", "counts"])

    return docs.select("doc_id", "_key", "text").mapInArrow(in_worker("shingles", run), SETS.format(id=id_type))


def _ranks(counted: DataFrame) -> np.ndarray:
    """For each cell the logarithm of its count, in eighths, as one byte."""

    def add(batches):
        unpress, total = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = np.frombuffer(unpress.decompress(x), np.uint32)
                total[r] = total[r] + counts if r in total else counts.astype(np.uint64)
        ranks = [np.minimum(np.rint(8 * np.log2(1 + x.astype(np.float64))), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["cells", "ranks"])

    out = np.zeros(CELLS, np.uint8)
    for r in counted.repartitionById(RANGES, F.col("cells")).mapInArrow(in_worker("count", add), "cells int, ranks binary").collect():
        out[r.cells * (CELLS // RANGES) : (r.cells + 1) * (CELLS // RANGES)] = np.frombuffer(r.ranks, np.uint8)
    return out


_ENTRY = np.dtype([("key", "<u4"), ("f1", "<u8"), ("code", "<u4")])
PAIR, HUB = 0, 1


def _codes(n: np.ndarray, central: np.ndarray) -> np.ndarray:
    """Set size (sixteenths of its logarithm, rounded down) and centrality (the upper bits of a float) in 32 bits."""
    size = np.minimum(16 * np.log2(np.maximum(n, 1)), 255).astype(np.uint32)
    return (size << np.uint32(24)) | (central.astype(np.float32).view(np.uint32) >> np.uint32(7))


def hot_code(hot: int) -> int:
    """The rank of a cell that counts more than ``hot``."""
    return math.ceil(8 * math.log2(1 + hot))


def _entries(docs: DataFrame, ranks: np.ndarray, n_buckets: int, hot: int = HOT) -> DataFrame:
    """Step 2: (bucket, value, packed entries) of the D + 1 rarest blocks of every class. Entries of a hot value are in rows of that value alone, with bucket -1."""
    shared, code_of_hot = docs.sparkSession.sparkContext.broadcast(ranks), hot_code(hot)

    def send(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        bucket, value, entries = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((value, bucket))
        bucket, value, entries = bucket[order], value[order], entries[order]
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(fresh)
        inside = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        fresh |= (bucket < 0) & (inside % HOT_ROW == 0)
        edges = np.append(np.flatnonzero(fresh), len(bucket))
        for low in range(0, len(edges) - 1, 4096):
            cut = edges[low : low + 4097].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int64()), pa.array(value[cut[:-1]], pa.int64()), pa.array([entries[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "value", "entries"])

    def run(batches):
        rank, seen, held, size = shared.value, set(), [], 0
        for batch in batches:
            for part in text_slices(batch.column(0)):
                flat, first = shingle_sets(part)
                prints = fingerprints(flat, first)
                some = _fresh(prints, np.diff(first), seen)
                flat, first = _only(flat, first, some)
                n = np.diff(first)
                keys, edges, view, g = block_keys(flat, first)
                if not len(keys):
                    continue
                code = rank[_cell(keys)]
                solid = np.diff(edges) > 0
                central = np.zeros(len(view))
                central[solid] = np.add.reduceat(np.exp2(code / 8), edges[:-1][solid])
                keys = (code.astype(np.uint64) << _U(56)) | keys
                take = np.minimum(bounds(n, view, g) + 1, np.diff(edges))
                for a, b, k in zip(edges[:-1].tolist(), edges[1:].tolist(), take.tolist()):
                    if k < b - a:
                        keys[a:b].partition(k)
                keys = keys[spans(edges[:-1], take)]
                entries = np.empty(len(keys), _ENTRY)
                entries["key"] = (keys >> _U(24)) & _U(0xFFFFFFFF)
                entries["f1"] = np.repeat(prints[some[view], 0], take)
                entries["code"] = np.repeat(_codes(n[view], central), take)
                alone = keys >> _U(56) >= _U(code_of_hot)
                bucket = np.where(alone, -1, (((keys & _U(0xFFFFFF)) * _U(n_buckets)) >> _U(24)).astype(np.int64))
                held.append((bucket, np.where(alone, (keys & _U((1 << 56) - 1)).astype(np.int64), 0), entries))
                size += len(entries)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return docs.select("text").mapInArrow(in_worker("shingles", run), "bucket long, value long, entries binary")


def _rows(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(_signed(b)), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])


def _once(rows: np.ndarray) -> np.ndarray:
    """The distinct rows of two f1, in order."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[fresh]


def meet(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 3, of one bucket: candidate pairs, and classes under their hubs, as rows of two f1."""
    keys, f1 = entries["key"], entries["f1"]
    order = np.lexsort((f1, keys))
    keys, f1, code = keys[order], f1[order], entries["code"][order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (f1[1:] != f1[:-1])  # copies from other tasks count once
    keys, f1, code = keys[fresh], f1[fresh], code[fresh]
    size, central = (code >> np.uint32(24)).astype(np.int64), code & np.uint32(0xFFFFFF)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    many = np.diff(edges)
    left, right, under = [], [], []
    for k in np.unique(many[(many > 1) & (many <= ALL_PAIRS)]).tolist():
        start = edges[:-1][many == k]
        i, j = np.triu_indices(k, 1)
        left.append((start[:, None] + i).ravel())
        right.append((start[:, None] + j).ravel())
    for lo, hi in zip(edges[:-1][many > ALL_PAIRS].tolist(), edges[1:][many > ALL_PAIRS].tolist()):
        first = lo + np.lexsort((f1[lo:hi], -central[lo:hi].astype(np.int64)))[:CENTRAL]
        left.append(np.repeat(first, hi - lo))
        right.append(np.tile(np.arange(lo, hi), CENTRAL))
        under.append(np.stack([np.repeat(f1[first[0]], hi - lo), f1[lo:hi]], 1))
    pairs = hubs = np.empty((0, 2), np.uint64)
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        # 4/3 is 6.6 sixteenths of an octave; what the rounding lets through, the sketches see.
        fit = (f1[i] != f1[j]) & (np.abs(size[i] - size[j]) <= 7)
        pairs = _once(np.sort(np.stack([f1[i[fit]], f1[j[fit]]], 1), 1))
    if under:
        hubs = _once(np.concatenate(under))
    return pairs, hubs


def meet_each(batches):
    """``meet`` for the buckets of a task, whose rows (bucket, entries) come in their order: batches of (a, b, kind). Rows that several buckets give are held back to go out once; when there are many different ones, they go out and others are held."""
    held, now, found = [], None, {PAIR: [], HUB: []}

    def out(kind):
        rows = _once(np.concatenate(found[kind])) if found[kind] else ()
        found[kind] = []
        for low in range(0, len(rows), 100_000):
            yield _rows(rows[low : low + 100_000, 0], rows[low : low + 100_000, 1], kind)

    def add(entries):
        for kind, rows in zip((PAIR, HUB), meet(np.frombuffer(b"".join(entries), _ENTRY))):
            found[kind].append(rows)
            if sum(map(len, found[kind])) >= MET:
                found[kind] = [_once(np.concatenate(found[kind]))]
                if 2 * len(found[kind][0]) >= MET:
                    yield from out(kind)

    for batch in batches:
        for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and held:
                yield from add(held)
                held = []
            now = bucket
            held.append(x)
    if held:
        yield from add(held)
    yield from out(PAIR)
    yield from out(HUB)


def _met(entries: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (a, b, kind) of f1: candidate pairs (PAIR) and classes b under a hub a (HUB)."""
    # Shuffle partitions may grow with the input, and with them how often a pair goes out; cores do not.
    tasks = min(n_buckets, max(2 * entries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_buckets / BUCKETS)))
    # Neighbouring buckets lie in one task; there are as many in each, but for one.
    dealt = entries.select("bucket", "entries").repartitionById(tasks, F.expr(f"bucket * {tasks} div {n_buckets}").cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(in_worker("meet", meet_each), "a long, b long, kind int").distinct()


def _hot_met(entries: DataFrame) -> DataFrame:
    """``_met`` for rows of hot values, in two rounds: the central classes of each value out of those of its rows, then every row against them, where it lies."""

    def central(batches):
        for batch in batches:
            values, f1, rank, size = [], [], [], []
            for value, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = np.frombuffer(x, _ENTRY)
                e = e[np.unique(e["f1"], return_index=True)[1]]
                e = e[np.argsort(-(e["code"] & np.uint32(0xFFFFFF)).astype(np.int64), kind="stable")[:CENTRAL]]
                values += [value] * len(e)
                f1.append(_signed(e["f1"]))
                rank.append((e["code"] & np.uint32(0xFFFFFF)).astype(np.int64))
                size.append((e["code"] >> np.uint32(24)).astype(np.int64))
            columns = [np.concatenate([np.empty(0, np.int64), *x]) for x in (f1, rank, size)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), *map(pa.array, columns)], names=["value", "f1", "central", "size"])

    # A row for each row of entries and central class; a value's are its entries by HOT_ROW.
    parts = entries.select("value", "entries").mapInArrow(in_worker("meet", central), "value long, f1 long, central long, size long")
    order = Window.partitionBy("value").orderBy(F.desc("central"), F.col("f1").bitwiseXOR(F.lit(-(1 << 63))))  # as unsigned
    best = parts.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTRAL)
    tops = best.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("place", "f1", "size"))).alias("tops"))

    def run(batches):
        for batch in batches:
            for x, tops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = np.frombuffer(x, _ENTRY)
                e = e[np.unique(e["f1"], return_index=True)[1]]
                f1, size = e["f1"], (e["code"] >> np.uint32(24)).astype(np.int64)
                for top in tops:
                    c = np.int64(top["f1"]).astype(np.uint64)
                    fit = (f1 != c) & (np.abs(size - top["size"]) <= 7)
                    yield _rows(np.minimum(f1[fit], c), np.maximum(f1[fit], c), PAIR)
                yield _rows(np.full(len(f1), np.int64(tops[0]["f1"]).astype(np.uint64)), f1, HUB)

    few = F.broadcast(tops) if tops.count() <= BROADCAST_ROWS else tops
    return entries.join(few, "value").select("entries", "tops").mapInArrow(in_worker("meet", run), "a long, b long, kind int").distinct()


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 4: the pairs (a, b) whose folded sketches are no farther apart than linked classes' can be."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (na, nb), sides = (batch.column(i).to_numpy() for i in (2, 3)), [text_bytes(batch.column(i)) for i in (4, 5)]
            keep = np.zeros(batch.num_rows, bool)
            (xa, ea), (xb, eb) = sides
            la, lb = np.diff(ea), np.diff(eb)
            for u, v in np.unique(np.stack([la, lb], 1), axis=0).tolist():
                every = np.flatnonzero((la == u) & (lb == v))
                for low in range(0, len(every), max(1, (4 << 20) // max(u, v))):
                    at = every[low : low + max(1, (4 << 20) // max(u, v))]
                    a = xa[ea[at][:, None] + np.arange(u)].view(np.uint64)
                    b = xb[eb[at][:, None] + np.arange(v)].view(np.uint64)
                    words = min(u, v) >> 3
                    keep[at] = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(1, dtype=np.int64) <= (na[at] + nb[at]) // 7
            keep &= 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("f1").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(in_worker("near", run), "a long, b long").distinct()


def _values(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node (fingerprint), f1, n and whole set of the wanted classes, made from the text of one row each."""
    chosen = classes.join(wanted.select("f1").distinct(), "f1", "left_semi").select("key")
    right = F.broadcast(chosen) if wanted.count() <= BROADCAST_ROWS else chosen
    picked = docs.join(right, docs["_key"] == right["key"], "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch.column(0)):
                flat, first = shingle_sets(part)
                prints = fingerprints(flat, first)
                sets = [flat[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(_signed(prints[:, 0])), pa.array(np.diff(first)), pa.array(sets, pa.binary())], names=["node", "f1", "n", "shingles"])

    return picked.mapInArrow(in_worker("shingles", run), "node binary, f1 long, n long, shingles binary")


def _verified(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of f1, the links between nodes: 100 * intersection >= 75 * union, on whole sets."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left = values.select(F.col("f1").alias("a"), F.col("node").alias("x"), F.col("shingles").alias("sx"))
    right = values.select(F.col("f1").alias("b"), F.col("node").alias("y"), F.col("shingles").alias("sy"))
    joined = pairs.join(left, "a").join(right, "b").select("x", "y", "sx", "sy").where("x <> y")
    return joined.mapInArrow(in_worker("verify", run), "x binary, y binary")


class Tables:
    """Scratch tables of one job by name. A table of a name replaces the one before; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, name)
        out = materialize(df, path)
        del df
        release(self.spark)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        remove(self.spark, *[self.paths.pop(x) for x in names if x in self.paths])


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, label): the smallest node reachable by links, by hash-to-min with pointer jumping over tables in the shared folder."""
    edges = tables.put("edges", links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).distinct())
    now = tables.put("jump", edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = edges.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        stepped = now.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = tables.put("jump", stepped.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        now = jumped.select("node", "label")
        if jumped.where("label <> was").limit(1).count() == 0:
            tables.drop("edges")
            return now


def block_links(minors: list[tuple], members: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links between two lists of (node, label, shingles), but for those between nodes that labels or links before them already join."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    flat = np.concatenate([m[2] for m in minors])
    owner = np.repeat(np.arange(len(minors)), [len(m[2]) for m in minors])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(m[2]) for m in minors])
    out = []
    for node, label, shingles in members:
        low, high = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
        both = np.bincount(owner[spans(low, high - low)], minlength=len(minors))
        for k in np.flatnonzero(100 * both >= 75 * (size + len(shingles) - both)).tolist():
            a, b = find(label), find(minors[k][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((minors[k][0], node))
    return out


def near_by_sketch(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of two lists of (n, label, sketch), which of each come near one of the other list with another label."""
    hit = np.zeros(len(left), bool), np.zeros(len(right), bool)
    number: dict = {}

    def by_width(rows):
        out: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            out.setdefault(len(r[2]), []).append(i)
        return {w: (np.array(at), np.array([rows[i][0] for i in at]), np.array([number.setdefault(rows[i][1], len(number)) for i in at]), np.frombuffer(b"".join(rows[i][2] for i in at), np.uint64).reshape(len(at), -1)) for w, at in out.items()}

    a, b = by_width(left), by_width(right)
    for u, (i, n, label, x) in a.items():
        for v, (j, m, other, y) in b.items():
            if max(u, v) > 4 * min(u, v):  # sizes of linked sets are alike
                continue
            words = min(u, v) >> 3
            x2, y2 = folded(x, words), folded(y, words)
            step = max(1, (1 << 20) // (len(j) * words))
            for low in range(0, len(i), step):
                at = slice(low, low + step)
                far = np.bitwise_count(x2[at][:, None] ^ y2[None]).sum(2, dtype=np.int64)
                p, q = n[at][:, None], m[None]
                near = (far <= (p + q) // 7) & (4 * np.minimum(p, q) >= 3 * np.maximum(p, q)) & (label[at][:, None] != other[None])
                hit[0][i[at]] |= near.any(1)
                hit[1][j] |= near.any(0)
    return hit


def _contracted(links: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """Labels after further links, which matter only between components: one edge for each pair of them."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    ends = links.join(name("x"), "x", "left").join(name("y"), "y", "left").select(F.coalesce("lx", "x").alias("p"), F.coalesce("ly", "y").alias("q"))
    between = tables.put("between", ends.where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
    if between.limit(1).count() == 0:
        return labels
    every = labels.union(links.select("x", "x").union(links.select("y", "y")).distinct().toDF("node", "label").join(labels.select("node"), "node", "left_anti").select("node", "label"))
    # Nodes without a link before have no label yet and are their own.
    every = tables.put("before", every)
    joined = components(between, tables).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    return tables.put("labels", every.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label")))


def _under_hubs(docs: DataFrame, hubs: DataFrame, labels: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame | None:
    """Step 5: links of the classes under a hub that are not in its component with any class under it; None if there are no such classes."""
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df  # noqa: E731  hubs are few beside the classes under them
    named = classes.select("f1", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = hubs.select(F.col("a").alias("f1")).distinct().join(named, "f1").groupBy("f1").agg(F.min("label").alias("main"))
    heads = tables.put("heads", own.withColumnRenamed("f1", "a"))
    placed = hubs.join(named.withColumnRenamed("f1", "b"), "b").join(few(heads), "a").select("a", "b", "node", "label", "n", (F.col("label") != F.col("main")).alias("minor"))
    placed = tables.put("placed", placed)
    load = placed.groupBy("a").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("minor"), F.col("n"))).alias("some")).where("some IS NOT NULL")
    cut = tables.put("cut", load.select("a", F.ceil(F.col("some") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns")))
    if cut.limit(1).count() == 0:
        return None
    every = placed.join(few(cut), "a").join(classes.select("node", "sketch"), "node")
    spread = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    across = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    columns = ["a", "b", "node", "label", "n", "sketch"]
    left = every.where("minor").select(*columns, spread("rows").alias("i"), across("columns").alias("j")).withColumn("side", F.lit(0))
    right = every.select(*columns, spread("columns").alias("j"), across("rows").alias("i")).withColumn("side", F.lit(1)).select(left.columns)

    def sift(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        rows = [[*zip(*(table.column(c).take(pa.array(x)).to_pylist() for c in ("n", "label", "sketch")))] for x in at]
        hit = near_by_sketch(*rows) if all(rows) else (np.zeros(len(x), bool) for x in at)
        return table.select(["a", "i", "j", "side", "b", "node", "label"]).take(pa.array(np.concatenate([x[h] for x, h in zip(at, hit)])))

    sifted = left.union(right).groupBy("a", "i", "j").applyInArrow(in_table("sift", sift), "a long, i int, j int, side int, b long, node binary, label binary")
    sifted = tables.put("sifted", sifted)
    sets = tables.put("values", _values(docs, classes, sifted.select(F.col("b").alias("f1")).distinct())).dropDuplicates(["node"]).select("node", "shingles")

    def link(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for side, node, label, shingles in zip(*[table.column(c).to_pylist() for c in ("side", "node", "label", "shingles")]):
            sides[side].append((node, label, np.frombuffer(shingles, np.uint64)))
        found = block_links(*sides) if sides[0] and sides[1] else []
        return pa.table({"x": pa.array([f[0] for f in found], pa.binary()), "y": pa.array([f[1] for f in found], pa.binary())})

    full = sifted.join(sets, "node").select("a", "i", "j", "side", "node", "label", "shingles")
    return full.groupBy("a", "i", "j").applyInArrow(in_table("link", link), "x binary, y binary")


def in_table(kind: str, run):
    """``run`` for applyInArrow, with the caches of other operators gone."""

    def task(table: pa.Table) -> pa.Table:
        return next(in_worker(kind, lambda x: iter([run(x)]))(table))

    return task


def _weak_links(docs: DataFrame, values: DataFrame, tables: Tables) -> DataFrame | None:
    """Links of the (next to never any) weak classes with whatever document passes the similarity: their sets in blocks of ``WEAK_BYTES``, each against all documents in one pass."""
    out, block, size = None, [], 0

    def against(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            nodes = [x for x, _ in shared.value]
            sets = [np.frombuffer(s, np.uint64) for _, s in shared.value]
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(flat, kind="stable")
            flat, owner, sizes = flat[order], owner[order], np.array([len(s) for s in sets])
            for batch in batches:
                for part in text_slices(batch.column(0)):
                    s, first = shingle_sets(part)
                    n, prints = np.diff(first), fingerprints(s, first)
                    low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    doc = np.repeat(np.repeat(np.arange(len(n)), n), high - low)
                    pair, both = np.unique(doc * len(sets) + owner[spans(low, high - low)], return_counts=True)
                    d, w = pair // len(sets), pair % len(sets)
                    fit = 100 * both >= 75 * (n[d] + sizes[w] - both)
                    rows = [(nodes[j], prints[i].tobytes()) for i, j in zip(d[fit].tolist(), w[fit].tolist())]
                    rows = [r for r in rows if r[0] != r[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["x", "y"])

        return tables.put(f"weak{len(tables.paths)}", docs.select("text").mapInArrow(in_worker("shingles", run), "x binary, y binary").distinct())

    for r in values.toLocalIterator():
        block.append((bytes(r.node), bytes(r.shingles)))
        size += len(r.shingles)
        if size >= WEAK_BYTES:
            out = against(block) if out is None else out.union(against(block))
            block, size = [], 0
    if block:
        out = against(block) if out is None else out.union(against(block))
    return out


def _grouped(docs: DataFrame, text: str, tables: Tables, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and for each class its component's label and its first row: that with the smallest id, ids that are null last."""
    spark = docs.sparkSession
    keyed, path = with_rows(docs.select("doc_id", F.col(quoted(text)).cast("string").alias("text")), "_key")
    if path:
        tables.paths["rows"] = path
    passed = tables.put("sets", _sets(keyed, docs.schema["doc_id"].dataType.simpleString()))
    sets = passed.where("cells IS NULL").drop("cells", "counts")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("r")
    grouped = sets.where("n > 0").groupBy("node", "f1").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("weak").alias("weak"))
    classes = tables.put("classes", grouped.select("node", "f1", "n", "sketch", "weak", "r.none", "r.doc_id", "r.key"))
    ranks = _ranks(passed.where("cells IS NOT NULL").select("cells", "counts"))
    # A class has some 0.29 entries for each shingle, in one band or two.
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(partitions(spark), math.ceil(0.42 * total / BUCKET))
    entries = _entries(keyed, ranks, n_buckets, hot)
    if (ranks >= hot_code(hot)).any():  # entries are read three times then
        entries = tables.put("entries", entries)
        tops = tables.put("hot", _hot_met(entries.where("bucket < 0").select("value", "entries")))
        met = tables.put("met", _met(entries.where("bucket >= 0"), n_buckets).union(tops).distinct())
        tables.drop("entries", "hot")
    else:
        met = tables.put("met", _met(entries, n_buckets))
    near = tables.put("near", _near(met.where(F.col("kind") == PAIR).select("a", "b"), classes))
    values = tables.put("values", _values(keyed, classes, near.select(F.explode(F.array("a", "b")).alias("f1")).distinct()))
    links = _verified(near, values)
    if classes.where("weak").limit(1).count():
        links = links.union(_weak_links(keyed, _values(keyed, classes, classes.where("weak").select("f1")).dropDuplicates(["node"]), tables))
    labels = tables.put("labels", components(tables.put("links", links), tables))
    tables.drop("near", "values", "links", "jump")
    hubs = met.where(F.col("kind") == HUB).select("a", "b")
    if hubs.limit(1).count() and (further := _under_hubs(keyed, hubs, labels, classes, tables)) is not None:
        labels = _contracted(tables.put("links", further), labels, tables)
    tables.drop("met", "heads", "placed", "cut", "sifted", "values", "links", "between", "before", "jump")
    return sets, classes.select("node", "none", "doc_id", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, ``n_shingles``, ``component_id`` (smallest id reachable by links) of every row.

    Null and empty texts have empty sets and are alone; texts of any length go
    in whole. Repeated rows are in one component. A row with a null id takes part
    in links; its component's id is the smallest id in it that is not null, null
    if there is none. An empty table gives an empty result. Columns besides
    ``doc_id`` (of any ordered type) and the text are not read, whatever their
    names.
    """
    tables = Tables(docs.sparkSession)
    sets, grouped = _grouped(docs, text, tables, hot)
    tables.drop("rows")
    heads = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(heads, "label").select("node", "component_id")
    # A class of very many copies is one key of this join, whose large partitions Spark splits.
    found = sets.join(by_class, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns.

    First is the row with the smallest id; null ids come last, ties go by the
    row's place in its file. Rows are told apart by that place, not by id: rows
    that share an id but not a text are not copies. Null and empty texts are
    alone and stay, each of their rows.
    """
    tables = Tables(docs.sparkSession)
    name = "_key"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    keyed, path = with_rows(docs, name)
    source = docs.sparkSession.read.schema(docs.schema).parquet(path) if path else docs
    sets, grouped = _grouped(source, text, tables)
    heads = grouped.groupBy("label").agg(F.min(F.struct("none", "doc_id", "key")).alias("head"))
    by_class = grouped.join(heads, "label").select("node", F.col("head.key").alias("head"))
    gone = tables.put("gone", sets.where("n > 0").join(by_class, "node").where("key <> head").select("key"))
    tables.drop("sets", "classes", "labels", "rows")
    right = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return keyed.join(right, keyed[name] == right["key"], "left_anti").select(*[keyed[quoted(c)] for c in docs.columns])
