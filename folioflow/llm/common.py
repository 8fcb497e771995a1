"""What the training-data operators share: scratch tables, Arrow mapping, words."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.sources.scratch import remove, scratch  # noqa: F401  for the operators

# ---------------------------------------------------------------- scratch tables


#: Options of Parquet for rows of megabytes: a row group, which writers and readers hold whole, has at most two. By default sizes are looked at after 100 rows first, and count as compressed.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.row.count.limit": 2, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, path: str, **options) -> DataFrame:
    """Write df as Parquet and read it back: a cut of the lineage that survives lost executors."""
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; shuffle files of plans that ended before are let go."""
    spark = df.sparkSession
    out = materialize(df, scratch(spark, name))
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have the driver drop the shuffle files of plans that nobody holds any more, instead of at its next chance collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key() -> Column:
    """What names a row of a Parquet table: its file and its place in it."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, str | None]:
    """docs with a key for each row, and the folder that it had to be written to if it is no table of files."""
    try:
        return docs.withColumn(name, row_key()), None
    except AnalysisException:
        path = scratch(docs.sparkSession, "rows")
        return materialize(docs, path).withColumn(name, row_key()), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow mapping


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


_worker: dict = {"kind": None, "caches": {}}


def _trim() -> None:
    """Give freed memory back to the system, so that a reused worker does not hold what a stage before needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_worker(kind: str, run: Callable) -> Callable:
    """``run`` as a task's function over Arrow batches. Python workers outlive tasks: caches of another ``kind`` go when it begins."""

    @wraps(run)
    def task(batches):
        if _worker["kind"] != kind:
            _worker.update(kind=kind, caches={})
            gc.collect()
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def worker_cache(key, make: Callable):
    """What ``make`` gives, held by the worker for the tasks of one kind that follow each other."""
    caches = _worker["caches"]
    if key not in caches:
        caches[key] = make()
    return caches[key]


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    compute: Callable[[Iterator[list[pa.Array]]], Iterator[tuple[list[pa.Array], pa.Array | None]]],
    carry: list[str] | None = None,
    kind: str = "columns",
) -> DataFrame:
    """Run ``compute`` over Arrow batches and append its columns, without a shuffle.

    ``compute`` gets an iterator of the input columns of each batch and yields,
    for each batch, the new columns and optionally a Boolean mask of rows to keep.
    The columns in ``carry`` (all, if None) travel through as one struct, so that
    a name which the new columns also use does not clash; it is flattened again
    by the caller with ``_row.*``. An input that is carried is read out of the
    struct: nothing goes to Python twice.
    """
    names = df.columns if carry is None else carry
    row = F.struct(*[df[quoted(c)].alias(c) for c in names]) if names else F.struct(F.lit(None).cast("int").alias("_"))
    alone = [c for c in dict.fromkeys(inputs) if c not in names]
    picked = df.select(row.alias("_row"), *[df[quoted(c)].alias(f"_in{i}") for i, c in enumerate(alone)])
    schema = T.StructType([picked.schema["_row"], *fields])
    types = [arrow_type(f.dataType) for f in fields]
    labels = ["_row", *[f.name for f in fields]]
    places = [(0, names.index(c)) if c in names else (1 + alone.index(c), None) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, source = itertools.tee(batches)
        columns_of = ([b.column(i) if k is None else b.column(i).field(k) for i, k in places] for b in source)
        for batch, (columns, mask) in zip(kept, compute(columns_of)):
            arrays = [batch.column(0), *[c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]]
            out = pa.RecordBatch.from_arrays(arrays, names=labels)
            yield out.filter(mask) if mask is not None else out

    return picked.mapInArrow(in_worker(kind, run), schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] to first[i] + size[i] - 1 of every i, one after another."""
    before = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    return np.repeat(np.asarray(first, np.int64) - before, size) + np.arange(int(size.sum()) if len(size) else 0)


def task_id() -> tuple[int, int]:
    """(partition, attempt) of the running task."""
    c = TaskContext.get()
    return (c.partitionId(), c.taskAttemptId()) if c else (0, 0)


# ---------------------------------------------------------------- words

#: ASCII folded to lower case, all that is neither alphanumeric nor beyond ASCII turned into blanks; folding alone.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM, FOLD = np.frombuffer(_ALNUM, np.uint8), np.frombuffer(_FOLD, np.uint8)
#: Bytes that are not ASCII white space.
SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[pa.Array]:
    """The column in parts of at most ``most`` bytes of text; a longer text is a part of its own. What is made of a part is bounded by it."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield column.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one array, and each text's first byte in it (with the end). A null text has none."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    texts = pc.fill_null(texts.cast(pa.large_binary() if wide else pa.binary()), b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if not n or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(solid: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places, which end where a text does."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


@dataclass
class Words:
    """The words of a slice of texts: ``data`` (bytes), where each word begins and ends in it, and each text's first word and first byte (with the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    bytes: np.ndarray

    def some(self, places: np.ndarray) -> Words:
        """Only the words at ascending places."""
        return Words(self.data, self.start[places], self.end[places], np.searchsorted(places, self.first), self.bytes)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: tabulation up to ``TABLED`` bytes, a digest beyond."""
        size = self.end - self.start
        out = np.empty(len(size), np.uint64)
        for low in range(0, len(size), AT_ONCE):
            part = slice(low, low + AT_ONCE)
            tabled = np.minimum(size[part], TABLED)
            first = np.cumsum(tabled) - tabled
            place = spans(self.start[part], tabled)
            inside = np.arange(len(place)) - np.repeat(first, tabled)
            out[part] = np.bitwise_xor.reduceat(_tables()[(inside << 8) | self.data[place]], first)
        for i in np.flatnonzero(size > TABLED).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return out


#: Words that are hashed at once.
AT_ONCE = 1 << 18
#: Bytes of a word that its tabulation hash has tables for.
TABLED = 48


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_917)).integers(0, 1 << 64, TABLED << 8, np.uint64)


def words_of(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """What stands between ASCII white space once every byte went through ``table``."""
    raw, at = text_bytes(texts)
    data = raw if table is None else table[raw]
    start, end = runs(SOLID[data], at)
    return Words(data, start, end, np.searchsorted(start, at), at)


class SortedCache:
    """Arrays by 64-bit key, looked up for many keys at once; beyond ``limit`` keys only those of the last lookup stay."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys, self.at, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, keys: np.ndarray, make: Callable[[np.ndarray], list[bytes]], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, first places, sizes) of the values of distinct sorted keys. ``make`` gives the missing ones' values (little-endian unsigned 32-bit integers), of which those in ``held`` stay."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        if len(missing):
            values = make(missing)
            lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
            pool = np.concatenate([self.pool, np.frombuffer(b"".join(values), "<u4")])
            at[missing], size[missing] = len(self.pool) + np.cumsum(lengths) - lengths, lengths
            if len(self.keys) + len(missing) > self.limit:
                stays = np.flatnonzero(held)[: self.limit]
                self.keys, self.size = keys[stays], size[stays]
                self.at = np.cumsum(self.size) - self.size
                self.pool = pool[spans(at[stays], self.size)]
            else:
                new = missing[held[missing]]
                spot = np.searchsorted(self.keys, keys[new])
                self.keys, self.at, self.size = np.insert(self.keys, spot, keys[new]), np.insert(self.at, spot, at[new]), np.insert(self.size, spot, size[new])
                self.pool = pool if held[missing].all() else self._packed(pool)
            return pool, at, size
        return self.pool, at, size

    def _packed(self, pool: np.ndarray) -> np.ndarray:
        """The pool without what is not held."""
        out = pool[spans(self.at, self.size)]
        self.at = np.cumsum(self.size) - self.size
        return out


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie; only their name is fixed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, else None."""
    if m := re.match(r"file:/*(/.*)", uri):
        return m[1]
    return uri if re.match(r"/", uri) else None


def open_for_write(uri: str):
    """A binary output stream in shared storage, local mount or any store that pyarrow knows."""
    if p := local_path(uri):
        os.makedirs(os.path.dirname(p), exist_ok=True)
        return open(p, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_for_read(uri: str):
    """A seekable binary input in shared storage."""
    if p := local_path(uri):
        return open(p, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
