"""A record log: records that outlive the task that made them (SNK02, EXT01, section 2.17).

Each record is a paid call's answer, so the log makes the call itself: rows that
come in are worked on one by one, and what comes out is appended to the task's own
file and flushed before the next row is taken. Nothing is read from the log but
what a manifest names, and a manifest appears in one step when all tasks have
ended, so that no reader sees half a write.

* A task that runs again takes over what its earlier attempts have flushed, and
  works on the other rows only.
* A write that failed leaves its files. ``recover`` takes their records into the
  log, each key once, and the next run works on the keys that are still missing.
* A micro-batch that is replayed has the manifest of the same number, and replaces it.

One writer at a time holds a log. Layout: ``data/<write>/<batch>/<partition>/<attempt>-<segment>.jsonl``
and ``manifests/<write>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Records of a file, at most. Stores that show a file only when it is closed keep whole files.
SEGMENT = 1_000


class Store:
    """Files under a folder of any store that pyarrow knows: a local mount, HDFS, an object store."""

    def __init__(self, uri: str):
        self.files, self.root = fs.FileSystem.from_uri(uri)

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self._at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def create(self, name: str):
        self.files.create_dir(self._at(name.rpartition("/")[0]), recursive=True)
        return self.files.open_output_stream(self._at(name))

    def read(self, name: str) -> bytes:
        with self.files.open_input_stream(self._at(name)) as f:
            return f.read()

    def put(self, name: str, content: bytes) -> None:
        """A file that is there whole or not at all."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        with self.create(draft) as f:
            f.write(content)
        self.files.move(self._at(draft), self._at(name))

    def all_under(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self._at(folder), allow_not_found=True, recursive=True))
        return sorted(f.path[len(self.root) :].lstrip("/") for f in found if f.is_file)

    def remove(self, name: str) -> None:
        self.files.delete_file(self._at(name))


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    records: int = 0


@dataclass
class _Work:
    """What a task does, whether in a batch or in a stream."""

    uri: str
    keys: list[str]
    write_id: str
    make_work: Callable[[], Callable[[dict], dict]] | None
    segment: int

    def earlier(self, store: Store, folder: str) -> Iterator[str]:
        """Whole lines that attempts before this one have flushed; a line without its end was torn off."""
        for name in store.names(folder):
            for line in store.read(f"{folder}/{name}").decode("utf-8", "ignore").split("\n")[:-1]:
                yield line

    def run(self, rows: Iterator[T.Row]) -> Wrote:
        task, store = TaskContext.get(), Store(self.uri)
        folder = f"data/{self.write_id}/{task.getLocalProperty('streaming.sql.batchId') or 0}/{task.partitionId():06}"
        work = None if self.make_work else lambda row: row
        done, wrote, out = set(), Wrote(), None

        def append(key: str, line: str) -> None:
            nonlocal out
            if wrote.records % self.segment == 0:
                if out:
                    out.close()
                wrote.files.append(f"{folder}/{task.taskAttemptId():010}-{len(wrote.files):05}.jsonl")
                out = store.create(wrote.files[-1])
            out.write(line.encode() + b"\n")
            out.flush()
            done.add(key)
            wrote.records += 1

        try:
            if task.attemptNumber() > 0:
                for line in list(self.earlier(store, folder)):
                    if (key := self.key(json.loads(line))) not in done:
                        append(key, line)
            for row in rows:
                values = row.asDict(recursive=True)
                if (key := self.key(values)) not in done:
                    work = work or self.make_work()
                    append(key, json.dumps(work(values), ensure_ascii=False, default=str))
        finally:
            if out:
                out.close()
        return wrote

    def key(self, values: dict) -> str:
        return json.dumps([values[k] for k in self.keys], ensure_ascii=False, default=str)

    def publish(self, name: str, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        Store(self.uri).put(f"manifests/{name}.json", json.dumps({"write": self.write_id, "records": sum(m.records for m in messages if m), "files": files}).encode())


class RecordWriter(DataSourceWriter):
    def __init__(self, work: _Work):
        self.work = work

    def write(self, iterator):
        return self.work.run(iterator)

    def commit(self, messages) -> None:
        self.work.publish(self.work.write_id, messages)

    def abort(self, messages) -> None:
        """The files stay, for ``recover``."""


class RecordStreamWriter(DataSourceStreamWriter):
    """``name`` names the stream: a batch that is replayed, in a later run too, has the manifest of its number."""

    def __init__(self, work: _Work, name: str):
        self.work, self.name = work, name

    def write(self, iterator):
        return self.work.run(iterator)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803  Spark calls it so
        self.work.publish(f"{self.name}-{batchId:012}", messages)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        """The files stay; the batch comes again."""


class RecordLog(DataSource):
    """The format ``recordlog``. Options: path (a URI), keys (comma-separated), segment, and for streams stream."""

    make_work: Callable[[], Callable[[dict], dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def _work(self) -> _Work:
        return _Work(self.options["path"], self.options["keys"].split(","), uuid.uuid4().hex, type(self).make_work, int(self.options.get("segment", SEGMENT)))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("a record log is only appended to")
        return RecordWriter(self._work())

    def streamWriter(self, schema, overwrite: bool) -> RecordStreamWriter:  # noqa: N802
        return RecordStreamWriter(self._work(), self.options["stream"])


def format_for(spark: SparkSession, make_work: Callable[[], Callable[[dict], dict]] | None = None) -> str:
    """The name of a registered format that works on each row (a dict, into a dict that has the keys too) by what ``make_work`` gives, made once in a task that has any."""
    log = RecordLog
    if make_work is not None:
        name = f"recordlog_{uuid.uuid4().hex}"
        log = type("RecordLogAtWork", (RecordLog,), {"make_work": staticmethod(make_work), "name": classmethod(lambda cls: name)})
    spark.dataSource.register(log)
    return log.name()


def append_records(df: DataFrame, path: str, keys: list[str], make_work: Callable[[], Callable[[dict], dict]] | None = None, segment: int = SEGMENT) -> None:
    """Work on the rows and append what comes out, each key once within the call."""
    once = df.dropDuplicates(keys)  # equal keys meet in one task, and in the same one when it runs again
    once.write.format(format_for(df.sparkSession, make_work)).mode("append").option("path", path).option("keys", ",".join(keys)).option("segment", segment).save()


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All records that a manifest names. A log without any is empty."""
    store = Store(path)
    files = [f for name in store.names("manifests") if name.endswith(".json") for f in json.loads(store.read(f"manifests/{name}"))["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path.rstrip('/')}/{f}" for f in files])


def recover(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], done: str = "true") -> int:
    """Take the records of writes that failed into the log, each key once and none that it holds; their files go. Gives how many files there were.

    Only records that meet the condition ``done`` count, on either side. If this
    call fails, the next one finds the same files again, and the keys that were
    taken in by then are known.
    """
    store = Store(path)
    named = {f for name in store.names("manifests") if name.endswith(".json") for f in json.loads(store.read(f"manifests/{name}"))["files"]}
    lost = [name for name in store.all_under("data") if name not in named]
    if lost:
        # A record that was torn off is no JSON.
        found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json([f"{path.rstrip('/')}/{name}" for name in lost])
        held = read_records(spark, path, schema).where(done).select(*keys)
        append_records(found.where(done).join(held, keys, "left_anti"), path, keys)
        for name in lost:
            store.remove(name)
    return len(lost)
