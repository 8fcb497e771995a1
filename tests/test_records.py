"""The record log: killed tasks, resumed runs, replayed batches."""

import json
import os
import signal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioflow.operators import extract
from folioflow.plans import lifecycle
from folioflow.sources import records

SCHEMA = "k long, v string"


def counted(calls, kill_at=None):
    """Work that notes each call in a file of its own, and kills its process at a key before the call."""

    def make_work():
        def work(row):
            if row["k"] == kill_at:
                os.kill(os.getpid(), signal.SIGKILL)
            with open(f"{calls}/{row['k']}", "a") as f:
                f.write("x")
            return {"k": row["k"], "v": f"answer {row['k']} é"}

        return work

    return make_work


def calls_of(folder):
    return {int(n): os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}


def test_a_killed_task_keeps_its_records_and_no_key_is_repeated(spark, tmp_path):
    calls, path = tmp_path / "calls", f"file://{tmp_path}/log"
    calls.mkdir()
    rows = spark.range(60).select(F.col("id").alias("k")).union(spark.range(20).select(F.col("id").alias("k")))
    with pytest.raises(Exception, match="(?i)worker|writ|crash"):
        records.append_records(rows, path, ["k"], counted(calls, kill_at=37), segment=3)
    before = calls_of(calls)
    assert 0 < len(before) < 60
    assert records.read_records(spark, path, SCHEMA).count() == 0  # no manifest, no half of a write
    with open(f"{tmp_path}/log/data/torn.jsonl", "w") as f:
        f.write('{"k": 37, "v": "ans')
    assert records.recover(spark, path, SCHEMA, ["k"]) > 1
    assert {r.k for r in records.read_records(spark, path, SCHEMA).collect()} == set(before)
    assert records.recover(spark, path, SCHEMA, ["k"]) == 0
    left = rows.join(records.read_records(spark, path, SCHEMA), "k", "left_anti")
    records.append_records(left, path, ["k"], counted(calls))
    assert calls_of(calls) == {i: 1 for i in range(60)}  # each call was paid for once
    assert sorted(map(tuple, records.read_records(spark, path, SCHEMA).collect())) == [(i, f"answer {i} é") for i in range(60)]


def test_a_task_that_runs_again_takes_over_what_was_flushed(tmp_path, monkeypatch):
    uri, seen = f"file://{tmp_path}/log", []

    def make_work(fail_at=None):
        def work(row):
            if row["k"] == fail_at:
                raise ValueError("lost")
            seen.append(row["k"])
            return row | {"v": "x"}

        return work

    rows = [SimpleNamespace(asDict=lambda recursive, i=i: {"k": i}) for i in (1, 2, 3, 4, 4)]
    for attempt, fail_at in ((0, 3), (1, None)):
        task = SimpleNamespace(partitionId=lambda: 5, taskAttemptId=lambda a=attempt: 70 + a, attemptNumber=lambda a=attempt: a, getLocalProperty=lambda k: None)
        monkeypatch.setattr(records, "TaskContext", SimpleNamespace(get=lambda t=task: t))
        work = records._Work(uri, ["k"], "w", lambda f=fail_at: make_work(f), 2)
        if fail_at:
            with pytest.raises(ValueError):
                work.run(iter(rows))
            with open(f"{tmp_path}/log/data/w/0/000005/torn.jsonl", "w") as f:
                f.write('{"k": 9')
        else:
            wrote = work.run(iter(rows))
    assert seen == [1, 2, 3, 4] and wrote.records == 4 and all("0000000071" in f for f in wrote.files) and len(wrote.files) == 2
    work.publish("w", [wrote, None])
    lines = [json.loads(x) for f in wrote.files for x in records.Store(uri).read(f).decode().splitlines()]
    assert [x["k"] for x in lines] == [1, 2, 3, 4]


def test_a_replayed_batch_replaces_its_manifest(spark, tmp_path):
    path, source = f"file://{tmp_path}/log", str(tmp_path / "in")
    spark.range(10).selectExpr("id AS k", "concat('v', id) AS v").coalesce(1).write.parquet(source)
    for run in ("one", "two"):  # a checkpoint of its own: the same batches come again
        stream = spark.readStream.schema(SCHEMA).parquet(source).dropDuplicates(["k"])
        query = stream.writeStream.format(records.format_for(spark)).options(path=path, keys="k", stream="s", checkpointLocation=str(tmp_path / run)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.k for r in records.read_records(spark, path, SCHEMA).collect()) == list(range(10))
    assert records.recover(spark, path, SCHEMA, ["k"]) > 0  # the files of the first run
    assert sorted(r.k for r in records.read_records(spark, path, SCHEMA).collect()) == list(range(10))


def test_edges(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert records.read_records(spark, path, SCHEMA).count() == 0 and records.recover(spark, path, SCHEMA, ["k"]) == 0
    rows = spark.createDataFrame([(None, None), (None, "x"), (1, 'quo"te\nline'), (1, 'quo"te\nline')], SCHEMA)
    records.append_records(rows.limit(0), path, ["k", "v"])
    records.append_records(rows, path, ["k", "v"])
    assert sorted(map(tuple, records.read_records(spark, path, SCHEMA).collect()), key=str) == sorted([(None, None), (None, "x"), (1, 'quo"te\nline')], key=str)
    with pytest.raises(Exception, match="appended"):
        rows.write.format(records.format_for(spark)).mode("overwrite").options(path=path, keys="k").save()


def test_resumed_extraction(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    chunks = spark.createDataFrame([(f"c{i}", j, f"text {i} {j}") for i in range(4) for j in range(3)], "contract_name string, chunk_id int, input string")

    def make_client(broken):
        def client(system, user):
            if broken and user.endswith("2"):
                return "{not json", {}
            return json.dumps({"said": user}), {"input_tokens": len(user), "output_tokens_details": {"reasoning_tokens": 1}}

        return client

    first = lifecycle.resumed_extraction(chunks, path, lambda: make_client(True), "sys", pause=0)
    assert first.count() == 8
    second = lifecycle.resumed_extraction(chunks, path, lambda: make_client(False), "sys", pause=0)
    assert sorted((r.contract_name, r.chunk_id, json.loads(r.prediction)["said"]) for r in second.collect()) == sorted((r.contract_name, r.chunk_id, r.input) for r in chunks.collect())
    every = records.read_records(spark, path, extract.SCHEMA)
    assert every.count() == 16 and every.where("prediction IS NULL AND error IS NOT NULL AND raw = '{not json' AND attempts = 3").count() == 4
    assert lifecycle.resumed_extraction(chunks, path, lambda: 1 / 0, "sys").count() == 12  # no client is made where there is nothing to ask
