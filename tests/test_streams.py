"""Streams: votes kept as state, event-time windows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import merge
from folioflow.streaming import votes, windows

CELLS = "doc string, field string, chunk_id long, value_json string"


def test_votes_over_any_split_equal_the_vote_at_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(4)}", f"f{rng.randrange(3)}", i, rng.choice(["1", "2", "é", None])) for i in range(150)]
    rows += [("hot", "f", 1_000 + i, "x" if i % 3 else "y") for i in range(200)] + [("null", "f", 1, None), ("tie", "f", 2, "b"), ("tie", "f", 1, "a")]
    keys = ["doc", "field"]
    want = {(r.doc, r.field): (r.picked, r.mode, r["values"]) for r in merge.vote(spark.createDataFrame(rows, CELLS), keys).collect()}
    rng.shuffle(rows)
    cut = sorted(rng.sample(range(len(rows)), 2))
    base = str(tmp_path)
    stream = spark.readStream.schema(CELLS).parquet(f"{base}/in/*")
    for i, part in enumerate([rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :], [("hot", "f", 5_000, "x")]]):
        spark.createDataFrame(part, CELLS).write.parquet(f"{base}/in/{i}")
        votes.follow(votes.vote_changes(stream, keys), f"{base}/changes", f"{base}/checkpoint")
    got = votes.latest(spark, f"{base}/changes", keys)
    assert {(r.doc, r.field): (r.picked, r.mode, r["values"]) for r in got.collect()} == want
    assert want["hot", "f"] == ("x", "majority_vote", want["hot", "f"][2]) and want["null", "f"] == (None, None, None) and want["tie", "f"] == (None, "tie_to_null", ["a", "b"])
    last = spark.read.parquet(f"{base}/changes").agg(F.max("batch")).first()[0]
    assert spark.read.parquet(f"{base}/changes").where(f"batch = {last}").count() == 0 or last == 2  # one more vote for the same outcome changes nothing


@pytest.mark.parametrize("buckets", [{}, {"buckets": 4}])
def test_votes_of_many_fields_take_few_values_of_state_and_emit_changes_only(spark, tmp_path, buckets):
    rng, base, keys = random.Random(9), str(tmp_path), ["doc", "field"]
    schema = "doc string, field double, chunk_id long, value_json string"
    fields = [(d, f) for d in [None, "", *[f"d{i}" for i in range(58)]] for f in (None, float("nan"), 0.0, 1.5, 2.5)]
    rows = [(*f, i, rng.choice(["1", "2", None])) for i, f in enumerate(fields * 4)]
    batches, counts = [rows[:700], rows[700:], rows[:1]], {}
    stream, found = spark.readStream.schema(schema).parquet(f"{base}/in/*"), []
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).write.parquet(f"{base}/in/{i}")
        changes = votes.vote_changes(stream, keys, **buckets).writeStream.foreachBatch(lambda df, n: found.append(df.collect()))
        q = changes.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        before = {f: votes.decided(c) for f, c in counts.items()}
        for d, f, place, v in part:
            known = counts.setdefault((d, str(f)), {})
            if v is not None:
                n, first = known.get(v, (0, place))
                known[v] = (n + 1, min(first, place))
        after = {f: votes.decided(c) for f, c in counts.items()}
        want = sorted(str((*f, o["picked"], o["mode"], o["values"], o["n_votes"])) for f, o in after.items() if f not in before or any(o[k] != before[f][k] for k in ("picked", "mode", "values")))
        assert sorted(str((r.doc, str(r.field), r.picked, r.mode, r["values"], r.n_votes)) for r in found[-1]) == want
        assert 0 < q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= buckets.get("buckets", len(fields))  # state for each field and value would be more calls
    assert len(fields) == len(counts) == 300


def test_partial_counts_send_a_row_for_each_bucket_and_part(spark):
    cells = spark.range(400_000, numPartitions=2).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('d', id % 500) END AS doc", "nullif(id % 7, 0) AS field", "id AS chunk_id", "nullif(id % 4, 0) AS value_json")
    sent = votes.partial_counts(cells, ["doc", "field"], "value_json", "chunk_id", 16).persist()
    assert sent.count() <= 16 * 2 * 2  # buckets, tasks, parts of 131,072 rows
    got = sent.selectExpr("_bucket", "inline(arrays_zip(doc, field, v, n, first))").groupBy("doc", "field", "v").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.countDistinct("_bucket").alias("buckets"))
    want = cells.groupBy("doc", "field", F.col("value_json").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"), F.lit(1).cast("long").alias("buckets"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    sent.unpersist()


def slow_sessions(rows, gap):
    out = []
    for ts, user in sorted(rows, key=lambda r: (r[1], r[0])):
        if out and out[-1][0] == user and ts - out[-1][2] < gap:
            out[-1][2:] = [ts, out[-1][3] + 1]
        else:
            out.append([user, ts, ts, 1])
    return sorted((u, a, b + gap, n) for u, a, b, n in out)


@pytest.mark.parametrize("kind", ["tumbling", "sessions"])
def test_windows_close_count_late_rows_and_drop_state(spark, tmp_path, kind):
    rng, zero, base = random.Random(8), datetime(2024, 3, 1), str(tmp_path)
    rows = sorted((zero + timedelta(minutes=rng.randrange(3_000), seconds=rng.randrange(60)), rng.randrange(5)) for _ in range(300))
    stragglers = [(zero + timedelta(minutes=m), 7) for m in (1, 2, 2_990)]
    schema = "ts timestamp, user long"
    events = spark.readStream.schema(schema).parquet(f"{base}/in/*")
    make = {"tumbling": lambda: windows.tumbling(events, "ts", "1 hour", "30 minutes", ["user"]), "sessions": lambda: windows.sessions(events, "ts", "20 minutes", "30 minutes", ["user"])}[kind]
    notes = []
    for i, part in enumerate([rows[:100], rows[100:200], rows[200:], stragglers, [(zero + timedelta(days=90), None)]]):
        spark.createDataFrame(part, schema).write.parquet(f"{base}/in/{i}")
        notes.append(windows.run(make(), f"{base}/out", f"{base}/checkpoint"))
    assert [n["rows"] for n in notes] == [100, 100, 100, 3, 1] and notes[-1]["open"] <= 1
    found = windows.closed(spark, f"{base}/out", "start timestamp, end timestamp, user long, n long")
    got = sorted((r.user, r.start, r.end, r.n) for r in found.collect())
    in_time = [*rows, stragglers[-1]]
    if kind == "sessions":
        assert got == slow_sessions(in_time, timedelta(minutes=20))
    else:
        count: dict = {}
        for ts, user in in_time:
            start = ts.replace(minute=0, second=0)
            count[user, start] = count.get((user, start), 0) + 1
        assert got == sorted((u, s, s + timedelta(hours=1), n) for (u, s), n in count.items())
        assert max(n["most_open"] for n in notes) < len(count)  # closed windows leave the state
    assert windows.late(sum(n["rows"] for n in notes) - 1, found) == 2
    assert windows.run(make(), f"{base}/out", f"{base}/checkpoint")["rows"] == 0
