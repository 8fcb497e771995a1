"""Interval and as-of joins, global coverage, buckets and sketches against slow versions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.operators import asof, chunking, compare, intervals, summaries
from folioflow.sources import buckets


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(2)
    side = lambda n: [(rng.choice(["a", "a", "b"]), i, s := rng.randrange(300), s + rng.choice([0, 1, 5, 40, 120])) for i in range(n)]
    left, right = side(60), side(50)
    a, b = spark.createDataFrame(left, "doc string, i long, start long, end long"), spark.createDataFrame(right, "doc string, j long, char_start long, char_end long")
    for width in (1, 7, 50, 10_000):
        got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["doc"], width).collect())
        assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
        got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["doc"], width, within=True).collect())
        assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < x[3] and y[2] <= x[2] and x[3] <= y[3])


def test_spans_by_offsets_equal_spans_by_text(spark):
    rng = random.Random(6)
    docs = [(f"d{i}", "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(200)))) for i in range(6)] + [("none", None), ("empty", "")]
    spans = [(d, t[s : s + n]) for d, t in docs if t for s, n in ((0, 1), (3, 2), (10, 9), (50, 60))] + [("d0", ""), ("d0", None), ("d1", "absent!"), ("none", "a"), ("d1", "a"), ("d1", "a")]
    frame, wanted = spark.createDataFrame(docs, "contract_name string, text string"), spark.createDataFrame(spans, "contract_name string, span string")
    chunks = chunking.fixed_chunks(frame, "contract_name", target=40, overlap=15)
    want = sorted({(c.contract_name, s, c.chunk_id) for c in chunks.collect() for d, s in spans if d == c.contract_name and s and s in c.text})
    for together in (1, 2, 1_000):
        places = intervals.occurrences(frame, wanted, together=together)
        held = dict(docs)
        assert all(held[r.contract_name][r.start : r.end] == r.span for r in places.collect())
        assert sorted(map(tuple, intervals.overlap_join(places, chunks.select("contract_name", "chunk_id", "char_start", "char_end"), ["contract_name"], 30, within=True).select("contract_name", "span", "chunk_id").distinct().collect())) == want
    assert sorted(map(tuple, intervals.located_by_offsets(wanted, frame, chunks).collect())) == want


def test_asof_join_equals_a_slow_one(spark):
    rng = random.Random(9)
    left = [(i, rng.choice(["hot", "hot", "hot", "x", "y", None]), rng.choice([None, *range(40)])) for i in range(400)]
    right = [(i, rng.choice(["hot", "hot", "x", "z", None]), rng.choice([None, *range(40)])) for i in range(60)]
    a, b = spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "j long, k string, t long")
    for strict in (True, False):
        got = {r.i: r.last and (r.last.t, r.last.j) for r in asof.asof_join(a.repartition(5), b, "k", "t", strict=strict).collect()}
        fits = lambda x, y: x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and (y[2] < x[2] or (not strict and y[2] == x[2]))
        latest = {x[0]: max((y[2] for y in right if fits(x, y)), default=None) for x in left}
        assert len(got) == 400
        for i, k, t in left:
            assert (got[i] and got[i][0]) == latest[i] and (not got[i] or right[got[i][1]][1] == k)
    assert asof.asof_join(a, b.limit(0), "k", "t").where("last IS NOT NULL").count() == 0 == asof.asof_join(a.limit(0), b, "k", "t").count()


def test_coverage_finds_gaps_and_wrong_overlaps(spark):
    docs = spark.createDataFrame([(i, "Word one. Next here.\n\n" * n) for i, n in enumerate((1, 9, 40))], "doc_id long, text string")
    good = chunking.chunk(docs, target=100, backoff=30, overlap=20)
    assert {(r.gaps, r.wrong_overlaps, r.from_start) for r in chunking.coverage(good, 20).collect()} == {(0, 0, True)}
    holes = chunking.coverage(good.where("chunk_id <> 1"), 20).where("doc_id = 2").first()
    assert holes.gaps == 1 and holes.wrong_overlaps == 1 and not chunking.coverage(good.where("chunk_id > 0"), 20).first().from_start


def test_agreement_over_time(spark):
    rows = [("a", 1, True), ("a", 1, False), ("a", 3, None), ("a", 5, True), ("b", 2, None)]
    got = compare.agreement_over_time(spark.createDataFrame(rows, "k string, t long, agree boolean"), "k", "t", 2).collect()
    assert sorted((r.k, r.t, r.n, r.agreement) for r in got) == [("a", 1, 2, 0.5), ("a", 1, 2, 0.5), ("a", 3, 2, 0.5), ("a", 5, 1, 1.0), ("b", 2, 0, 0.0)]


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.xxhash64("id") % 20_000).alias("who"), F.expr("CASE WHEN id % 50 <> 0 THEN (id * 7919) % 60000 END").alias("v"))
    summaries.daily(rows, ["day"], "who", "v").write.parquet(str(tmp_path / "days"))
    got = summaries.estimates(summaries.merged(spark.read.parquet(str(tmp_path / "days")).withColumn("all", F.lit(1)), ["all"]), {"p10": 0.1, "p50": 0.5, "p95": 0.95}).first()
    exact = rows.select("who").distinct().count()
    assert abs(got.n_distinct - exact) <= summaries.DISTINCT_ERROR * exact and got.n == 60_000
    values = sorted(r.v for r in rows.where("v IS NOT NULL").collect())
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
        assert abs(sum(v <= got[name] for v in values) / len(values) - p) <= summaries.RANK_ERROR + 1 / len(values)


def test_a_resume_join_in_buckets_needs_no_exchange(spark, tmp_path):
    rows, done = spark.range(500).select(F.col("id").alias("k")), spark.range(0, 400, 3).select(F.col("id").alias("k"))
    for name, df in (("rows_in_buckets", rows), ("done_in_buckets", done)):
        buckets.bucketed(df, name, ["k"], str(tmp_path / name))
    left = buckets.todo_in_buckets(spark, "rows_in_buckets", "done_in_buckets", ["k"])
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted(r.k for r in left.collect()) == [i for i in range(500) if i % 3 or i >= 400]
    buckets.bucketed(left, "done_in_buckets", ["k"], str(tmp_path / "done_in_buckets"), mode="append")
    assert buckets.todo_in_buckets(spark, "rows_in_buckets", "done_in_buckets", ["k"]).count() == 0


def test_sql_surface(spark):
    from folioflow.functions import sql_surface
    from folioflow.operators import scoring

    sql_surface.register(spark)
    text = "Word one. Next here.\n\nARTICLE II more words. " * 9
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL boundary_chunks(d.text, 100, 30, 20) c", docs=docs)
    assert rows.columns == ["doc_id", *[f.name for f in sql_surface.CHUNK_FIELDS]]  # no text unless it is asked for
    assert [(r.char_start, r.char_end, r.boundary_kind) for r in rows.orderBy("chunk_id").collect()] == [(s.start, s.end, s.kind) for s in chunking.spans(text, 100, 30, 20)]
    for call in ("boundary_chunks(1, 100, 30, 20)", "boundary_chunks('x', 0, 30, 20)", "boundary_chunks('x', 9, -1, 20)"):
        try:
            spark.sql(f"SELECT * FROM {call}").collect()
        except Exception as e:  # noqa: BLE001
            assert "boundary_chunks" in str(e) or "at least" in str(e)
        else:
            raise AssertionError(call)
    cells = [("single_choice", p, g) for p in (None, '"a"', '"b"') for g in (None, '"a"')] + [("multilabel", p, g) for p in (None, '["a","b"]', '["b","a","a"]', '"a"', "[]") for g in (None, '["a","b"]', '"a"', "[]")]
    df = spark.createDataFrame(cells, "kind string, pred_json string, gold_json string")
    both = df.withColumn("mine", scoring.cell_outcome()).withColumn("sql", F.expr("cell_outcome(kind, pred_json, gold_json)"))
    assert both.where("mine IS DISTINCT FROM sql").count() == 0


def test_places_are_sent_a_few_at_a_time(spark):
    """What a worker holds does not grow with the places of its rows."""
    texts, spans = pa.array(["ab" * 50_000, "none", "ab"]), pa.array([["ab", "b"], ["ab"], ["b"]])
    lists = [*intervals._places(texts, spans)]
    assert max(len(at) for at, *_ in lists) <= intervals.PLACES < sum(len(at) for at, *_ in lists) == 100_001
    assert [x[-1] for x in lists[-1]] == [2, "b", 1, 2]
    docs = spark.createDataFrame([(i, "ab" * 100) for i in range(200)], "contract_name long, text string").coalesce(1)
    assert intervals.occurrences(docs, spark.createDataFrame([(i, "aba") for i in range(200)], "contract_name long, span string")).count() == 200 * 99
