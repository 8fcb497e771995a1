import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import cells, fields, merge

ROWS = "contract_name string, chunk_id int, field string, value_json string"


def voted(spark, *values):
    rows = [("c", i, "f", v) for i, v in enumerate(values)]
    return merge.vote(spark.createDataFrame(rows, ROWS), ["contract_name", "field"]).first()


@pytest.mark.parametrize(
    ("values", "picked", "mode", "listed"),
    [
        (("A", "B", "A"), "A", "majority_vote", ["A", "B"]),
        (("A", "B"), None, "tie_to_null", ["A", "B"]),
        (("A",), "A", None, None),
        (("A", "A"), "A", None, None),
        ((None, None), None, None, None),
        ((None, "A"), "A", None, None),
        (("B", "A", "A", "B", "C"), None, "tie_to_null", ["B", "A"]),
        (("C", "A", "A"), "A", "majority_vote", ["C", "A"]),
        (('"None"', None), '"None"', None, None),
    ],
)
def test_vote(spark, values, picked, mode, listed):
    r = voted(spark, *values)
    assert (r.picked, r["mode"], r["values"]) == (picked, mode, listed)


def test_vote_distribution_counts_all_values(spark):
    assert voted(spark, "B", "A", "A", "B", "C").vote_distribution == {"A": 2, "B": 2, "C": 1}


def test_union_of_labels(spark):
    rows = [("a", '["y","x"]'), ("a", '["x"]'), ("a", None), ("b", "[]"), ("b", None), ("c", '"text"'), ("d", '["z"]'), ("d", '"text"')]
    found = merge.union_labels(spark.createDataFrame(rows, "k string, value_json string"), ["k"]).collect()
    assert {r.k: r.labels for r in found} == {"a": ["x", "y"], "b": None, "c": None, "d": ["z"]}


def test_conflict_summary_counts_documents_without_conflict(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "contract_name string")
    conflicts = spark.createDataFrame([("a",), ("a",), ("b",)], "contract_name string")
    r = merge.conflict_summary(docs, conflicts).first()
    assert (r.documents, r.conflicts, r.least, r["mean"], r.most) == (3, 3, 0, 1.0, 2)


def test_merge_documents(spark):
    dim = spark.createDataFrame([(0, "choice", "single_choice", False, []), (1, "many", "multilabel", True, [])], fields.FIELDS)
    preds = [
        ("c", 0, '{"contract_name":"c","choice":"Yes","many":["b"],"choice_evidence_spans":["x"]}'),
        ("c", 1, '{"choice":"Yes","many":["a","b"]}'),
        ("c", 2, '{"choice":null}'),
        ("c", 3, None),
        ("c", 4, "not json"),
        ("d", 0, '{"choice":null,"many":[]}'),
    ]
    df = spark.createDataFrame(preds, "contract_name string, chunk_id int, prediction string")
    merged, conflicts = merge.merge_documents(cells.observed(df, "prediction", ["contract_name", "chunk_id"]), dim)
    got = {(r[0], r[1]): r[2] for r in merged.collect()}
    assert got == {("c", "choice"): '"Yes"', ("c", "many"): '["a","b"]', ("d", "choice"): None, ("d", "many"): None}
    assert conflicts.count() == 0


def test_first_and_last_per_key(spark):
    from folioflow.sources.files import first_per_key, keyed_or_first, last_per_key

    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, ordinal long")
    assert {r.k: r.v for r in first_per_key(df, "k").collect()} == {"a": 1, "b": 3}
    assert {r.k: r.v for r in last_per_key(df, "k").collect()} == {"a": 2, "b": 3}
    odd = spark.createDataFrame([('{"o": "x", "contract_name": ""}', 0), ('{"o": "y"}', 1), ('{"o": 1, "contract_name": "n"}', 2)], "value string, ordinal long")
    assert {r.name for r in keyed_or_first(odd).collect()} == {"x", "y", "n"}


def test_collected_is_in_order(spark):
    df = spark.createDataFrame([("a", 2, "z"), ("a", 0, "x"), ("a", 1, "y")], "k string, chunk_id int, v string")
    assert [x.v for x in merge.collected(df, "k").first()["rows"]] == ["x", "y", "z"]


def test_cells_keep_the_four_kinds_of_absence_apart(spark):
    dim = spark.createDataFrame([(i, f, "freetext", False, []) for i, f in enumerate("abcd")], fields.FIELDS)
    df = spark.createDataFrame([("k", '{"b":null,"c":[],"d":"None"}')], "contract_name string, prediction string")
    got = {r.field: r.value_json for r in cells.over_schema(df, dim).collect()}
    assert got == {"a": None, "b": None, "c": "[]", "d": '"None"'}
    seen = {r.field: r.value_json for r in cells.observed(df).collect()}
    assert seen == {"b": None, "c": "[]", "d": '"None"'}


def test_pivot_and_filled(spark):
    df = spark.createDataFrame([('q"x', "f", '"v"'), ('q"x', "g", None)], "contract_name string, field string, value_json string")
    import json

    assert json.loads(cells.pivot(df).first().record) == {"contract_name": 'q"x', "f": "v", "g": None}
    assert cells.filled(df, ["contract_name"]).first().n_non_null == 1
    assert cells.filled(df, ["contract_name"], with_name=True).first().n_non_null == 2


def test_presence_is_not_the_same_as_a_value(spark):
    df = spark.createDataFrame([('{"prompt":null,"text":"t"}',), ('{"text":"t"}',), ("{}",)], "r string")
    assert [r[0] for r in df.select(cells.first_present("r", "prompt", "input", "text")).collect()] == [None, "t", None]
    keys = spark.createDataFrame([("a", 1, 7), (None, 1, 8)], "contract_name string, chunk_id int, ordinal long").select(cells.row_key().alias("k"))
    assert [tuple(r.k) for r in keys.collect()] == [("a", 1), ("__idx__", 8)]
    raw = spark.createDataFrame([("{}",), ("{",)], "raw string").select(cells.raw_if_unparsed("raw").alias("x"))
    assert [r.x for r in raw.collect()] == [None, "{"]


def test_lifecycle(spark):
    from folioflow.operators import chunking
    from folioflow.plans import lifecycle

    hygiene = spark.createDataFrame([("a", True, "ok"), ("b", True, "ok"), ("c", False, "bad")], "contract_name string, usable_for_snippet_training boolean, status string")
    targets = spark.createDataFrame([("a", '{"contract_name":"a","x":"1","y":null}'), ("c", "{}")], "contract_name string, target_json string")
    texts = spark.createDataFrame([("a", "word. " * 30), ("b", "t"), ("c", "t")], "contract_name string, text string")
    rows = lifecycle.build_corpus(hygiene, targets, texts, 50, 20, 5).collect()
    assert {r.contract_name for r in rows} == {"a"} and len({r.split for r in rows}) == 1
    assert rows[0].n_target_non_null == 2 and rows[0].n_chunks_in_contract == len(rows) == len(chunking.spans("word. " * 30, 50, 20, 5))
    dim = spark.createDataFrame([(0, "x", "single_choice", False, ["1", "2"])], fields.FIELDS)
    preds = spark.createDataFrame([("a", 0, '{"x":"one"}'), ("a", 1, '{"x":"1"}'), ("b", 0, None)], "contract_name string, chunk_id int, prediction string")
    golds = spark.createDataFrame([("a", 0, '{"x":"1"}'), ("b", 0, '{"x":"2"}')], "contract_name string, chunk_id int, gold string")
    words = spark.createDataFrame([("x", "1", "one")], "field string, canonical string, modified string")
    scored = lifecycle.merge_and_score(preds, golds, dim, words)["scored"]
    assert {r.contract_name: r.outcome for r in scored.collect()} == {"a": "correct_value", "b": "over_abstain"}
    assert {r.field for r in scored.select(F.col("field")).collect()} == {"x"}


# The conflicts of three published runs, as (answer, votes) in the order in which the answers were first seen.
_ALL, _SOME = "Applies to all negative covenants", "Applies only to specified negative covenants"
_TO, _SEEK = '"entitled to" specific performance', '"entitled to seek" specific performance'
_OTHER, _MATERIAL = "Accurate at another materiality standard (e.g., hybrid standard)", "Accurate in all material respects"
_NO_YES, _YES_NO, _COVENANTS, _STANDARD = [("No", 1), ("Yes", 1)], [("Yes", 1), ("No", 1)], [(_ALL, 1), (_SOME, 1)], [(_OTHER, 1), (_MATERIAL, 1)]
PUBLISHED = {
    "first": ([_COVENANTS, _NO_YES, _NO_YES, _NO_YES, [(_TO, 1), (_SEEK, 1)], _YES_NO, _NO_YES], 7, 0),
    "second": ([_COVENANTS, _NO_YES, _STANDARD, _NO_YES, _NO_YES, [(_SEEK, 2), (_TO, 1)], _YES_NO, _NO_YES], 7, 1),
    "evidence": ([_COVENANTS, _NO_YES, _STANDARD, _YES_NO, [(_SEEK, 2), (_TO, 1)], _YES_NO], 5, 1),
}


@pytest.mark.parametrize("run", PUBLISHED)
def test_published_conflicts_come_out_of_their_votes(spark, run):
    conflicts, ties, majorities = PUBLISHED[run]
    rows = []
    for i, answers in enumerate(conflicts):
        votes = [a for a, _ in answers] + [a for a, n in answers for _ in range(n - 1)]
        rows += [(f"c{i}", "f", k, json.dumps(v)) for k, v in enumerate(votes)] + [(f"c{i}", "f", 90, None)]
    log = merge.vote(spark.createDataFrame(rows, "contract_name string, field string, chunk_id int, value_json string"), ["contract_name", "field"]).where("mode IS NOT NULL")
    got = {r.contract_name: r for r in log.collect()}
    assert {r.mode: r.n for r in merge.conflicts_by_mode(log).collect()} == {k: n for k, n in (("tie_to_null", ties), ("majority_vote", majorities)) if n}
    for i, answers in enumerate(conflicts):
        r = got[f"c{i}"]
        assert r["values"] == [json.dumps(a) for a, _ in answers] and r.vote_distribution == {json.dumps(a): n for a, n in answers}
        assert (r.mode, r.picked) == (("majority_vote", json.dumps(answers[0][0])) if answers[0][1] == 2 else ("tie_to_null", None))


def test_schema_fields_as_columns_equal_the_rules(spark):
    import random

    rng = random.Random(3)
    props = [
        {"type": "string"}, {"type": ["string"]}, {"type": ["string", "null"]}, {"enum": ["a", None, 1]}, {"type": "array", "items": {"type": "string", "enum": ["x", 'say "y"']}}, {"type": ["array", "null"], "items": {"enum": [1, "z"]}},
        {"type": ["array"], "items": {"type": "string"}}, {"type": "array"}, {}, {"type": "integer", "enum": []}, {"type": ["null", "array"], "items": {"type": ["string"], "enum": ["q"]}, "description": "enum"},
    ]
    schemas = [{"properties": {f"f{i} é'": p for i, p in enumerate(rng.sample(props, rng.randrange(len(props))))}} for _ in range(12)]
    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(schemas)] + [(90, None), (91, "{"), (92, "{}")]
    got = fields.schema_fields(spark.createDataFrame(rows, "i long, schema string")).orderBy("i", "ordinal").collect()
    want = [(i, k, n, fields.field_kind(p), fields.is_multilabel(p), [x for x in (p.get("enum") or p.get("items", {}).get("enum") or []) if isinstance(x, str)]) for i, x in enumerate(schemas) for k, (n, p) in enumerate(x["properties"].items())]
    assert [tuple(r) for r in got] == want
    back = fields.rewritten(spark.createDataFrame(rows[:12] + [(90, None)], "i long, schema string"), fields.for_grammar).orderBy("i").collect()
    assert [r.schema and json.loads(r.schema) for r in back] == [*map(fields.for_grammar, schemas), None]


def test_cells_are_not_shuffled_by_field(spark):
    """Cells have few fields, so that a shuffle by them would put all into a few tasks: what is joined by field goes to the cells."""
    from folioflow.operators import fields, merge, scoring

    got = spark.createDataFrame([("d", 0, "k", '"a"'), ("d", 1, "m", '["x"]')], "contract_name string, chunk_id int, field string, value_json string")
    dimension = fields.load_fields(spark, {"properties": {"k": {"type": "string", "enum": ["a", "b"]}, "m": {"type": "array", "items": {"type": "string", "enum": ["x"]}}}})
    words = spark.createDataFrame([("k", "b", "a")], "field string, canonical string, modified string")
    remapped = fields.remap_json(got, words)
    merged, _ = merge.merge_documents(remapped, dimension)
    scored = scoring.with_overlays(scoring.score_cells(merged, merged, dimension), dimension.select("field").limit(1), words)
    assert {(r.field, r.pred_json, r.is_top) for r in scored.collect()} == {("k", '"b"', True), ("m", '["x"]', False)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables whose size Spark overestimates
    try:
        for df, joins in ((remapped, 1), (merged, 3)):
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 0 and plan.count("BroadcastHashJoin") >= joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
