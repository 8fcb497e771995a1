import pytest

from folioflow.functions import scalars
from folioflow.operators import compare, fields, risk, scoring
from folioflow.plans import report

CASES = [
    ("single_choice", None, None, "correct_abstain"),
    ("single_choice", '"a"', None, "hallucination"),
    ("single_choice", None, '"a"', "over_abstain"),
    ("single_choice", '"a"', '"a"', "correct_value"),
    ("single_choice", '"None"', '"a"', "wrong_value"),
    ("multilabel", '["b","a","a"]', '["a","b"]', "correct_value"),
    ("multilabel", '"a"', '["a"]', "wrong_value"),
    ("multilabel", "[]", '["a"]', "wrong_value"),
    ("multilabel", "[]", None, "hallucination"),
]


@pytest.mark.parametrize(("kind", "pred", "gold", "expected"), CASES)
def test_outcome(spark, kind, pred, gold, expected):
    df = spark.createDataFrame([(kind, pred, gold)], "kind string, pred_json string, gold_json string")
    assert df.select(scoring.cell_outcome()).first()[0] == expected


def test_blind_outcome_counts_duplicates(spark):
    df = spark.createDataFrame([('["b","a","a"]', '["a","b"]'), ('["b","a"]', '["a","b"]')], "pred_json string, gold_json string")
    assert [r[0] for r in df.select(scoring.blind_outcome()).collect()] == ["wrong_value", "correct_value"]


def test_empty_input_has_rate_zero(spark):
    cells = spark.createDataFrame([], "outcome string")
    r = scoring.subset_stats(cells).first()
    assert (r.n, r.correct, r.accuracy) == (0, 0, 0.0)
    assert report.percent(0, 0) == "—" and report.percent(1, 400) == "0.2%"
    one = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int").select(scalars.percent_text("a", "b").alias("p"))
    assert [r.p for r in one.collect()] == ["—", "25.0%"]


@pytest.mark.parametrize(
    ("counts", "correct"),
    [((1178, 88, 37, 4, 73), 1251), ((1149, 80, 17, 41, 93), 1242), ((1156, 79, 18, 35, 92), 1248), ((1122, 81, 14, 67, 96), 1218), ((372, 474, 60, 424, 50), 422), ((396, 381, 53, 493, 57), 453), ((20, 21, 2, 1229, 108), 128), ((772, 459, 105, 39, 5), 777)],
)
def test_published_confusion_counts(spark, counts, correct):
    # Answers and gold that make so many cells of each class, through the join and the rule.
    shapes = [('"a"', '"a"'), ('"a"', '"b"'), ('"a"', None), (None, '"b"'), (None, None)]
    cells = [(f"c{i}", "f", p, g) for i, (p, g) in enumerate(x for x, n in zip(shapes, counts) for _ in range(n))]
    schema = "contract_name string, field string, value_json string"
    preds = spark.createDataFrame([(c, f, p) for c, f, p, _ in cells] + [("alone", "f", '"a"')], schema)
    golds = spark.createDataFrame([(c, f, g) for c, f, _, g in cells], schema)
    dim = spark.createDataFrame([(0, "f", "single_choice", False, [])], fields.FIELDS)
    r = scoring.subset_stats(scoring.score_cells(preds, golds, dim)).first()
    assert tuple(r[o] for o in scoring.OUTCOMES) == counts
    assert (r.n, r.correct, r.hallucination + r.correct_abstain) == (1380, correct, 110)


def test_top_risk_is_stable_and_skips_bad_rows(spark):
    rows = [("a", "2", "0.5"), ("b", "5", "0.9"), ("c", "6", "1.0"), ("d", "", "1.0"), ("e", "3", "0.9"), ("f", "x", "1"), ("g", "2", "None")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "field string, cardinality string, pcl_risk string, ordinal long")
    assert [r.field for r in scoring.top_risk_fields(df, 2).collect()] == ["b", "e"]


def test_overlays(spark):
    cells = spark.createDataFrame(
        [("c", "f", "multilabel", '["q\\"1"]', '["q\\"1"]', "correct_value"), ("c", "g", "single_choice", None, '"z"', "over_abstain"), ("d", "f", "multilabel", None, None, "correct_abstain")],
        "contract_name string, field string, kind string, pred_json string, gold_json string, outcome string",
    )
    top = spark.createDataFrame([("g",)], "field string")
    words = spark.createDataFrame([("f", 'q"1', "q'1")], "field string, canonical string, modified string")
    flagged = scoring.with_overlays(cells, top, words)
    assert sorted((r.contract_name, r.field, r.is_top, r.is_substituted) for r in flagged.collect()) == [("c", "f", False, True), ("c", "g", True, None), ("d", "f", False, False)]
    stats = {(r.overlay, r.group): r.n for r in scoring.overlay_stats(flagged).collect()}
    assert stats == {("overall", None): 3, ("kind", "multilabel"): 2, ("kind", "single_choice"): 1, ("top_risk", "true"): 1, ("top_risk", "false"): 2, ("substituted", "true"): 1, ("substituted", "false"): 1}
    text = report.markdown(scoring.overlay_stats(flagged), scoring.mismatches(cells.withColumnRenamed("contract_name", "doc"), 1, ("doc",)), 2, "Run")
    assert "2/3 = 66.7%" in text and "… 1 more" in text


def test_risk(spark):
    rows = [("f", v) for v in (None, "a", "a", "b")] + [("g", None)]
    got = {r.field: r for r in risk.field_risk(spark.createDataFrame(rows, "field string, value_json string")).collect()}
    assert (got["f"].majority_answer, got["f"].pcl_risk) == ("a", 0.25 * 2 / 3)
    assert (got["g"].support, got["g"].majority_answer, got["g"].pcl_risk) == (0, None, 0.0)


def test_compare(spark):
    schema = "contract_name string, field string, value_json string"
    one = spark.createDataFrame([("c", "f", "1"), ("c", "g", None), ("d", "f", "1")], schema)
    two = spark.createDataFrame([("c", "f", "1"), ("c", "g", "2")], schema)
    gold = spark.createDataFrame([("c", "f", "1"), ("c", "g", None)], schema)
    cells = compare.paired_cells(one, two, gold)
    r = compare.agreement(cells).first()
    assert (r.n, r.same_value, r.correct1, r.correct2, r.delta, r.noise_floor) == (2, 1, 2, 1, 1, 0.5)
    assert [tuple(x) for x in compare.outcome_flips(cells).collect()] == [("correct_abstain", "hallucination", 1)]
    assert [x.field for x in compare.most_volatile(cells).collect()] == ["g"]
    assert compare.examples(cells).count() == 1


def test_schema_to_fields_and_dictionaries(spark):
    schema = {"properties": {"contract_name": {"type": "string"}, "a": {"type": ["string", "null"], "enum": ["x", 'say "y"', None]}, "m": {"type": ["array", "null"], "items": {"type": "string", "enum": ['l"1', "l2"]}}, "t": {"type": ["string", "null"]}, "n": {"type": "array", "items": {"enum": [1]}}}}
    dim = fields.load_fields(spark, schema)
    assert {r.field: (r.kind, r.is_multilabel) for r in dim.collect()} == {"contract_name": ("meta", False), "a": ("single_choice", False), "m": ("multilabel", True), "t": ("freetext", False), "n": ("multilabel", False)}
    words = fields.quote_dictionary(dim)
    assert sorted(tuple(r) for r in words.collect()) == [("a", 'say "y"', "say 'y'"), ("m", 'l"1', "l'1")]
    flat = spark.createDataFrame([("a", 'say "y"'), ("a", "x"), ("a", None), ("z", 'say "y"')], "field string, value string")
    assert sorted(map(str, (r.value for r in fields.remap(flat, words).collect()))) == sorted(["say 'y'", "x", "None", 'say "y"'])
    lists = spark.createDataFrame([("m", ['l"1', "l2", None])], "field string, value array<string>")
    assert fields.remap(lists, words).first().value == ["l'1", "l2", None]
    bad = spark.createDataFrame([("m", ["l2", "l2"]), ("m", ["zz"]), ("m", ["l2"])], "field string, labels_found array<string>")
    assert sorted((r.repeats, r.unknown) for r in fields.array_violations(bad, dim).collect()) == [(False, True), (True, False)]


def test_schema_rewrites():
    schema = {"$schema": "s", "x-note": 1, "type": "object", "properties": {"x-name": {"type": ["string", "null"], "description": "d", "minLength": 1, "uniqueItems": True}}}
    assert fields.strip_validation(schema) == {"type": "object", "properties": {}}
    assert fields.strip_annotations({"$id": 1, "a": {"uniqueItems": True, "minLength": 2}}) == {"$id": 1, "a": {"minLength": 2}}
    assert fields.for_grammar(schema)["properties"] == {"x-name": {"anyOf": [{"type": "null"}, {"type": "string", "minLength": 1}]}}
    assert fields.for_grammar({"type": ["string", "null"], "enum": ["a", None]}) == {"anyOf": [{"type": "null"}, {"type": "string", "enum": ["a", None]}]}
    assert fields.for_grammar({"type": ["string", "integer", "null"], "patternProperties": {"title": {"title": "t"}}, "default": 1}) == {"type": ["string", "integer", "null"], "patternProperties": {"title": {}}}
