import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import scalars
from folioflow.operators import chunking, corpus, extract, grounding, patterns, pins, ranks

words = st.sampled_from(["Article II ", "ARTICLE 4", "\n1.2 x", "\nSection 3.4 ", "\n \n", ". A", ". b", "word ", " ", "😀", "\r\n", "x" * 7])


PATTERNS = {
    "article": re.compile(r"\b(?:ARTICLE|Article)\s+(?:[IVX]+|\d+)\b"),
    "section": re.compile(r"\n\s*(?:Section|SECTION)?\s*\d+\.\d+\b"),
    "paragraph": re.compile(r"\n\s*\n"),
    "sentence": re.compile(r"\.\s+(?=[A-Z\"'])"),
}


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=25).map("".join), st.integers(0, 30), st.integers(0, 90))
def test_boundary_is_the_last_match_of_the_best_kind(text, low, high):
    low, high = min(low, len(text)), min(high, len(text))
    found = {kind: [m.start() for m in p.finditer(text, low, high)] for kind, p in PATTERNS.items()}
    assert chunking.boundary(text, low, high) == next(((x[-1], kind) for kind, x in found.items() if x), (high, "hard"))


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=60).map("".join), st.integers(1, 60), st.integers(0, 30), st.integers(0, 40))
def test_spans_cover_the_text_in_order(text, target, backoff, overlap):
    cut = chunking.spans(text, target, backoff, overlap)
    assert bool(cut) == bool(text)
    for a, b in zip(cut, cut[1:]):
        assert b.start == max(a.end - overlap, a.start + 1) and b.start <= a.end
    for s in cut:
        assert 0 < s.end - s.start <= target
        if s.kind not in ("eof", "hard"):
            assert s.end >= max(s.start + target - backoff, s.start + 1)
            assert PATTERNS[s.kind].match(text, s.end, s.start + target)
    if cut:
        assert cut[0].start == 0 and cut[-1].end == len(text) and cut[-1].kind == "eof"


@pytest.mark.parametrize(
    ("text", "end", "kind"),
    [("a" * 24 + " Article II b" + "c" * 40, 25, "article"), ("a" * 25 + "\n1.2 bb" + "c" * 40, 25, "section"), ("a" * 25 + "\n \nb" + "c" * 40, 25, "paragraph"), ("a" * 25 + ". Bb" + "c" * 40, 25, "sentence"), ("a" * 80, 40, "hard"), ("a" * 22 + " Article 1 . B" + "c" * 40, 23, "article"), ("a" * 24 + "xArticle I b" + "c" * 40, 40, "hard")],
)
def test_boundary_kinds(text, end, kind):
    # The best kind wins over a later boundary of another kind; a word boundary sees what stands before the window.
    s = chunking.spans(text, 40, 20, 2)[0]
    assert (s.end, s.kind) == (end, kind)


def test_white_space_without_end_is_survived():
    began = time.time()
    for text in ("\n" * 200_000, "\n" + " " * 200_000, ". " * 100_000, "Article " * 25_000, "\n1" * 100_000):
        assert chunking.spans(text)[-1].end == len(text)
    assert time.time() - began < 20


def test_no_boundary_needed_up_to_the_target():
    assert [(s.start, s.end, s.kind) for s in chunking.spans("a" * 20, 20, 8, 2)] == [(0, 20, "eof")]
    assert chunking.spans("", 20, 8, 2) == []


def test_closed_form_equals_the_loop(spark):
    rng = random.Random(5)
    texts = [(i, "x" * rng.choice([0, 1, 5, 9, 10, 11, 19, 20, 37])) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in chunking.fixed_chunks(df, target=10, overlap=3).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.boundary_kind))
    for i, text in texts:
        if text is None or not text:
            assert i not in got
            continue
        loop, at = [], 0
        while True:
            end = min(at + 10, len(text))
            loop.append((at, end, "eof" if end == len(text) else "hard"))
            if end == len(text):
                break
            at = end - 3
        assert got[i] == loop
    whole = chunking.chunk(df, target=10, backoff=4, overlap=3)
    assert whole.where("doc_id = 99").count() == 0 and whole.where("n_chars <> length(text)").count() == 0


def test_order_statistics_are_neither_interpolated_nor_discrete(spark):
    places = {"p50": 0.5, "p95": 0.95}
    assert tuple(scalars.order_statistics(spark.range(1, 21), [], "id", places).first()) == (11, 20)
    assert tuple(scalars.order_statistics(spark.range(0), [], "id", places).first()) == (None, None)
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, *range(6)])) for _ in range(200)] + [("none", None)]
    got = {r.g: (r.p50, r.p95) for r in scalars.order_statistics(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", places).collect()}
    for g in {r[0] for r in rows}:
        s = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (tuple(s[min(int(len(s) * p), len(s) - 1)] for p in places.values()) if s else (None, None))


def test_scalars(spark):
    row = spark.createDataFrame([("héllo wörld\nlast  line", "e1_a_b", "gold=/p=q:nocopy", "one <omitted> two<omitted>")], "t string, n string, s string, e string")
    stage, variation = scalars.stage_and_variation("n")
    r = row.select(
        scalars.approx_tokens("t").alias("tokens"), scalars.preview("t").alias("preview"), scalars.value_display(F.lit(None)).alias("none"), stage.alias("stage"), variation.alias("variation"),
        scalars.input_spec("s").alias("spec"), scalars.split_evidence("e").alias("spans"), scalars.chunk_header(F.lit("n"), F.lit(0), F.lit(2), F.lit("x")).alias("head"), scalars.chat_messages(F.lit("s"), F.lit("u"), (F.lit("q"), F.lit("a"))).alias("chat"),
    ).first()
    assert (r.tokens, r.preview, r.none, r.stage, r.variation) == (5, "last line", "null", "e1", "a_b")
    assert tuple(r.spec) == ("gold", "/p=q", False) and r.spans == ["one", "two"] and r.head == "Contract: n\nChunk 1 of 2\n\nx"
    assert [m.role for m in r.chat] == ["system", "user", "assistant", "user"]


def test_percents_round_as_python_does(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2_000), rng.choice([1, 3, 7, 16, 40, 80, 400, 1000, 2000])) for _ in range(3_000)] + [(0, 5), (9, 16), (11, 16), (5, 0)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", scalars.percent_text("k", "n").alias("p")).collect()
    assert all(r.p == ("—" if r.n == 0 else f"{100 * r.k / r.n:.1f}%") for r in got)


def test_json_lexer(spark):
    df = spark.createDataFrame([('{"a": "x\\"y  ',), ('{"a":   ',), ("",), ('"\\\\"',)], "t string")
    got = [tuple(r.s) for r in df.select(scalars.json_structure("t").alias("s")).collect()]
    assert got == [(True, False, 0), (False, False, 3), (False, False, 0), (False, False, 0)]


def test_samples_and_splits(spark):
    names = spark.createDataFrame([(f"c{i:03d}",) for i in range(40)], "contract_name string")
    ordered = [f"c{i:03d}" for i in range(40)]
    assert [r[0] for r in corpus.exact_sample(names, 5).orderBy("contract_name").collect()] == sorted(random.Random(42).sample(ordered, 5))
    random.Random(42).shuffle(ordered)
    want = {x: "train" if i < 32 else "val" if i < 36 else "test" for i, x in enumerate(ordered)}
    assert {r.contract_name: r.split for r in corpus.exact_split(names.union(names)).collect()} == want
    assert corpus.exact_sample(names.limit(0)).count() == corpus.exact_split(names.limit(0)).count() == 0
    assert corpus.hash_sample(names, "contract_name", 7).count() == 7
    twice = corpus.hash_split(names.union(names), "contract_name")
    assert twice.groupBy("contract_name").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    usable, excluded = corpus.evaluation_sample(names.limit(3), names.where("contract_name > 'c000'"))
    assert usable.count() + excluded.count() == 3
    fill = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9)], "contract_name string, n_non_null int")
    assert corpus.one_shot(fill, fill.where("contract_name = 'c'")).first().contract_name == "a"


def test_resume_and_limits(spark):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "ordinal long, contract_name string")
    done = rows.where("ordinal < 2")
    assert corpus.todo(rows, done, ["contract_name"], limit=3).count() == 1
    assert corpus.todo(rows, done, ["contract_name"], limit=0).count() == 0
    assert corpus.todo(rows, done, ["contract_name"]).count() == 3
    assert corpus.pick(rows, name="c1", line=4).first().contract_name == "c4"


def test_drift(spark):
    pinned = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", "4", "d2"), ("e", "5", "e2")], "path string, sha256 string, snapshot string")
    now = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("e", "5"), ("e2", "y")], "path string, sha256 string")
    found = pins.drift(pinned, now)
    assert {r.path: r.status for r in found.collect()} == {"a": "match", "b": "mismatch", "c": "missing", "d": "snapshot_missing", "e": "snapshot_drift"}
    assert pins.exit_code(found) == 2 and pins.exit_code(found.where("path = 'a'")) == 0


def test_extraction_retries_and_clears_errors(spark):
    calls = []

    def flaky(system, user):
        calls.append(user)
        if len(calls) == 1:
            raise RuntimeError("busy")
        return ("{" if len(calls) == 2 else "{}"), {"output_tokens": 1}

    r = extract.extract_one(flaky, "s", "u", pause=0)
    assert (r["prediction"], r["attempts"], r["error"]) == ("{}", 3, None)
    bad = extract.extract_one(lambda s, u: ("nope", {}), "s", "u", pause=0)
    assert bad["prediction"] is None and bad["raw"] == "nope" and bad["error"].startswith("JSONDecodeError")
    legal = {0: [1, 2], 1: [3], 2: [0]}
    assert extract.constrained_decode(lambda out: [0, 1, 5, 0], lambda out: legal.get(len(out), []), end=0) == [2, 3]
    # Once two blanks stand between tokens, another is not legal; inside a string it is.
    surface = {0: "", 1: " ", 2: '"', 3: "x"}.__getitem__
    eager = {0: 0.0, 1: 9.0, 2: 1.0, 3: 0.5}
    decode = lambda **kw: extract.constrained_decode(lambda out: eager, lambda out: [1, 2, 3], end=0, most=7, **kw)
    assert decode() == [1] * 7 and decode(surface=surface, blanks={1}) == [1, 1, 2, 1, 1, 1, 1]
    assert decode(surface=surface, blanks={1}, most_blanks=0) == [1] * 7
    assert [extract.open_blanks(x) for x in ("", '{"a": ', '{"a', '{"a\\"  ', '{"a\\\\"  ', ' \t "x"\n\n')] == [0, 1, -1, -1, 2, 2]


def test_blank_tokens(spark):
    vocabulary = spark.createDataFrame([(" ", 1), ("a", 2), ("\n", 3), ("", 4), ("ĠĊ\t", 5), (None, 6), ("Ġx", 7)], "token string, id int")
    assert sorted(r.id for r in extract.blank_tokens(vocabulary).collect()) == [1, 3, 5]


def test_global_ranks(spark):
    rng = random.Random(3)
    rows = [("x" * rng.randrange(3) + rng.choice(["a", "é", "日", "😀", "Z"]), i) for i in range(300)] + [(None, 300), (None, 301)]
    got = ranks.global_ranks(spark.createDataFrame(rows, "name string, i long").repartition(7), "name", "i").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.name, r.i) for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(302))


def test_passages_equal_containment(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab \n日é😀") for _ in range(n))
    docs = [(i, text(rng.randrange(400))) for i in range(30)] + [(30, None), (31, ""), (7, "again"), (7, "again")]
    spans = [(i, text(n)) for i, n in enumerate([1, 1, 2, 3, 5, 8])] + [(10 + i, d[s : s + n]) for i, (_, d) in enumerate(docs[:12]) for s, n in ((3, 20), (0, 40), (5, 90))]
    spans += [(90, docs[2][1]), (91, docs[2][1]), (91, docs[2][1]), (92, ""), (93, None), (94, "again"), (None, "a")]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(spans, "item long, span string")
    want = sorted(((i, d) for i, s in set(spans) if s for d, x in docs if x is not None and s in x), key=str)
    for options in ({}, {"block_anchors": 60}, {"block_bytes": 200}):
        assert sorted((tuple(r) for r in patterns.passages_in(table, frame, **options).collect()), key=str) == want
    assert patterns.passages_in(table.limit(0), frame).count() == 0 == patterns.passages_in(table, frame.limit(0)).count()
    alike = ["p" * 40 + str(i) for i in range(500)] + ["p" * 40, "p" * 32]
    find = patterns.compile_passages(alike)
    assert {alike[i] for i in find("xx" + "p" * 40 + "123" + "x")} == {x for x in alike if x in "p" * 40 + "123"}


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "beta gamma delta"), (2, "thing"), (3, ""), (4, None)], "item long, span string")
    assert sorted(tuple(r) for r in patterns.passages_in(spans, docs).collect()) == [(1, 1), (2, 2)]
    cells = spark.createDataFrame([("c", 0, "f", "1"), ("c", 1, "f", "2"), ("c", 0, "g", "1"), ("c", 1, "g", None)], "contract_name string, chunk_id int, field string, value_json string")
    assert tuple(grounding.contradictions(cells).first()) == ("c", 1, 2)
