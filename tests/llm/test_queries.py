"""The registered queries and the pipeline over the smallest tables, against SQL and brute force."""

import math
import os
import re
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import duckdb
import pytest
from test_quality import brute_statistics
from test_search import brute_components, brute_decontaminate, words_of
from test_tokens import reference

import corpus_pipeline
from folioflow.llm import decision_list, licenses, line_crf, mixing, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_token_queries_equal_the_library(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    want = reference(rows)
    assert [tuple(r) for r in queries.op1_token_store(spark, DATA).orderBy("doc_id").collect()] == want
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, DATA).collect()}
    assert counts == {i: (len(t.encode()), n - 1, n - 1 > 2048) for (i, t), (_, _, n, _) in zip(rows, want)}


class Article(HTMLParser):
    """The text of the article elements, read by another parser, a list of strings for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append([])
        if tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def article_of(html):
    parser = Article()
    parser.feed(html or "")
    parser.close()
    return " ".join(t for b in parser.blocks if (t := " ".join("".join(b).split())))


def test_page_and_license_queries(spark, duck):
    pages = {r[0]: article_of(r[1]) for r in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    assert {r.page_id: r.text for r in queries.op4_tag_paths(spark, DATA).collect()} == pages
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op5_licenses(spark, DATA).collect():
        w = words_of(texts[r.doc_id])
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def template_regex(template):
    """A template as a regular expression over words that each end in a blank."""
    out = []
    for t in re.findall(r"\{\w+ \d+ \d+\}|[\[\]()|]|[^\s\[\](){}|]+", template):
        if t[0] == "{":
            low, high = t[1:-1].split()[1:]
            out.append(rf"(?:\S+ ){{{low},{high}}}")
        else:
            out.append({"[": "(?:", "]": ")?", "(": "(?:", ")": ")", "|": "|"}.get(t) or re.escape(t) + " ")
    return re.compile(r"(?<!\S)(?:" + "".join(out) + ")")


def test_license_labels_equal_regular_expressions(spark, duck):
    compiled = [(label, template_regex(x)) for label, templates in licenses.TEMPLATES.items() for x in templates]
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    found = 0
    for r in queries.op5_licenses(spark, DATA).collect():
        words = "".join(w + " " for w in words_of(texts[r.doc_id]))
        want = {label for label, x in compiled if x.search(words)}
        found += bool(want)
        assert set(filter(None, r.labels.split(","))) == want | set(filter(None, r.base_labels.split(",")))
        assert (r.score == 1) == bool(want) and (not r.base_labels or r.score >= 0.5)
    assert found


def slow_score(model, text):
    """One document's score by forward and backward sums, a line at a time."""
    wide, weight = line_crf.document_features(text)
    node = [[0.0, float(x)] for x in wide @ model.node]
    n = len(node)
    forward, backward = [[0.0, 0.0] for _ in node], [[0.0, 0.0] for _ in node]
    log_sum = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    for i in range(n):
        for b in (0, 1):
            forward[i][b] = node[i][b] + (log_sum([forward[i - 1][a] + model.edge[a, b] for a in (0, 1)]) if i else 0.0)
    for i in range(n - 2, -1, -1):
        for a in (0, 1):
            backward[i][a] = log_sum([model.edge[a, b] + node[i + 1][b] + backward[i + 1][b] for b in (0, 1)])
    total = log_sum(forward[-1])
    return sum(w * math.exp(f[1] + g[1] - total) for w, f, g in zip(weight, forward, backward)) / sum(weight)


def test_quality_scores_equal_slow_ones(spark, duck):
    rows = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    model = line_crf.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    got = queries.op8_line_crf(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert r.score == pytest.approx(slow_score(model, rows[r.doc_id]), abs=1e-5)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_rules_equal_brute_force(spark, duck):
    rows = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rules = decision_list.fit(docs.select("doc_id", "text"), labels)
    got = queries.op10_decision_list(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        text = rows[r.doc_id]
        n, chars, symbols, dup, repeat = brute_statistics(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
        share = lambda a, b: a / b if b else 0.0
        features = {
            "mean_word": share(chars, n), "symbol_rate": share(symbols, chars), "upper_rate": share(sum("A" <= c <= "Z" for c in text), chars), "digit_rate": share(sum("0" <= c <= "9" for c in text), chars),
            "bang_rate": share(sum(c in "!?" for c in text), n), "dup_line_rate": share(dup, lines), "repeat_rate": share(repeat, n), "distinct_rate": share(len(set(words)), n),
        }
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert r.kept == (not failed and not any(all((features[c.feature] >= c.threshold) == c.at_least for c in rule) for rule in rules))


def test_mixing_query_equals_a_slow_schedule(spark, duck):
    rows = duck.sql("SELECT doc_id, source, length(text) + 1 FROM documents").fetchall()
    hashed = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "xxhash64(cast(doc_id AS string))").collect()}
    size: dict = {}
    for _, source, n in rows:
        size[source] = size.get(source, 0) + n
    total = sum(Fraction(float(n) ** 0.5) for n in size.values())
    share = {k: Fraction(float(n) ** 0.5) / total for k, n in size.items()}
    blocks = {k: (n - 1) // mixing.BLOCK + 1 for k, n in size.items()}
    slots: dict = {k: [] for k in size}
    slot = 0
    while any(len(slots[k]) < blocks[k] for k in slots):  # every slot looks at every source
        ready = [(math.ceil((len(slots[k]) + 1) / share[k]), str(k), k) for k in slots if len(slots[k]) < blocks[k] and math.floor(len(slots[k]) / share[k]) <= slot]
        if ready:
            slots[min(ready)[2]].append(slot)
        slot += 1
    want, before = {}, dict.fromkeys(size, (0, 0))
    for i, source, n in sorted(rows, key=lambda r: (hashed[r[0]], r[0])):
        place, at = before[source]
        j = at // mixing.BLOCK
        want[i] = (source, j, slots[source][j], math.floor(j / share[source]), math.ceil((j + 1) / share[source]), place)
        before[source] = (place + 1, at + n)
    got = {r.doc_id: (r.source, r.block, r.slot, r.release, r.deadline, r.place) for r in queries.op9_mixing(spark, DATA).collect()}
    assert got == want


def test_pipeline_equals_brute_force(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = line_crf.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = duck.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    kept = [r for r, s in zip(rows, model.scores([r[1] for r in rows])) if s >= line_crf.THRESHOLD]
    component = {i: c for i, _, c in brute_components([r[:2] for r in kept])}
    kept = [r for r in kept if component[r[0]] == r[0]]
    dirty = {r[0] for r in brute_decontaminate([r[:2] for r in kept], duck.sql("SELECT item_id, text FROM benchmark").fetchall()) if r[-1]}
    kept = [r for r in kept if r[0] not in dirty]
    left = spark.createDataFrame(kept, "doc_id long, text string, source string")
    order = {r.doc_id: (r.slot, r.place) for r in mixing.mix(left).select("_row.doc_id", "slot", "place").collect()}
    want = reference([r[:2] for r in sorted(kept, key=lambda r: order[r[0]])])
    assert [tuple(r) for r in corpus_pipeline.run(spark, DATA).orderBy("start").collect()] == want
    assert 0 < len(want) < len(rows)


def test_stages_keep_columns_and_survive_odd_rows(spark, odd):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns
        assert stage(spark, odd.limit(0), DATA).count() == 0
    once = corpus_pipeline.near_duplicate(spark, odd, DATA)
    assert once.where("doc_id = 3").count() == 1 and once.where("doc_id IS NULL").count() == 1


def test_near_duplicate_stage_goes_by_rows_not_ids(spark, docs):
    words = [f"w{i}" for i in range(120)]
    a, near, nearer, b = " ".join(words), " ".join([*words, "x"]), " ".join([*words, "y", "z"]), " ".join(f"v{i}" for i in range(80))
    rows = [(1, near), (5, a), (5, b), (5, b), (None, a), (8, None), (8, None), (9, "")]
    left = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, docs(rows), DATA).collect()), key=str)
    assert left(rows) == sorted([(1, near), (5, b), (8, None), (8, None), (9, "")], key=str)
    assert left([(1, a), (7, a), (7, b)]) == [(1, a), (7, b)]
    for one in ([(7, a), (7, near), (7, nearer)], [(None, a), (None, near), (None, near), (None, nearer)]):
        (row,) = left(one)
        assert row in one
