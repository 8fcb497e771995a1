import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decision_list as dl
from folioflow.llm import line_crf


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_equal_brute_force(docs, odd):
    rng = random.Random(1)
    bits = ["a", "b", "a b c", "\n", " ", "\t", "é#", "<x>", "日本", "\r\n", "\x0b", "[", "]", "^-"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    for df in (docs(rows), odd):
        for r in dl.apply_rules(df, []).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r._row.text)
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and r.kept == (not failed)
    assert dl.apply_rules(odd.limit(0), []).count() == 0


def sample_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    out = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(30)) + "." for _ in range(4)]
        kind = i % 8
        if kind == 0:
            lines = [x.replace(" ", "### ") for x in lines]
        if kind == 1:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        out.append((i, "\n".join(lines), int(kind > 1)))
    return out


def test_learned_list_rejects_bad_and_keeps_good(spark, docs):
    rows = sample_texts()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows])
    rules = dl.fit(df, labels)
    assert rules
    got = {r._row.doc_id: r.kept for r in dl.apply_rules(df, rules).collect()}
    truth = {i: bool(q) for i, _, q in rows}
    assert all(got[i] for i in truth if truth[i])
    assert sum(not got[i] for i in truth if not truth[i]) >= 0.95 * sum(not v for v in truth.values())
    assert dl.fit(df, labels.limit(0)) == []


def test_rules_are_native(docs):
    plan = dl.apply_rules(docs([(1, "x")]), [(dl.Condition("symbol_rate", True, 0.5),)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_marginals(crf, scores):
    n, total = len(scores), 0.0
    good = np.zeros(n)
    for y in product((0, 1), repeat=n):
        p = np.exp(sum(s for s, v in zip(scores, y) if v) + sum(crf.edge[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total


def test_long_texts_are_scored_as_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    crf = line_crf.LineCRF(rng.normal(size=3 * line_crf.OWN), np.clip(rng.normal(size=(2, 2)), -2, 2))
    for n in (1, 2, 3, 4, 5, 9, 10, 16, 17, 50, 1_000):
        scores = rng.normal(size=n) * rng.choice([0.1, 5, 60])
        good, none, _ = crf.marginals(scores[None], np.array([n]), with_pairs=False)
        assert none is None and np.allclose(good[0], line_crf.chain_marginals(scores, crf.edge))
    lines = ["", "same line", "same line", "A b c d, e!", "12 34 | 5", "é ü", "# * $"]
    texts = ["\n".join(rng.choice(lines + [f"line {k}" for k in range(9)], size=n)) for n in (1, 7, 40, 300)] + ["", None, "\n" * 50]
    want = crf.scores(texts)
    monkeypatch.setattr(line_crf, "LONG", 6)
    assert crf.scores(texts) == pytest.approx(want, abs=1e-6)


def test_repeated_ids_do_not_change_the_rules(docs):
    rows = [(i, ("good plain words here " * 20 + f"n{i}") if i % 2 else ("bad !!! $$$ ### " * 20 + f"n{i}")) for i in range(60)]
    labels = docs([(0, "x")]).sparkSession.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = dl.fit(docs(rows), labels)
    again = dl.fit(docs(rows + [rows[3]] * 400 + [(4, "zzz " * 60)] * 400), labels)
    assert once == again


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    crf = line_crf.LineCRF(np.zeros(3 * line_crf.OWN), rng.normal(size=(2, 2)))
    sizes = np.array([1, 2, 5, 7])
    scores = np.zeros((4, 7))
    for i, k in enumerate(sizes):
        scores[i, :k] = rng.normal(size=k)
    good, pairs, _ = crf.marginals(scores, sizes)
    for i, k in enumerate(sizes):
        assert np.allclose(good[i, :k], brute_marginals(crf, scores[i, :k]))
        assert np.allclose(pairs[i].sum(), k - 1)


def test_crf_learns_and_holds_out(spark, docs):
    rows = sample_texts()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    df = docs([(i, t) for i, t, _ in rows])
    model = line_crf.fit(df, labels)
    truth = {i: q for i, _, q in rows}
    scored = line_crf.score(df, model).withColumn("held", line_crf.held_out(F.col("_row.doc_id"))).collect()
    import zlib

    assert all(r.held == (zlib.crc32(str(r._row.doc_id).encode()) % 5 == 0) for r in scored)
    held = [(r.predicted, truth[r._row.doc_id]) for r in scored if r.held]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    kept = line_crf.score(df, model, only_kept=True)
    assert kept.count() == sum(r.predicted for r in scored)


def test_held_out_labels_and_other_columns_do_not_matter(spark, docs):
    rows = sample_texts()
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    df = docs([(i, t) for i, t, _ in rows])
    a = line_crf.fit(df, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = line_crf.fit(df, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.array_equal(a.node, b.node)


@pytest.mark.parametrize("empty", [False, True])
def test_crf_of_odd_rows(odd, empty):
    model = line_crf.train([], [])
    df = odd.limit(0) if empty else odd
    got = line_crf.score(df, model).collect()
    assert len(got) == df.count() and all(r.score == 0.5 for r in got)
