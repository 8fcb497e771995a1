"""Fill-in-middle, packing and lexical search against slow versions."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_tokens import reference

from folioflow.llm import fill_middle, lexical_search, packing, queries
from folioflow.llm.common import scratch

DATA = "/root/testdata/sf0.001"
TEXTS = ["", "a", "two words", "  lead and trail \n", "héllo wörld\n\nœuvre ß 日本語 \U0001f600x\n", "holds <S> a mark", "<P", "S>", "\n", "tab\tand\x0bfeed", "x" * 300 + "\n" + "é" * 50]


# ---------------------------------------------------------------- fill in the middle


def slow_units(text, unit):
    return {"character": lambda: list(text), "word": lambda: re.findall(r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", text), "line": lambda: re.findall(r"[^\n]*\n|[^\n]+", text)}[unit]()


def slow_fill(doc_id, text, unit="character", seed=1):
    text = text or ""
    parts = slow_units(text, unit)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_fill_in_middle_equals_a_slow_version(spark, docs, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id"), (7, None), (7, None), (900, "repeated row"), (900, "repeated row")]
    made = fill_middle.fill_in_middle(docs(rows), unit=unit, carry=["doc_id", "text"]).withColumn("back", fill_middle.restored())
    got = [(r._row.doc_id, r._row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()]
    assert sorted(got, key=str) == sorted([(i, t, *slow_fill(i, t, unit), t or "") for i, t in rows], key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_rows_and_marks(spark, odd):
    columns = odd.withColumns({c: F.lit("x") for c in ("n", "form", "output", "prefix_chars", "_draws")})
    made = fill_middle.fill_in_middle(columns).withColumn("back", fill_middle.restored())
    assert sorted(made.select("_row").first()._row.asDict()) == sorted(columns.columns)
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_fill(r._row.doc_id, r._row.text) and r.back == (r._row.text or "")
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0
    other = fill_middle.fill_in_middle(odd, marks=("\u0001pre", "\u0001suf", "\u0001mid"), plain=0)
    assert other.where(fill_middle.restored(marks=("\u0001pre", "\u0001suf", "\u0001mid")) != F.coalesce("_row.text", F.lit(""))).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("<a<", "<S>", "<M>"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(odd, marks=marks)


# ---------------------------------------------------------------- packing


def slow_assign(lengths, capacity, linear, quadratic):
    """Lists instead of arrays: longest rest first, lowest cost with room, else lowest cost with any room."""
    pieces, rests = [], []
    for i, n in enumerate(lengths):
        while n > capacity or n == capacity:
            pieces.append((i, sum(p[2] for p in pieces if p[0] == i), capacity, len(pieces), 0))
            n -= capacity
        rests.append(n)
    whole, total = len(pieces), sum(rests)
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(20)) if total % capacity >> b & 1]
    used, cost = [0] * len(room), [0] * len(room)
    for i in sorted(range(len(rests)), key=lambda i: (-rests[i], i)):
        left, start = rests[i], lengths[i] - rests[i]
        while left:
            fits = [j for j in range(len(room)) if room[j] - used[j] >= left] or [j for j in range(len(room)) if room[j] > used[j]]
            j = min(fits, key=lambda j: (cost[j], j))
            n = min(left, room[j] - used[j])
            pieces.append((i, start, n, whole + j, used[j]))
            used[j], cost[j], start, left = used[j] + n, cost[j] + linear * n + quadratic * n * n, start + n, left - n
    assert used == room
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_assignment_equals_a_slow_one(seed):
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 40, 60), r.integers(1, 400, 8), np.full(10, 1)])
    pieces, room, cost = packing.assign(lengths, 64, 12, 1)
    assert sorted(map(tuple, pieces.tolist())) == sorted(slow_assign(lengths.tolist(), 64, 12, 1))
    for j in range(len(room)):
        assert cost[j] == sum(12 * p[2] + p[2] ** 2 for p in pieces.tolist() if p[3] == j)
    full = cost[room == 64]
    assert full.max() <= 12 * 64 + 64 * 64 and len(packing.assign(np.array([], np.int64))[0]) == 0


def check_pieces(pieces, rows):
    """Every id in one piece, sequences without gaps, no padding but by powers of two, checksums of the library's ids."""
    want = {i: (n, crc) for i, _, n, crc in reference(rows)}
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: n for i, (n, _) in want.items()}
    at: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.length > 0
        at[r.doc_id] = r.start + r.length
        if r.length == r.doc_tokens:
            assert r.ids_crc32 == want[r.doc_id][1]
    assert at == {i: n for i, (n, _) in want.items()}
    end: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or (n < 4096 and n & (n - 1) == 0) for n in end.values())
    return end


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    end = check_pieces(queries.op12_packing(spark, DATA).collect(), rows)
    assert sum(n == 4096 for n in end.values()) >= sum(end.values()) // 4096 - 4


def test_packing_odd_rows_and_long_texts(spark, odd, docs):
    pieces = packing.pack(odd).collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id == 3 else 1) for r in pieces}.values())
    assert [r.doc_tokens for r in pieces if r.doc_id in (1, 2)] == [1, 1] and any(r.doc_id is None for r in pieces)
    assert packing.pack(odd.limit(0)).count() == 0 and packing.sequences(odd.limit(0)).count() == 0
    rows = [(1, "lorem ipsum dolor sit amet " * 9_000), (2, "one"), (3, None), (4, "\n"), (5, "Ünïcode 日本 don't")]
    frame = docs(rows).coalesce(1)
    made = packing.pack(frame).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(made.collect(), rows)
    ids: dict = {}
    for r in sorted(made.collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert {i: zlib.crc32(x) for i, x in ids.items()} == {i: crc for i, _, _, crc in reference(rows)}
    joined = {r.sequence_id: b"" for r in made.collect()}
    for r in sorted(made.collect(), key=lambda r: (r.sequence_id, r.offset)):
        joined[r.sequence_id] += bytes(r.ids)
    for s in packing.sequences(frame).collect():
        assert struct.pack(f"<{len(s.ids)}I", *s.ids) == joined[s.sequence_id] and s.tokens == len(s.ids) == sum(s.lengths)
        assert s.cost == sum(packing.LINEAR * n + packing.QUADRATIC * n * n for n in s.lengths) and len(s.doc_ids) == len(s.lengths)


# ---------------------------------------------------------------- lexical search


def slow_terms(text):
    return re.findall(lexical_search.TERMS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(rows, items, k=10):
    terms = [(i, Counter(slow_terms(t))) for i, t in rows]
    terms = [x for x in terms if x[1]]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(slow_terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for i, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_a_slow_one(spark, docs, odd):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Émile", "日本", "don't", "x_y"]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 40)))) for i in range(150)]
    rows += [(200 + i, "alike alike w1") for i in range(40)] + [(300, None), (301, ""), (None, "alike w2"), (302, "alike alike w1"), (302, "alike alike w1"), (303, "W1-w2 " * 3_000)]
    items = [(1, "w1 w2 W3, unknown"), (2, "alike"), (3, None), (4, ""), (5, "nowhere"), (None, "w9 émile"), (6, "Émile 日本 don't"), (7, "w1"), (7, "w4"), (7, "w4")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 5):
        index = lexical_search.build_index(docs(rows).repartition(parts, "doc_id"), scratch(spark, "index"))
        for options in ({}, {"block_bytes": 40}, {"k": 3}):
            got = lexical_search.search(index, table, **options)
            assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == slow_search(rows, items, options.get("k", 10))
    opened = lexical_search.open_index(spark, index.shards.inputFiles()[0].rpartition("/shards/")[0])
    assert (opened.n_docs, opened.n_terms) == (index.n_docs, index.n_terms) and lexical_search.search(opened, table).count() > 30
    found = [(x.doc_id, x.text) for x in odd.select("doc_id", "text").collect()]
    ask = [(1, "lorem friend héllo"), (2, "日本")]
    index = lexical_search.build_index(odd, scratch(spark, "index"))
    got = lexical_search.search(index, spark.createDataFrame(ask, "item_id long, text string").withColumns({"score": F.lit(1), "term": F.lit("x"), "rank": F.lit(None)}))
    assert sorted(map(tuple, got.collect()), key=str) == slow_search(found, ask)
    empty = lexical_search.build_index(odd.limit(0), scratch(spark, "index"))
    assert lexical_search.search(empty, table).count() == 0 and lexical_search.search(index, table.limit(0)).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(lexical_search, "AT_ONCE", 50)
    texts = ["short one", "alpha Beta " * 60 + "x" * 200 + " gamma", None, "alpha"]
    names = dict(zip(lexical_search.SHARD, lexical_search.make_shard(pa.array([4, 2, None, 1]), pa.array(texts))))
    assert names["ids"].to_pylist() == [1, 2, 4, None] and (names["n_docs"], names["n_terms"]) == (3, 125)
    terms = lexical_search._shard_terms(names["terms"], names["ends"]).to_pylist()
    rows, docs, tf = (np.frombuffer(names[c], t) for c, t in (("rows", "<u4"), ("docs", "<u2"), ("tf", "<u4")))
    got = {(terms[i].decode(), names["ids"][int(docs[j])].as_py()): int(tf[j]) for i in range(len(terms)) for j in range(rows[i], rows[i + 1])}
    assert got == {(w, i): n for i, t in zip([4, 2, None, 1], texts) for w, n in Counter(slow_terms(t)).items()}


def test_impacts_beyond_64_bits():
    lengths, docs, tf = np.array([2_000_000_000, 5]), np.array([0, 1], np.uint16), np.array([3, 1], np.uint32)
    n, total = 10**11, 10**14
    want = [(10**9 * t) // (1000 * t + 8 * (10 + 90 * int(x) * n // total)) for x, t in zip(lengths, (3, 1))]
    assert lexical_search.impacts_of(lengths, docs, tf, n, total).tolist() == want


def test_shards_are_read_a_few_at_a_time(docs, spark, tmp_path):
    """A task's shards are in row groups of bounded size, however many there are: a row group is in a reader's memory whole."""
    text = " ".join(map(str, range(200_000)))
    rows = docs([(i, text) for i in range(40)]).coalesce(1)
    index = lexical_search.build_index(rows, f"file://{tmp_path}/index")
    sizes = []
    for path in (tmp_path / "index" / "shards").glob("*.parquet"):
        about = pq.ParquetFile(path).metadata
        sizes += [(about.row_group(i).num_rows, about.row_group(i).total_byte_size) for i in range(about.num_row_groups)]
    assert sum(n for n, _ in sizes) == index.shards.count() > 4
    assert max(size for _, size in sizes) < 32 << 20
