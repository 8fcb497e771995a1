import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import decontaminate as dec
from folioflow.llm import licenses
from folioflow.llm import parity_join as pj


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_decontaminate(docs, items, k=10):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, passage in items:
            v = words_of(passage)
            if item is None:
                continue
            for a in range(max(1, len(v) - k + 1) if v else 0):
                win = v[a : a + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [dec.BLOCK, 0])
def test_decontamination_equals_brute_force(spark, docs, block):
    rng = random.Random(4)
    vocabulary = ["A", "b", "ç", "D9", "e", "ff"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (None, "b b"), (0, text(12))]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(90 + i, text(8) + ", " + p.upper() + " " + text(5)) for i, (_, p) in enumerate(items) if p] + [(80, None), (81, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.decontaminate(docs(rows), bench, block=block).select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_decontaminate(rows, items)


@pytest.mark.parametrize("block", [dec.BLOCK, 0])
def test_decontamination_of_odd_rows(spark, odd, block):
    odd = odd.selectExpr("*", "2 AS _key", "3 AS items", "4 AS _spans")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(odd, none, block=block).where("contaminated").count() == 0
    one = spark.createDataFrame([(1, "no id here friend")], "item_id long, text string")
    found = dec.decontaminate(odd, one, block=block)
    assert found.where("contaminated").count() == 1 and found.count() == odd.count()
    assert found.select("_row.*").columns == odd.columns
    assert dec.decontaminate(odd.limit(0), one, block=block).count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 3)], "item_id long, text string")
    for r in dec.decontaminate(odd, long, block=block).where("_row.doc_id = 3").select("n_words", "n_hit", "items").collect():
        assert (r.n_words, r.n_hit, r["items"]) == (40_000, 40_000, ["1"])


def test_index_is_small_beside_its_texts(docs):
    rng = random.Random(8)
    items = [(str(i), " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200))) for i in range(300)]
    index = dec.build_index(items, docs([(1, items[0][1])]), "text", 10)
    held = sum(x.nbytes for x in (index.vocabulary, index.words, index.keys, index.offset, index.start, index.size, index.item))
    assert held < 6 * sum(len(t) for _, t in items)


def brute_components(rows):
    sets = []
    for _, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, shared = [], text(60)
    for i in range(14):
        base = text(rng.choice([3, 5, 6, 9, 20, 60, 130, 300, 500]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(max(1, len(copy) // 30) + 2)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["new"], [copy[k], "more"]])
            rows.append((len(rows), (" " if rng.random() < 0.5 else "\n").join(copy).upper()))
    rows += [(500 + i, " ".join(shared + text(90))) for i in range(12)]  # a passage in common, not more
    hot = text(150)
    for i in range(40):  # more than one bucket gives all pairs of
        copy = list(hot)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows.append((600 + i, " ".join(copy)))
    rows += [(700, None), (701, ""), (702, " \t"), (703, "one two"), (704, "ONE  two"), (None, rows[0][1]), (0, rows[0][1])]
    for hot in (pj.HOT, 3):  # values that more rows have are split
        got = sorted((tuple(r) for r in pj.near_duplicates(docs(rows).repartition(3), hot=hot).collect()), key=str)
        assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd):
    got = pj.near_duplicates(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.where("doc_id = 3").collect()} == {3}
    assert pj.near_duplicates(odd.limit(0)).count() == 0


def sets_of(texts):
    flat, first = pj.shingle_sets(pa.array(texts, pa.string()))
    return [flat[a:b] for a, b in zip(first[:-1], first[1:])]


def test_shingle_sets_equal_brute_force():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abAB") for _ in range(rng.randrange(12))) + rng.choice(["", " ", "\n"]) for _ in range(200)] + [None, "", "x" * 100 + " y"]
    sets = [tuple(s.tolist()) for s in sets_of(texts)]
    want = []
    for t in texts:
        w = (t or "").lower().split()
        want.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    assert [len(s) for s in sets] == [len(x) for x in want]
    assert all((a == b) == (x == y) for a, x in zip(sets, want) for b, y in zip(sets, want))
    flat, first = pj.shingle_sets(pa.array(texts, pa.string()))
    prints = [tuple(p) for p in pj.fingerprints(flat, first).tolist()]
    assert all((a == b) == (x == y) for a, x in zip(prints, sets) for b, y in zip(prints, sets))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 3, 5, 40, 200, 900, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
        for share in (0.75, 0.8, 0.9, 1.0):
            keep = int(np.ceil(len(a) * share**0.5))
            b = np.unique(np.concatenate([a[:keep], rng.integers(0, 1 << 63, max(0, n - keep) // 2, dtype=np.uint64)]))
            d = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            if 7 * d > len(a) + len(b):
                continue
            flat, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            x, y = (np.frombuffer(s, np.uint64)[None] for s in pj.folded_sketches(flat, first))
            words = min(x.shape[1], y.shape[1])
            assert int(np.bitwise_count(pj.folded(x, words) ^ pj.folded(y, words)).sum()) <= d <= (len(a) + len(b)) // 7
            keys, edges, view, g = pj.block_keys(flat, first)
            sizes = np.diff(first)
            top = int(pj.band(np.array([sizes.max()]))[0])
            own = {int(v): set(keys[lo:hi].tolist()) for v, h, lo, hi in zip(view, g, edges[:-1], edges[1:]) if h == top}
            limit = {int(v): int(k) for v, h, k in zip(view, g, pj.bounds(sizes, view, g)) if h == top}
            assert set(own) == {0, 1}  # both are in the band of the larger
            for v, other in ((0, 1), (1, 0)):
                assert d <= limit[v] and len(own[v] - own[other]) <= d
                assert set(sorted(own[0])[: limit[0] + 1]) & set(sorted(own[1])[: limit[1] + 1])


def test_unlike_sketches_are_far_apart():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.unique(np.concatenate([sets[0][:150], sets[1][:150]])))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = [(len(s), i, x) for i, (s, x) in enumerate(zip(sets, pj.folded_sketches(np.concatenate(sets), first)))]
    assert [h.tolist() for h in pj.near_by_sketch(rows[:1], rows[1:])] == [[False], [False, False]]
    assert [h.tolist() for h in pj.near_by_sketch(rows[:2], [(300, 9, rows[0][2])])] == [[True, False], [True]]
    assert [h.tolist() for h in pj.near_by_sketch(rows[:1], [(300, 0, rows[0][2])])] == [[False], [False]]


def near_copies(rng, texts, edits):
    out = []
    for words in texts:
        copy = list(words)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_hubs_with_several_groups_under_them_equal_brute_force(docs, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(pj, "ALL_PAIRS", 4)
    monkeypatch.setattr(pj, "BLOCK", 400)
    common = [f"c{i}" for i in range(45)]  # in all of them, and most of each
    groups = [common + [f"g{k}x{i}" for i in range(25)] for k in range(6)]
    texts = [t for g in groups for t in near_copies(rng, [g] * 9, 3)] + near_copies(rng, [common + [f"o{k}x{i}" for i in range(20)] for k in range(10)], 1)
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    for hot in (pj.HOT, 3):  # values that more rows have are split
        got = sorted((tuple(r) for r in pj.near_duplicates(docs(rows).repartition(3), hot=hot).collect()), key=str)
        assert got == brute_components(rows)
    assert len({r[2] for r in got}) > 6


def test_hot_values_lie_in_short_rows_of_their_own(docs, monkeypatch):
    monkeypatch.setattr(pj, "HOT_ROW", 16)
    monkeypatch.setattr(pj, "ALL_PAIRS", pj.CENTRAL)  # central classes and hubs for all others
    rng = random.Random(13)
    rows = [*enumerate(near_copies(rng, [[f"w{i}" for i in range(200)]] * 300, 3))]
    frame = docs(rows).repartition(2)
    keyed, _ = pj.with_rows(frame.select("doc_id", "text"), "_key")
    ranks = pj._ranks(pj._sets(keyed, "bigint").where("cells IS NOT NULL").select("cells", "counts"))
    entries = pj._entries(keyed, ranks, 4, hot=50).collect()
    hot = [(r.value, pj.np.frombuffer(r.entries, pj._ENTRY)) for r in entries if r.bucket < 0]
    cold = pj.np.concatenate([pj.np.frombuffer(r.entries, pj._ENTRY) for r in entries if r.bucket >= 0])
    assert hot and all(len(e) <= 16 and len(set(e["key"].tolist())) == 1 for _, e in hot)
    # Cells are shared by values now and then, so that a cell counts at least what a value has.
    assert pj.np.unique(cold["key"], return_counts=True)[1].max() <= 60 and sum(len(e) for _, e in hot) > 300
    pairs, hubs = pj.meet(pj.np.concatenate([e for _, e in hot]))
    met = pj._hot_met(pj._entries(keyed, ranks, 4, hot=50).where("bucket < 0").select("value", "entries")).collect()
    got = [{(r.a, r.b) for r in met if r.kind == k} for k in (pj.PAIR, pj.HUB)]
    assert got[0] == set(map(tuple, pj._signed(pairs).tolist())) and got[1] >= set(map(tuple, pj._signed(hubs).tolist()))


def test_classes_that_the_pigeonhole_could_miss_equal_brute_force(docs, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(pj, "BLOCKS", 0.0)
    monkeypatch.setattr(pj, "LEAST_BLOCKS", 3)  # every block holds much, and so no set has more than D of them
    monkeypatch.setattr(pj, "WEAK_BYTES", 4_000)
    bases = [[f"b{k}x{i}" for i in range(rng.choice([6, 30, 60]))] for k in range(8)]
    rows = [*enumerate(t for b in bases for t in near_copies(rng, [b] * 4, 1))]
    got = sorted((tuple(r) for r in pj.near_duplicates(docs(rows).repartition(2)).collect()), key=str)
    assert got == brute_components(rows) and len({r[2] for r in got}) < len(rows)


def test_identifiers_and_terms():
    labels = lambda t: {a[2] for a in licenses.scan_words(licenses.alnum_words(t))[1]}
    assert labels("# SPDX-License-Identifier: Apache-2.0\n") == {"apache-2.0"} and labels("// SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl"}
    assert labels("SPDX-License-Identifier: MIT") == {"mit"} and labels("SPDX-License-Identifier: CC-BY-NC-4.0") == {"cc-by-nc"} and labels("SPDX-License-Identifier: Own-1.0") == set()
    apache = """TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License."""
    assert labels(apache) == {"apache-2.0"} and labels(apache.replace("Sections 1", "Sections 2")) == set()
    gpl = """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
 Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."""
    assert labels(gpl) == {"gpl"}
    assert labels('Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.') == {"mpl-2.0"}


def test_licenses():
    scan = lambda t: licenses.scan_words(licenses.alnum_words(t))
    base, accepted, share = scan("Licensed under CC BY-NC 4.0. All rights reserved; all RIGHTS reserved")
    assert share == 1
    assert base == [(2, "cc-by"), (7, "reserved"), (10, "reserved")] and {a[2] for a in accepted} == {"cc-by-nc"}
    labels = lambda t: {a[2] for a in scan(t)[1]}
    assert labels("Licensed under the Apache License, Version 2.0 (the License)") == {"apache-2.0"}
    assert labels("Licensed under the Apache Licence, Version 2.0") == set()
    assert labels("released under the terms of the MIT license") == labels("Released under the MIT License.") == {"mit"}
    assert labels("released under terms of the MIT license") == set()
    assert labels("licensed under the three clause BSD license") == labels("licensed under the BSD license") == {"bsd"}
    assert labels("Copyright 2020 Jane Q Public. All rights reserved") == {"reserved"}
    assert labels("copyright all rights reserved") == set()  # a replaceable region of one word at least
    assert scan("") == ([], [], 0.0)


def filled(template, rng):
    """A wording that a template must accept: optional parts and alternatives drawn, replaceable words made up."""
    words, skip = [], []
    tokens = re.findall(r"\{\w+ \d+ \d+\}|[\[\]()|]|[^\s\[\](){}|]+", template)
    at = 0

    def part(closing):
        nonlocal at
        ways = [[]]
        while at < len(tokens) and tokens[at] != closing:
            t = tokens[at]
            at += 1
            if t == "|":
                ways.append([])
            elif t == "[":
                inner = part("]")
                ways[-1] += inner if rng.random() < 0.5 else []
            elif t == "(":
                ways[-1] += part(")")
            elif t[0] == "{":
                low, high = map(int, t[1:-1].split()[1:])
                ways[-1] += [f"name{rng.randrange(9)}" for _ in range(rng.randint(low, high))]
            else:
                ways[-1].append(t)
        at += 1
        return rng.choice(ways)

    return part("")


def test_every_template_accepts_its_wordings_and_no_other():
    rng = random.Random(7)
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            a = licenses.compile_template(label, template)
            for _ in range(6):
                words = filled(template, rng)
                data = [w.encode() for w in words]
                assert a.match([b"so", *data, b"then"], 1, {})[0] >= 1 + a.left()[0]
                base, accepted, share = licenses.scan_words([b"so", *data, b"then"])
                assert label in {x[2] for x in accepted} and share == 1
                if (own := [i for i, w in enumerate(words) if i and not w.startswith("name") and i < a.left()[0] // 2]) and len(words) > 30:
                    broken = list(data)
                    broken[rng.choice(own)] = b"otherwise"
                    end, part = a.match(broken, 0, {})
                    assert end < 0 and part < 1


def test_a_license_that_breaks_off_scores_its_share():
    full = licenses.TEMPLATES["zlib"][0]
    words = [w.encode() for w in full.split() if w not in "[]123"]
    a = licenses.compile_template("zlib", full)
    assert a.left()[0] == len(words)
    for n in (8, 40, len(words) - 1, len(words)):
        assert licenses.scan_words(words[:n])[2] == pytest.approx(n / len(words))


def test_template_markup():
    a = licenses.compile_template("x", "a [ b [ c ] ] ( d | e f ) {v 0 2} g")
    ends = lambda t: a.match(t.encode().split(), 0, {})[0]
    assert [ends(t) for t in ("a d g", "a b e f g", "a b c d q q g", "a c d g", "a d q q q g", "a e g", "a b d")] == [3, 5, 7, -1, -1, -1, -1]


def test_licenses_of_odd_rows(odd):
    got = licenses.scan_licenses(odd)
    rows = got.select("_row.doc_id", "n_words", "n_base", "first_word", "base_labels", got["score"]).collect()
    assert len(rows) == odd.count() and all(r.first_word is None and r.base_labels == "" and r.score == 0 for r in rows)
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_rows_of_a_value_grow_with_its_classes():
    """However many classes share a value, it gives no more than CENTRAL + 1 rows for each of them."""
    for k in (2, 4, 8, 9, 16, 32, 33, 500):
        entries = pj.np.zeros(k, pj._ENTRY)
        entries["f1"] = pj.np.arange(1, k + 1)
        pairs, hubs = pj.meet(entries)
        assert len(pairs) + len(hubs) <= (pj.CENTRAL + 1) * k
        assert len(hubs) == k or len(pairs) == k * (k - 1) // 2


def test_what_many_buckets_give_goes_out_once(monkeypatch):
    """Near copies that share a value in each of 40 buckets are one pair, and one row under their hub; with little room they still all come."""
    def batch(bucket, classes):
        entries = pj.np.zeros(len(classes), pj._ENTRY)
        entries["f1"], entries["key"] = classes, bucket
        return pj.pa.RecordBatch.from_arrays([pj.pa.array([bucket]), pj.pa.array([entries.tobytes()])], names=["bucket", "entries"])

    def met(groups):
        return [(r["a"], r["b"], r["kind"]) for b in pj.meet_each(iter([batch(i, g) for i, g in enumerate(groups)])) for r in b.to_pylist()]

    assert met([[1, 2]] * 40) == [(1, 2, pj.PAIR)]
    large = list(range(1, 21))
    assert sorted(met([large] * 40)) == sorted(met([large])) and len(met([large])) <= (pj.CENTRAL + 1) * 20
    mixed = [[i, i + 1] for i in range(1, 41)] * 2 + [large]
    every = sorted(met(mixed))
    monkeypatch.setattr(pj, "MET", 10)
    assert sorted(set(met(mixed))) == every


def test_a_task_meets_several_buckets(spark):
    """Tasks are twice the cores or more, however many partitions there are; no bucket is lost or split."""
    rows = []
    for bucket in range(37):
        entries = pj.np.zeros(2, pj._ENTRY)
        entries["f1"], entries["key"] = (1, 2) if bucket % 2 else (3, 4 + bucket), bucket
        rows += [(bucket, bytearray(entries[:1].tobytes())), (bucket, bytearray(entries[1:].tobytes()))]
    got = pj._met(spark.createDataFrame(rows, "bucket long, entries binary").repartition(3), 37)
    assert sorted((r.a, r.b, r.kind) for r in got.collect()) == [(1, 2, pj.PAIR), *[(3, 4 + b, pj.PAIR) for b in range(0, 37, 2)]]
