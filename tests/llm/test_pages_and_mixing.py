import hashlib
import io
import random
import time
import zipfile
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import mixing, tag_paths, warc_zip
from folioflow.llm.tag_paths import extract, main_text


def test_main_text():
    page = '<html><body><header><h1>Site</h1><a href=/>Home</a></header><div id="content"><h2>Title &amp; more</h2><p>First para, with some text. And\n more.<p>Second <b>bold</b> text, here.</div><div class="comments"><p>Nice post, really, thanks. I like it.</p></div><div class="sidebar"><a href=1>x</a><a href=2>y</a></div><form><p>Subscribe now</p></form><footer>(c)</footer></body></html>'
    assert main_text(page) == "Title & more First para, with some text. And more. Second bold text, here."
    assert main_text("<article><h1>T</h1><p><b>One, two.<br><p>Three.</p><p>x</p></article><footer>f</footer>") == "T One, two. Three. x"
    assert main_text(None) == main_text("") == main_text("<script>var a='<p>x</p>'</script>") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<!-- <p>no</p> --><p>yes, sir.") == "yes, sir."
    assert main_text("<p>unclosed <b") == "unclosed <b"
    assert "tail" in main_text("<article><p>" + "word, " * 50_000 + "tail.</p></article>")


def test_short_parts_of_an_article_stay():
    long = "<p>" + "word after word goes on, and so, again, on. " * 7 + "</p>"
    table = "<table><tr><th>Day</th><th>No</th></tr><tr><td>12</td><td>Mon</td></tr><tr><td><a href=/t>13</a></td><td>Tue</td></tr></table>"
    for start, end in (("<article>", "</article>"), ("<div id=text>", "</div>"), ("<main><div>", "</div></main>")):
        for part, text in ((table, "Day No 12 Mon 13 Tue"), ("<blockquote>So it is</blockquote>", "So it is"), ("<section>Ends here</section>", "Ends here"), ("<div>Line one</div><div>Line <a href=/2>2</a></div>", "Line one Line 2")):
            got = main_text(f"<html><body><nav>Home</nav>{start}{long}{part}{long}<div><a href=/>Next page</a></div>{end}<section>(c) me</section><footer>f</footer></body></html>")
            assert f"again, on. {text} word after" in got and got.endswith("on."), (start, part, got)


def test_names_of_templates_bar_no_article():
    text = "word after word goes on, and so, again, on. " * 7
    long, want = f"<p>{text}</p>", text.strip()
    for name in ("content no-sidebar", "has-sidebar", "post comments-open", "layout--sidebar", "right-sidebar", "page_with_nav"):
        assert main_text(f"<body><nav>Home</nav><div class='{name}'>{long}</div><div class=sidebar><p>Other.</p></div></body>") == want, name
        assert main_text(f"<body><div class='{name}'><article>{long}</article></div><section><p>Other, than that.</p></section></body>") == want, name
        assert main_text(f"<main><h1>T</h1><div class='{name}'>{long}</div></main>") == "T " + want, name
    for title in ("<header class='entry-header'><h1>T</h1></header>", "<div class=entry-header><h1>T</h1></div>", "<h1 class=page-header>T</h1>"):
        assert main_text(f"<article>{title}{long}</article>") == "T " + want
    for aside in ("sidebar", "sidebar-left", "site-header", "nav main_nav", "ad_300", "Share"):
        assert main_text(f"<body><div id=text>{long}</div><div class='{aside}'><p>Other, than that.</p></div></body>") == want, aside
    assert main_text(f"<body><div id=text>{long}</div><div id=comments>{long * 9}</div></body>") == want


def made_page(rng):
    """A page put together from known parts, and the text of its article."""
    sentence = lambda n: " ".join(rng.choice(("so", "then", "words", "follow", "upon", "others")) for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<li><a href=/{i}>{rng.choice('ABC')}{i}</a></li>" for i in range(n))
    title, paragraphs = sentence(6)[:-1], [" ".join(sentence(rng.randrange(8, 20)) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(3, 7))]
    start, end = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post>", "</div>"), ("<div id=content><section>", "</section></div>"), ("<div class='x9'><div>", "</div></div>")))
    inner = [f"<h1>{title}</h1>", *[f"<p>{p[:20]}<em>{p[20:]}</em>" + rng.choice(("</p>", "")) for p in paragraphs]]
    around = [f"<nav><ul>{links(6)}</ul></nav>", f"<div class=sidebar><ul>{links(4)}</ul><p>{sentence(5)}</p></div>", f"<div class=cookie-notice><p>{sentence(9)}</p></div>", f"<form><label>Mail</label><p>{sentence(4)}</p></form>", f"<aside><p>{sentence(7)}</p></aside>", f"<div class=ad>{sentence(6)}</div>"]
    after = [f"<div id=comments>{''.join(f'<p>{sentence(14)}</p>' for _ in range(8))}</div>", f"<footer>&copy; {sentence(6)}</footer>"]
    rng.shuffle(around)
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><script>var a = '<p>{sentence(9)}</p>'</script>{''.join(around[:4])}{start}{''.join(inner)}{end}{''.join(after)}</body></html>"
    return page, " ".join([title, *paragraphs])


def test_pages_made_of_known_parts():
    rng = random.Random(21)
    for _ in range(150):
        page, want = made_page(rng)
        assert main_text(page) == want


def test_ratios_decide(monkeypatch):
    rng = random.Random(22)
    pages = [made_page(rng) for _ in range(60)]
    with monkeypatch.context() as m:
        m.setattr(tag_paths, "ratio", lambda p: 1.0)
        alike = [main_text(page) for page, _ in pages]
        assert sum(text == want for text, (_, want) in zip(alike, pages)) < 6
    for name in ("FOR", "AGAINST"):
        monkeypatch.setattr(tag_paths, name, 0.0)
    plain = [main_text(page) for page, _ in pages]
    assert all(want in text for text, (_, want) in zip(plain, pages))
    assert sum(map(len, plain)) - sum(len(w) for _, w in pages) < 0.75 * (sum(map(len, alike)) - sum(len(w) for _, w in pages))


@pytest.mark.parametrize("piece", ["<a", '<div a="', "<div>x", "<b>", "<a b='\">", "<script>", "<title>", "<", "<p>", "</p>", "<!--", "<!", "<p><b>", "&amp", "<a =", "</b", "<td>x"])
def test_time_is_linear_in_hostile_pages(piece):
    page = piece * ((1 << 18) // len(piece))
    for text in (page, page + ">", "<p " + page + "'>"):
        began = time.process_time()
        main_text(text)
        assert time.process_time() - began < 3


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pab!-\"'= &;x\n", max_size=60))
def test_any_markup_is_survived(page):
    assert "  " not in main_text(page)


def test_extract_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<p>a, b.</p>", None)], "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars")
    got = extract(pages)
    assert sorted(r.n_chars for r in got.select("n_chars").collect()) == [0, 0, 5]
    assert got.select("_row.*").columns == pages.columns and extract(pages.limit(0)).count() == 0


def brute_records(rows):
    out = []
    for page, url, html in rows:
        body = (html or "").encode()
        twins = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        top = max(twins, default=None)
        revisit = len(body) >= 1000 and top is not None and page != top
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None, url))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rng = random.Random(2)
    big = ["é" * 600, "x" * 999, "y" * 1000, "z\r\n\r\n" * 400]
    rows = [(i, f"http://h/{i}?q=ü%20 x", rng.choice([*big, f"p{i}" * 700])) for i in range(60)] + [(61, None, None), (62, "u", ""), (None, "u", big[2]), (5, "again", big[0]), (70, "http://x/\r\nWARC-Type: evil\t\0", "WARC/1.0\r\n\r\nPK\x05\x06" * 300), (71, "u", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "'x' AS size", "1 AS sha1", "2 AS payload", "3 AS target")
    got = warc_zip.round_trip(pages)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_records(rows)
    archives = warc_zip.write_archives(pages, warc_zip.scratch(spark, "warc"))
    full = warc_zip.read_archives(archives, payload=True).where("page_id = 61 OR page_id = 62").collect()
    assert [r.payload for r in full] == [b"", b""]
    with zipfile.ZipFile(warc_zip.open_for_read(archives.first().uri)) as z:  # any other reader understands it
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_reads_plain_and_zip64_directories():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"one")
        z.writestr("b/c", b"two!")
        z.comment = b"PK\x05\x06 in a comment"
    own = io.BytesIO()
    warc_zip.write_zip(own, [("a", b"one"), ("b/c", b"two!")])
    for f in (plain, own):
        members = warc_zip.central_directory(f, len(f.getvalue()))
        assert {k: v[:3] for k, v in members.items()} == {"a": (0, 3, 3), "b/c": (0, 4, 4)}
        at = warc_zip.member_start(f, members["b/c"][3])
        assert f.getvalue()[at : at + 4] == b"two!"
    with pytest.raises(ValueError, match="no end"):
        warc_zip.central_directory(io.BytesIO(b"x" * 50), 50)


def test_damaged_record_is_noticed():
    data = warc_zip.warc_record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None)
    assert warc_zip.parse_record(data)["page_id"] == 1
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse_record(data.replace(b"payload\r\n", b"pAyload\r\n"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=12))
def test_schedule_deviates_by_less_than_a_block(weights):
    span = 300
    given_ = dict(enumerate(weights))
    share = {k: Fraction(w) / sum(map(Fraction, weights)) for k, w in given_.items()}
    plan = mixing.schedule(given_, {k: int(span * w) + 2 for k, w in share.items()})
    every = sorted(s for *_, slots in plan.values() for s in slots)
    assert len(set(every)) == len(every)
    for k, (*_, slots) in plan.items():
        for t in range(span + 1):
            assert abs(sum(s < t for s in slots) - t * share[k]) < 1


def test_schedule_of_uneven_weights_over_a_million_slots():
    weights = {"a": 0.7, "b": 0.2999, "c": 0.0001}
    total = sum(map(Fraction, weights.values()))
    n = 1_000_000
    plan = mixing.schedule(weights, {k: int(n * Fraction(w) / total) + 2 for k, w in weights.items()})
    for k, w in weights.items():
        share = Fraction(w) / total
        num, den = share.numerator, share.denominator
        assert all(abs(j * den - slot * num) < den and abs((j + 1) * den - (slot + 1) * num) < den for j, slot in enumerate(plan[k][3]) if slot < n)


def test_mix_places_every_document_once(spark, docs, odd):
    rows = [(i, "x" * (50 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(docs(rows), weights={"hot": 1.0, "s0": 2.0, "never": 1.0}, block=500).collect()
    assert sorted(r._row.doc_id for r in got) == list(range(900))
    by_source = {}
    for r in got:
        by_source.setdefault(r._row.source, []).append(r)
    weights = {"hot": 1.0, "s0": 2.0, "never": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0}
    for source, rs in by_source.items():
        rs.sort(key=lambda r: r.place)
        assert [r.place for r in rs] == list(range(len(rs)))
        before = 0
        for r in rs:
            assert r.block == before // 500 and r.release <= r.slot < r.deadline
            before += len(r._row.text) + 1
        slots = sorted({r.slot for r in rs})
        blocks = max(r.block for r in rs) + 1
        assert len(slots) == blocks
        for t in range(slots[-1]):
            assert abs(sum(s < t for s in slots) - t * weights[source] / 8) < 1
    assert len({r.slot: r._row.source for r in got}) == len({(r.slot, r._row.source) for r in got})
    out = mixing.mix(odd)
    assert out.count() == odd.count() and mixing.in_mixed_order(out).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_blocks_and_sources_beyond_the_bounds(docs, monkeypatch):
    rows = [(i, "x" * 99, f"s{i % 40}") for i in range(400)] + [(900, "y", None)]
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 16)
    got = mixing.mix(docs(rows), weights={"s1": 3.0, "s2": 1.0}, block=10, most=5).collect()
    assert sorted(r._row.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    pools = {}
    for r in got:
        pools.setdefault(r.slot, set()).add(r._row.source)
    assert len(pools) <= 16 + 8 and {"s1"} in pools.values() and {None} in pools.values()


def test_very_many_sources_are_scheduled_each_on_its_own(spark):
    """One rule at every number of sources: each document, the first of its source, is at the source's first place."""
    rows = spark.range(100_500).selectExpr("id AS doc_id", "'x' AS text", "concat('s', id) AS source")
    got = mixing.mix(rows).agg(F.count("*").alias("n"), F.max("place").alias("place"), F.max("block").alias("block"), F.countDistinct("slot").alias("slots")).first()
    assert tuple(got) == (100_500, 0, 0, 100_500)


def test_rows_without_ids_spread(docs):
    got = mixing.mix(docs([(None, "same", "hot")] * 300 + [(i, "x", "b") for i in range(9)]))
    assert sorted(r.place for r in got.where("_row.source = 'hot'").select("place").collect()) == list(range(300))


def test_rows_mixed_by_key_are_those_mixed_whole(docs, odd):
    rows = docs([(i % 190, "x" * (i % 50), "abc"[i % 3 % 2]) for i in range(200)] + [(None, None, None)] * 3).coalesce(3)
    options = {"weights": {"a": 2.0, "b": 1.0}, "block": 64}
    slots = {(r._row.doc_id, r._row.text): r.slot for r in mixing.mix(rows, **options).collect()}
    got = [(r.doc_id, r.text) for r in mixing.mixed(rows, **options).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)
    assert [slots[x] for x in got] == sorted(slots[x] for x in got)
    clash = odd.selectExpr("*", "1 AS _key", "2 AS _slot", "3 AS _at")
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and out.count() == clash.count() and mixing.mixed(odd.limit(0)).count() == 0


def test_default_weights_flatten_sizes(docs):
    w = mixing.source_weights(docs([(1, "x" * 99, "a"), (2, "x" * 399, "b"), (3, None, None)]).withColumn("source", F.col("source")))
    assert w["b"] / w["a"] == pytest.approx(2.0)


def test_schedule_keeps_to_the_given_weights_over_many_periods():
    for weights in ({i: 1.0 for i in range(20)}, {"a": 0.7, "b": 0.2, "c": 0.1, "d": 1e-4}, {i: (i + 1) ** 0.5 for i in range(7)}):
        total = sum(map(Fraction, weights.values()))
        share = {k: Fraction(w) / total for k, w in weights.items()}
        span = 40_000
        plan = mixing.schedule(weights, {k: int(span * w) + 2 for k, w in share.items()})
        for k, (_, _, _, slots) in plan.items():
            for j, slot in enumerate(slots):  # the deviation is greatest just before and just after a block
                if slot < span:
                    assert abs(j - slot * share[k]) < 1 and abs(j + 1 - (slot + 1) * share[k]) < 1


def test_a_source_of_weight_0_follows_all_others(docs):
    rows = [(i, "x" * 99, "abc"[i % 3]) for i in range(90)]
    got = mixing.mix(docs(rows), weights={"a": 3.0, "b": 1.0, "c": 0.0}, block=500).collect()
    assert sorted(r._row.doc_id for r in got) == list(range(90))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert min(r.slot for r in got if r._row.source == "c") > max(r.slot for r in got if r._row.source != "c")


def test_weights_that_are_no_shares_are_refused(docs):
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="not negative"):
            mixing.mix(docs([(1, "x", "a")]), weights={"a": bad})
    with pytest.raises(ValueError, match="too small"):
        mixing.schedule({"a": 1.0, "b": 1e-300}, {"a": 1, "b": 2})


def test_mixed_documents_keep_to_the_given_weights_over_many_periods(docs):
    rows = [(i, "x" * 99, "abc"[i % 3]) for i in range(1_200)]
    got = mixing.mix(docs(rows), weights={"a": 1.0, "b": 1.0, "c": 1.0}, block=100).collect()
    for r in got:
        assert abs(r.block - r.slot / 3) < 1 and abs(r.block + 1 - (r.slot + 1) / 3) < 1


def test_what_stands_inside_an_article_stays():
    text = main_text
    assert text("<article><h1>T</h1><p>See the list of sources, which follows here, and more text of the article.</p><ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul><p>Then more prose, with commas, and so on.</p></article>").count("Source") == 2
    assert "The brief was filed" in text("<article><p>Some words here, to begin.</p><section class='social-science'><p>About the science, which is social.</p></section><p class='reply-brief'>The brief was filed, they said.</p></article>")
    page = "<article><p>Some words here, to begin with it all.</p><figure><img src=x><figcaption>What the figure shows.</figcaption></figure><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object data=y>Fallback text</object></article>"
    assert text(page) == "Some words here, to begin with it all. What the figure shows. The formula x=1 holds. Fallback text"
    around = "<article><p>" + "Prose, and more of it, as the article goes on. " * 6 + "</p><ul class='related-links'><li><a href=1>Other</a></li><li><a href=2>Post</a></li></ul><div class=comments><p>First comment, by a reader, long enough.</p></div></article>"
    assert "Other" not in text(around) and "comment" not in text(around)


@pytest.mark.parametrize("index", ["cdxj", "cdx.gz", "none"])
@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others_are_read(spark, tmp_path, index, packed):
    import gzip
    import json

    from folioflow.llm import warc_zip

    def record(kind, url, payload, digest):
        block = f"HTTP/1.1 200 OK\r\nX: {'y' * 5000}\r\n\r\n".encode() + payload if kind == "response" else b"a: b\r\n\r\n"
        lines = ["WARC/1.0", f"warc-type:{kind}", "WARC-Record-ID: <urn:x>", "Content-Type: application/http;", " msgtype=response", f"Content-Length:  {len(block)}"]
        lines += ([f"WARC-Target-URI: <{url}>"] if url else []) + ([f"WARC-Payload-Digest: {digest}"] if digest else [])
        data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        return gzip.compress(data) if packed else data

    import base64

    one, two, three = b"<p>one</p>" * 300, "zwei ü".encode(), b""
    sha = lambda x: hashlib.sha1(x)
    files = {
        "archive/a.warc": [record("warcinfo", None, b"", None), record("response", "http://x/1", one, "sha1:" + base64.b32encode(sha(one).digest()).decode())],
        "archive/b.warc": [record("response", "http://x/2", two, "sha256:abc"), record("request", "http://x/2", b"", None), record("response", "http://x/3", three, "SHA1:" + sha(three).hexdigest()), record("revisit", "http://x/1", b"", "sha1:" + sha(one).hexdigest())],
    }
    lines, members = [], []
    for name, records in files.items():
        name += ".gz" * packed
        at = 0
        for r in records:
            lines.append("com,x)/ 2024 " + json.dumps({"filename": name.rpartition("/")[2], "offset": str(at), "length": len(r)}))
            at += len(r)
        members.append((name, b"".join(records)))
    text = "\n".join(lines).encode()
    members += [] if index == "none" else [(f"indexes/index.{index}", gzip.compress(text) if index.endswith("gz") else text)]
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}" * 500, zipfile.ZIP_DEFLATED)
        for name, data in members:
            z.writestr(name, data)
    frame = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "uri string, size long")
    got = sorted((r.url, r.record_type, r.payload_bytes, r.payload_digest, r.payload) for r in warc_zip.read_archives(frame, payload=True).collect())
    want = [("http://x/1", "response", len(one), sha(one).hexdigest(), one), ("http://x/1", "revisit", None, sha(one).hexdigest(), None), ("http://x/2", "response", len(two), sha(two).hexdigest(), two), ("http://x/3", "response", 0, sha(three).hexdigest(), three)]
    assert [(*g[:4], g[4] and bytes(g[4])) for g in got] == [(*w[:4], w[4] and bytes(w[4])) for w in want]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("archive/a.warc", one, zipfile.ZIP_DEFLATED)
    with open(tmp_path / "bad.zip", "rb") as f, pytest.raises(ValueError, match="not stored"):
        list(warc_zip.record_ranges(f, (tmp_path / "bad.zip").stat().st_size))
