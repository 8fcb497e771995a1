import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import common, token_counts, token_store
from folioflow.llm.common import scratch, tokenizer_path
from folioflow.llm.tokens import WordTokenizer

PATH = tokenizer_path("word_bpe_49k.json")
library = Tokenizer.from_file(PATH)


def expected(text):
    return library.encode(text or "", add_special_tokens=False).ids


def mine(tok, *texts):
    parts = [(ids, first) for ids, first in tok.ids(pa.array(texts, pa.string()))]
    out = [ids[a:b].tolist() for ids, first in parts for a, b in zip(first[:-1], first[1:])]
    return out[0] if len(texts) == 1 else out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aZé'sß ²½\x1c\x85\xa0\n\t.!-_É̈̈İΣς<|endoftext|>", max_size=40)))
def test_ids_equal_the_library(text):
    assert mine(WordTokenizer_cached(), text) == expected(text)
    assert mine(WordTokenizer_cached(), text, None, "", text[::-1], text) == [expected(x) for x in (text, "", "", text[::-1], text)]


def WordTokenizer_cached(_held=[]):  # noqa: B006, N802
    if not _held:
        _held.append(WordTokenizer(PATH, limit=50))
    return _held[0]


@pytest.mark.parametrize("text", ["it's WE'VE don't", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ İstanbul", "é ́x", "１２３ Ⅷ ²³ ½", "x y　z​q"])
def test_ids_of_awkward_texts(text):
    assert mine(WordTokenizer(PATH), text) == expected(text)


def test_counts(spark, odd):
    got = sorted(((r[0].doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(expected(r.text)), len(expected(r.text)) > 2048) for r in odd.collect()), key=str)
    assert got == want
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_whole_words_and_their_lengths():
    tok = WordTokenizer(PATH)
    words = token_counts.whole_words(tok)
    assert len(words) > 20_000 and b"the" in words and token_counts.whole_words(tok, 4) == words[:4]
    keys, lengths = token_counts.hash_table(PATH, 500)
    found = dict(zip(keys.tolist(), lengths.tolist()))
    assert len(found) == 500 and found == {int(h): len(expected(w.decode())) for w in words[:500] for h in token_counts.units(token_counts.pa.array([w])).hashes()}


def test_counts_read_the_texts_once(docs):
    plan = token_counts.count_tokens(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_vocabularies_of_another_rule_are_refused():
    with pytest.raises(ValueError, match="rule"):
        WordTokenizer(token_counts.tokenizer_path("byte_bpe_50k.json"))


def test_cache_stays_bounded():
    tok = WordTokenizer(PATH, limit=20)
    for k in range(30):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}" for i in range(15)) + " " + "long" * 40
        assert mine(tok, text, "again " + text) == [expected(text), expected("again " + text)]
        assert len(tok.cache.keys) <= 20 and len(tok.cache.pool) < 200


def store_of(spark, df, **kw):
    folder = scratch(spark, "store")
    token_store.write_store(df, folder, **kw)
    return folder


def reference(rows):
    out, start = [], 0
    for i, text in rows:
        ids = expected(text) + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark, docs):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(4000)]
    base = " ".join(words)
    rows = [(i, " ".join(words[: rng.randrange(len(words))])) for i in range(30)] + [(100 + i, base) for i in range(5)] + [(200, base[: len(base) // 2] + " other " + base[len(base) // 2 :]), (201, None), (202, "")]
    rng.shuffle(rows)
    folder = store_of(spark, docs(rows).repartition(5))
    got = [tuple(r) for r in token_store.read_store(spark, folder).orderBy("start").collect()]
    assert got == reference(sorted(rows))
    records = spark.read.parquet(f"{folder}/records")
    stored = sum(len(r.body) for r in records.collect())
    alone = sum(len(r.body) for r in spark.read.parquet(store_of(spark, docs([(1, base)])) + "/records").collect())
    assert stored < 4 * alone  # dozens of documents share the chunks of one
    ids = token_store.read_store(spark, folder, with_ids=True).where("doc_id = 100").first().ids
    assert np.frombuffer(ids, "<u4").tolist() == expected(base) + [2]


def test_store_of_odd_rows(spark, odd):
    got = sorted(tuple(r)[2:] for r in token_store.read_store(spark, store_of(spark, odd)).collect())
    want = sorted(x[2:] for x in reference([(r.doc_id, r.text) for r in odd.collect()]))
    assert got == want
    assert token_store.read_store(spark, store_of(spark, odd.limit(0))).count() == 0


def test_store_notices_damage(spark, docs):
    folder = store_of(spark, docs([(i, f"some text number {i} " * 40) for i in range(8)]))
    records = spark.read.parquet(f"{folder}/records")
    other = scratch(spark, "store")
    records.withColumn("doc_id", F.col("doc_id")).where("doc_id <> 3").write.parquet(f"{other}/records")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, other)
    bad = scratch(spark, "store")
    records.withColumn("digests", F.expr("concat(X'00', substring(digests, 2))")).write.parquet(f"{bad}/records")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="digest"):
        token_store.read_store(spark, bad)


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 20_000).astype("<u2")
    cut = token_store.cuts(ids)
    sizes = np.diff([0, *cut])
    assert cut[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    moved = token_store.cuts(np.concatenate([ids[:5], ids]))
    assert len({c - 5 for c in moved} & set(cut)) > 0.9 * len(cut)


def test_caches_go_when_another_operator_begins():
    made = []

    def run(batches):
        made.append(common.worker_cache("k", object))
        yield from batches

    for kind in ("a", "a", "b", "a"):
        assert [*common.in_worker(kind, run)([1, 2])] == [1, 2]
    assert made[0] is made[1] and len(set(map(id, made))) == 3


def test_slices_bound_what_is_held():
    texts = ["x" * n for n in (10, 30, 200, 5, 5, 5, 90)]
    column = pa.array([None, *texts, ""], pa.string())
    parts = [p.to_pylist() for p in common.text_slices(column, 100)]
    assert [x for p in parts for x in p] == column.to_pylist()
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 100 for p in parts)
