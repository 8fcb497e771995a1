import json
import random

import pytest

from folioflow import schemas
from folioflow.sources import files, sinks
from folioflow.streaming import resume


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_json_lines(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"contract_name":"a","chunk_id":1}\n\n{"contract_name":"ü","chunk_id":2}\n')
    rows = files.jsonl(spark, good, "contract_name string, chunk_id int")
    assert {r.contract_name for r in rows.collect()} == {"a", "ü"}
    torn = write(tmp_path / "b.jsonl", '{"contract_name":"a"}\n{"contract_name":""}\n{"contract_name":"b"}\n{"contract_na')
    assert {r[0] for r in files.done_keys(spark, torn).collect()} == {"a", "b"}
    assert files.done_keys(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.jsonl(spark, torn, "contract_name string").collect()


def test_run_log(spark, tmp_path):
    path = write(tmp_path / "log.json", json.dumps([{"label": "x", "attempts": 1, "duration_s": 1.5, "usage": {"input_tokens": 3, "output_tokens_details": {"reasoning_tokens": 2}}, "error": None}]))
    from folioflow.operators.extract import usage_summary

    r = usage_summary(files.run_log(spark, path)).first()
    assert (r.calls, r.succeeded, r.input_tokens, r.reasoning_tokens, r.wall_s) == (1, 1, 3, 2, 1.5)
    assert files.run_log(spark, str(tmp_path / "none.json")).count() == 0
    assert files.run_log(spark, write(tmp_path / "bad.json", "[{")).count() == 0


def test_csv_keeps_none_and_doubled_quotes(spark, tmp_path):
    path = write(tmp_path / "r.csv", ",".join(c.split()[0] for c in schemas.RISK.split(", ")) + '\n' + 'f,c,2,2,3,4,0.5,"say ""x""",2,0.5,0.25\n' + "g,c,,2,3,4,0.5,None,2,0.5,0.25\n")
    rows = files.csv(spark, path).orderBy("field").collect()
    assert rows[0].majority_answer == 'say "x"' and rows[1].majority_answer == "None" and rows[1].cardinality is None


def test_texts(spark, tmp_path):
    (tmp_path / "contract_1.txt").write_bytes("a\r\nb\rcé".encode())
    assert tuple(files.texts(spark, str(tmp_path / "contract_1.txt")).first()) == ("contract_1", "a\nb\ncé")
    rng = random.Random(4)
    good = ["a", "é", "日", "😀", "\ufffd", "\r\n", "\r", "\n", "x y"]
    bad = [b"\xff", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\x80", b"\xf0\x9f\x98"]
    for i in range(6):
        data = b"".join(rng.choice([*(g.encode() for g in good), *bad]) for _ in range(400))
        (tmp_path / f"bad{i}.txt").write_bytes(data)
        want = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert files.texts_dropping_bad_bytes(spark, str(tmp_path / f"bad{i}.txt")).first().text == want


def test_file_order_over_several_files(spark, tmp_path):
    for name, n in (("a", 1), ("b", 4_000), ("c", 400)):
        write(tmp_path / f"{name}.jsonl", "".join(json.dumps({"k": "x", "file": name, "i": i}) + "\n" for i in range(n)))
    rows = files.with_ordinal(files.jsonl(spark, str(tmp_path), "k string, file string, i int"))
    assert files.last_per_key(rows, "k").select("file", "i").first() == ("c", 399)
    assert files.first_per_key(rows, "k").select("file", "i").first() == ("a", 0)


def test_lines_by_name_or_first_value(spark, tmp_path):
    lines = ['{"contract_name": "a", "v": 1}', '{"v": "b", "contract_name": ""}', "", '{"id": null, "v": 2}', '{"contract_name": "a", "v": 3}', '{"contract_name": 0, "v": 4}', '{"x": "a"}']
    path = write(tmp_path / "l.jsonl", "\n".join(lines) + "\n")
    rows = files.with_ordinal(spark.read.text(path))
    want = {}
    for line in lines:
        if line:
            r = json.loads(line)
            key = r.get("contract_name") or list(r.values())[0]
            want[key if key is None else str(key)] = line
    assert {r.name: r.record for r in files.keyed_or_first(rows).collect()} == want


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "WHOLE", 100)
    for name, n in (("s", 50), ("l", 3_000_000)):
        (tmp_path / name).write_bytes(b"xyz" * n)
    got = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {name: (3 * n, hashlib.sha256(b"xyz" * n).hexdigest()) for name, n in (("s", 50), ("l", 3_000_000))}


def test_listing_hashes_and_documents(spark, tmp_path):
    for name in ("contract_2.json", "contract_10.json", "contract_2.pcl.json", "other.json"):
        write(tmp_path / name, '{"x": 1}')
    assert [r.name for r in files.listing(spark, str(tmp_path)).collect()] == ["contract_10", "contract_2"]
    assert {r.name for r in files.json_documents(spark, str(tmp_path / "contract_2.json"), "x int").collect()} == {"contract_2"}
    import hashlib

    assert files.file_hashes(spark, str(tmp_path / "other.json")).first().sha256 == hashlib.sha256(b'{"x": 1}').hexdigest()
    assert files.git_state(str(tmp_path))["sha"] is None
    assert files.prompt_text("a") == "a" and files.prompt_text(path=str(tmp_path / "other.json")) == '{"x": 1}'
    with pytest.raises(ValueError, match="not both"):
        files.prompt_text("a", "b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ü", None)], "contract_name string, v string")
    sinks.jsonl(df, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json")) == '{"contract_name":"ü","v":null}\n'
    merged = spark.createDataFrame([("a", "1")], "contract_name string, v string")
    golds = spark.createDataFrame([("a", "1"), ("b", "2")], "contract_name string, gold string")
    sinks.merge_outputs(merged, golds, df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "gold")).count() == 1
    assert sinks.stats_document(merged, str(tmp_path / "s.json")) == {"contract_name": "a", "v": "1"}
    sinks.sample_manifest(golds.select("contract_name"), str(tmp_path / "n.txt"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "n.txt").glob("part-*.txt"))) == "a\nb\n"
    sinks.run_folder(str(tmp_path / "run"), {"name": "n"}, "echo", "{{name}} {{command}} {{other}}")
    assert (tmp_path / "run" / "CONFIG.md").read_text() == "n echo {{other}}"
    sinks.chunk_texts(spark.createDataFrame([("d", 0, "hello")], "doc_id string, chunk_id int, text string"), str(tmp_path / "c"))
    assert next((tmp_path / "c").rglob("bucket=*/part-*.json")).read_text() == '{"doc_id":"d","chunk_id":0,"text":"hello"}\n'
    many = spark.range(300).selectExpr("id AS doc_id", "0 AS chunk_id", "'t' AS text")
    sinks.chunk_texts(many, str(tmp_path / "d"), buckets=4)
    assert len([*(tmp_path / "d").glob("bucket=*")]) == 4
    assert "1,234" in sinks.console_table(spark.createDataFrame([("x", 1234, 0.5)], "a string, n long, r double"))


def test_append_missing_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        sinks.append_missing(rows, str(tmp_path / "t"), ["k"])
    assert sinks.appended(spark, str(tmp_path / "t")).count() == 2
    odd = spark.createDataFrame([(None, "n"), (None, "n"), (3, "c"), (3, "d")], rows.schema)
    for _ in range(2):
        sinks.append_missing(odd, str(tmp_path / "t"), ["k"])
    assert sorted((r.k for r in sinks.appended(spark, str(tmp_path / "t")).collect()), key=str) == [1, 2, 3, None]
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    args = (spark, source, rows.schema, str(tmp_path / "s"), str(tmp_path / "cp"), ["k"])
    resume.process_new_files(*args)
    spark.createDataFrame([(2, "b"), (3, "c")], rows.schema).write.mode("append").parquet(source)
    resume.process_new_files(*args)
    assert sorted(r.k for r in sinks.appended(spark, str(tmp_path / "s")).collect()) == [1, 2, 3]


def test_stream_over_a_table_in_one_file_or_in_many(spark, tmp_path):
    """The name of a table picks its file, or all files of its folder, and nothing beside it."""
    rows = spark.range(10).withColumnRenamed("id", "k")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "in" / "one.parquet")
    spark.range(90, 99).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "in" / "other.parquet"))
    for name, n in (("many.parquet", 10), ("one.parquet", 10), ("*.parquet", 19)):
        for attempt in range(2):
            resume.process_new_files(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / f"to-{n}-{name[0]}" / "t"), str(tmp_path / f"to-{n}-{name[0]}" / f"c{attempt}"), ["k"], glob=name)
        assert sinks.appended(spark, str(tmp_path / f"to-{n}-{name[0]}" / "t")).count() == n
