"""Registered queries of the scans and sinks: tables written out as files and read back through the operators."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import corpus, extract, fields, merge, pins, ranks, scoring
from folioflow.plans import lifecycle, report, run_report
from folioflow.queries import _COUNTS, _SCORED, _scored
from folioflow.registry import query, t
from folioflow.schemas import RISK
from folioflow.sources import files, records, sinks
from folioflow.sources.scratch import get, put, scratch
from folioflow.streaming import resume

# ---------------------------------------------------------------- scans


def _text(spark: SparkSession, df: DataFrame, name: str) -> str:
    """A folder of text files with the lines of a one-column table."""
    path = scratch(spark, name)
    df.write.text(path)
    return path


def _files(spark: SparkSession, sf: str, name: str, content) -> str:
    """A folder with one file for each nation; ``content`` gives (file name, bytes) of a row, or nothing."""
    folder = scratch(spark, name)
    for r in t(spark, sf, "nation").collect():
        if found := content(r):
            put(spark, f"{folder}/{found[0]}", found[1])
    return folder


@query("SELECT doc_id, lang, source, md5(text) AS digest FROM documents")
def src01_json_lines(spark, sf):
    """JSON lines with blank ones between them."""
    lines = t(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("value"))
    path = _text(spark, lines.select(F.explode(F.array("value", F.lit(""))).alias("value")), "lines")
    return files.jsonl(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


def _events_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events in files of their number modulo 3, by number in each."""
    path = scratch(spark, "events")
    rows = t(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 3).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").write.partitionBy("part").json(path)
    return files.with_ordinal(files.jsonl(spark, path, "user_id long, event_id long, event_type string, part int")).drop("part")


@query("SELECT user_id, arg_max(event_id, (event_id % 3) * 1000000000000 + event_id) AS event_id FROM events GROUP BY user_id")
def src02_last_in_file_order(spark, sf):
    return files.last_per_key(_events_in_files(spark, sf), "user_id").select("user_id", "event_id")


@query("SELECT user_id, arg_min(event_id, (event_id % 3) * 1000000000000 + event_id) AS event_id FROM events GROUP BY user_id")
def agg02_first_in_file_order(spark, sf):
    return files.first_per_key(_events_in_files(spark, sf), "user_id").select("user_id", "event_id")


@query(
    """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '{"id":"' || o_custkey || '","contract_name":""}' WHEN 1 THEN '{"id":' || o_orderkey || ',"contract_name":"' || o_custkey || '"}' WHEN 2 THEN '{"id":' || o_custkey || '}' ELSE '{"id":null,"contract_name":null}' END AS record FROM orders),
         n AS (SELECT k, record, CASE k % 4 WHEN 3 THEN NULL ELSE o_custkey::VARCHAR END AS name FROM r JOIN orders ON o_orderkey = k)
    SELECT name, arg_max(record, k) AS record FROM n GROUP BY name"""
)
def src03_keyed_or_first(spark, sf):
    line = """CASE o_orderkey % 4 WHEN 0 THEN concat('{"id":"', o_custkey, '","contract_name":""}') WHEN 1 THEN concat('{"id":', o_orderkey, ',"contract_name":"', o_custkey, '"}') WHEN 2 THEN concat('{"id":', o_custkey, '}') ELSE '{"id":null,"contract_name":null}' END"""
    lines = t(spark, sf, "orders").select(F.expr(line).alias("value"), F.col("o_orderkey").alias("ordinal"))
    return files.keyed_or_first(lines).drop("ordinal")


@query("SELECT DISTINCT doc_id::VARCHAR AS contract_name FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def src04_done_keys(spark, sf):
    """Lines of which some are torn and some have an empty key."""
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("doc_id").cast("string")).alias("contract_name")
    line = F.to_json(F.struct(name, "quality"))
    lines = t(spark, sf, "labels").select(F.when(F.col("doc_id") % 5 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value"))
    path = _text(spark, lines.union(lines), "done")
    return files.done_keys(spark, path).union(files.done_keys(spark, path + "-none"))


@query("SELECT n_name AS label, n_nationkey * 0.5 AS duration_s, n_regionkey::BIGINT AS reasoning_tokens, CASE WHEN n_nationkey % 4 = 0 THEN 'busy' END AS error FROM nation")
def src05_run_log(spark, sf):
    """A log that is one JSON array, beside a missing and a corrupt one, which are empty."""
    rows = [{"label": r.n_name, "duration_s": r.n_nationkey * 0.5, "usage": {"output_tokens_details": {"reasoning_tokens": r.n_regionkey}}, "error": None if r.n_nationkey % 4 else "busy"} for r in t(spark, sf, "nation").collect()]
    folder = scratch(spark, "log")
    logs = [files.run_log(spark, put(spark, f"{folder}/good.json", json.dumps(rows, indent=1))), files.run_log(spark, f"{folder}/none.json"), files.run_log(spark, put(spark, f"{folder}/bad.json", "[{"))]
    every = logs[0].union(logs[1]).union(logs[2])
    return every.select("label", "duration_s", F.col("usage.output_tokens_details.reasoning_tokens").alias("reasoning_tokens"), "error")


@query("SELECT n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS region FROM nation")
def src06_json_documents(spark, sf):
    """One JSON document a file; a missing one is null."""
    folder = _files(spark, sf, "documents", lambda r: r.n_nationkey % 5 and (f"{r.n_name}.json", json.dumps({"region": r.n_regionkey}, indent=2)))
    return t(spark, sf, "nation").join(files.json_documents(spark, folder, "region int"), F.col("n_name") == F.col("name"), "left").select("n_name", "region")


@query("SELECT n_name AS name, n_name || chr(10) || 'é' || n_nationkey || chr(10) || chr(10) || 'end' AS text FROM nation")
def src07_texts(spark, sf):
    folder = _files(spark, sf, "texts", lambda r: (f"{r.n_name}.txt", f"{r.n_name}\r\né{r.n_nationkey}\r\r\nend"))
    return files.texts(spark, folder)


@query("SELECT n_name AS name, n_name || 'é' || chr(10) || '日end' AS text FROM nation")
def src08_texts_dropping_bad_bytes(spark, sf):
    folder = _files(spark, sf, "bytes", lambda r: (f"{r.n_name}.txt", r.n_name.encode() + b"\xff" + "é\r\n".encode() + b"\xe6\x97" + "日".encode() + b"\xc0\xafend"))
    return files.texts_dropping_bad_bytes(spark, folder)


@query("SELECT 'contract_' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 = 0")
def src09_listing(spark, sf):
    ending = {0: "contract_{}.json", 1: "contract_{}.pcl.json", 2: "other_{}.json"}
    return files.listing(spark, _files(spark, sf, "listing", lambda r: (ending[r.n_nationkey % 3].format(r.n_nationkey), "{}")))


@query("SELECT row_number() OVER (ORDER BY n) AS place, n AS name FROM (SELECT 'contract_' || n_nationkey AS n FROM nation WHERE n_nationkey % 3 = 0)")
def srt01_names_in_order(spark, sf):
    """Names in code-point order: 10 before 2."""
    return ranks.global_ranks(src09_listing(spark, sf), "name").select((F.col("rank") + 1).alias("place"), "name")


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS name, CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN NULL ELSE p_type END AS type, p_retailprice AS price FROM part")
def src10_csv(spark, sf):
    """Commas and doubled quotes; ``None`` is a string, an empty field is null."""
    kind = F.when(F.col("p_partkey") % 4 == 0, "None").when(F.col("p_partkey") % 4 != 1, F.col("p_type"))
    path = scratch(spark, "csv")
    rows = t(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), kind.alias("type"), F.col("p_retailprice").alias("price"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return files.csv(spark, path, "p_partkey long, name string, type string, price double")


@query("SELECT l.doc_id, l.quality + 1 AS quality FROM labels l")
def src11_last_dimension_row(spark, sf):
    """A keyed dimension with every key twice: the last row counts."""
    rows = t(spark, sf, "labels").select("doc_id", "quality", F.lit(0).alias("ordinal"))
    return files.last_per_key(rows.union(rows.select("doc_id", F.col("quality") + 1, F.lit(1))), "doc_id").drop("ordinal")


SCHEMA = {
    "properties": {
        "contract_name": {"type": "string"},
        "choice": {"type": ["string", "null"], "enum": ["a", 'say "b"', None]},
        "many": {"type": ["array", "null"], "items": {"type": "string", "enum": ["x", "y"]}},
        "loose": {"type": ["array", "null"], "items": {"enum": [1, "z"]}},
        "note": {"type": ["string", "null"]},
    }
}


@query("SELECT * FROM (VALUES (0, 'contract_name', 'meta', false, ''), (1, 'choice', 'single_choice', false, 'a|say \"b\"'), (2, 'many', 'multilabel', true, 'x|y'), (3, 'loose', 'multilabel', false, 'z'), (4, 'note', 'freetext', false, '')) AS v(ordinal, field, kind, is_multilabel, labels)")
def src12_schema_fields(spark, sf):
    """The field dimension of a JSON Schema, with both rules for kinds (CLS03, CLS04)."""
    return fields.load_fields(spark, json.dumps(SCHEMA)).select("ordinal", "field", "kind", "is_multilabel", F.array_join("labels", "|").alias("labels"))


@query("SELECT n_name AS name, strlen('é' || n_name || n_regionkey)::BIGINT AS bytes, sha256('é' || n_name || n_regionkey) AS sha256 FROM nation")
def src13_file_hashes(spark, sf):
    folder = _files(spark, sf, "pins", lambda r: (f"{r.n_name}.bin", f"é{r.n_name}{r.n_regionkey}"))
    return files.file_hashes(spark, folder).select(files.stem(F.element_at(F.split("path", "/"), -1)).alias("name"), "bytes", "sha256")


@query("SELECT n_name AS path, CASE n_nationkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'snapshot_missing' WHEN 3 THEN 'snapshot_drift' ELSE 'match' END AS status FROM nation")
def cls06_pin_statuses(spark, sf):
    """All five statuses, from pins and files as they are now."""
    n = t(spark, sf, "nation").withColumn("k", F.col("n_nationkey") % 5)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    snapshot = F.when(F.col("k").isin(2, 3), F.concat("n_name", F.lit(".old")))
    pinned = n.select(F.col("n_name").alias("path"), digest(F.col("n_name")).alias("sha256"), snapshot.alias("snapshot"))
    now = n.where("k <> 0").select(F.col("n_name").alias("path"), digest(F.when(F.col("k") == 1, F.lit("x")).otherwise(F.col("n_name"))).alias("sha256"))
    return pins.drift(pinned, now.union(n.where("k = 3").select(F.concat("n_name", F.lit(".old")), digest(F.lit("y"))))).select("path", "status")


@query("SELECT 'text' AS source, 'be brief' AS prompt UNION ALL SELECT 'file', 'be exact' UNION ALL SELECT 'none', NULL UNION ALL SELECT 'both', 'refused'")
def src15_prompt_text(spark, sf):
    path = files.local(put(spark, f"{scratch(spark, 'prompt')}/p.txt", "be exact"))
    try:
        both = files.prompt_text("a", path)
    except ValueError:
        both = "refused"
    return spark.createDataFrame([("text", files.prompt_text("be brief")), ("file", files.prompt_text(path=path)), ("none", files.prompt_text()), ("both", both)], "source string, prompt string")


# ---------------------------------------------------------------- sinks


@query("""SELECT '{"c_custkey":' || c_custkey || ',"name":"é ' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS line FROM customer""")
def snk01_json_overwrite(spark, sf):
    """Nulls are written and text beyond ASCII stands as it is; a second write replaces the first (SNK07)."""
    path = scratch(spark, "out")
    rows = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("é "), "c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    sinks.jsonl(rows.limit(3), path)
    sinks.jsonl(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN -1 ELSE quality END AS quality FROM labels")
def snk02_incremental_resume(spark, sf):
    """Two streaming runs over the labels into a table that holds the keys of one class already: those stay as they are, no key comes twice."""
    labels = t(spark, sf, "labels")
    held = labels.where("toxic = 0").withColumn("quality", F.lit(-1).cast(labels.schema["quality"].dataType))
    base = scratch(spark, "stream")
    sinks.append_missing(held, f"{base}/table", ["doc_id"])
    for attempt in ("first", "again"):  # a checkpoint of its own each time: the second run replays all
        resume.process_new_files(spark, sf, labels.schema, f"{base}/table", f"{base}/{attempt}", ["doc_id"], glob="labels.parquet")
    return sinks.appended(spark, f"{base}/table").select("doc_id", "quality")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def snk03_stats_document(spark, sf):
    """A small result as one JSON file, read back."""
    path = f"{scratch(spark, 'stats')}/stats.json"
    sinks.stats_document(t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")), path)
    return spark.read.schema("lang string, n long, sources long").option("multiLine", True).json(path)


@query(
    _SCORED
    + f""", s AS (SELECT 'overall' AS name, {_COUNTS} FROM c UNION ALL SELECT 'kind: ' || kind, {_COUNTS} FROM c GROUP BY kind),
      w AS (SELECT *, row_number() OVER (ORDER BY doc_id, CASE field WHEN 'quality' THEN 0 ELSE 1 END) AS r, count(*) OVER () AS total FROM c WHERE outcome NOT LIKE 'correct%')
    SELECT '| ' || name || ' | ' || n || ' | ' || correct_value || ' | ' || wrong_value || ' | ' || hallucination || ' | ' || over_abstain || ' | ' || correct_abstain || ' | ' || printf('%.1f%%', 100.0::DOUBLE * correct / n) || ' |' AS line FROM s
    UNION ALL SELECT '| ' || doc_id || ' | ' || field || ' | ' || outcome || ' | ' || coalesce(p, 'null') || ' | ' || coalesce(g, 'null') || ' |' FROM w WHERE r <= 50
    UNION ALL SELECT DISTINCT '| … ' || (total - 50) || ' more | | | | |' FROM w WHERE total > 50"""
)
def snk04_report(spark, sf):
    """The table lines of the Markdown report: overall, by kind, the first 50 mismatches and how many more there are."""
    cells = _scored(spark, sf)
    none = cells.withColumns({"is_top": F.lit(None).cast("boolean"), "is_substituted": F.lit(None).cast("boolean")})
    stats = scoring.overlay_stats(none).where("overlay IN ('overall', 'kind')")
    wrong = cells.where("outcome NOT LIKE 'correct%'")
    text = report.markdown(stats, scoring.mismatches(cells, 50, ("doc_id", "ordinal")).select("doc_id", "field", "outcome", "pred_json", "gold_json"), wrong.count(), "report")
    lines = [x for x in text.split("\n") if x.startswith("| ") and not x.startswith(("| group", "| document"))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


_RUN = """WITH e AS (SELECT user_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_type = 'signup' THEN 'say "up"' ELSE event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN CASE event_type WHEN 'signup' THEN 'say "up"' ELSE event_type END END AS tag FROM events),
      n AS (SELECT user_id, kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM n),
      k AS (SELECT user_id, CASE WHEN count(*) = 1 THEN max(kind) END AS p FROM m WHERE n = m GROUP BY user_id), tg AS (SELECT user_id, list_sort(list(DISTINCT tag)) AS p FROM e WHERE tag IS NOT NULL GROUP BY user_id),
      u AS (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'say "up"' ELSE 'click' END AS gk, CASE WHEN user_id % 3 <> 0 THEN ['click', 'error', 'purchase', 'say "up"', 'view'] END AS gt FROM events),
      v AS (SELECT user_id, 'kind' AS field, 'single_choice' AS kind, p, gk AS g, coalesce(gk = 'say "up"', false) AS sub, p = gk AS same FROM u LEFT JOIN k USING (user_id) UNION ALL SELECT user_id, 'tags', 'multilabel', p::VARCHAR, gt::VARCHAR, gt IS NOT NULL, p = gt FROM u LEFT JOIN tg USING (user_id)),
      c AS (SELECT *, field = 'tags' AS is_top, CASE WHEN p IS NULL AND g IS NULL THEN 'correct_abstain' WHEN g IS NULL THEN 'hallucination' WHEN p IS NULL THEN 'over_abstain' WHEN same THEN 'correct_value' ELSE 'wrong_value' END AS outcome FROM v)"""


@query(
    f"""{_RUN}, s AS (SELECT 'overall' AS name, {_COUNTS} FROM c UNION ALL SELECT 'kind: ' || kind, {_COUNTS} FROM c GROUP BY kind UNION ALL SELECT 'top_risk: ' || is_top, {_COUNTS} FROM c GROUP BY is_top UNION ALL SELECT 'substituted: ' || sub, {_COUNTS} FROM c WHERE sub IS NOT NULL GROUP BY sub)
    SELECT '| ' || name || ' | ' || n || ' | ' || correct_value || ' | ' || wrong_value || ' | ' || hallucination || ' | ' || over_abstain || ' | ' || correct_abstain || ' | ' || printf('%.1f%%', 100.0::DOUBLE * correct / n) || ' |' AS line FROM s"""
)
def snk04_run_report(spark, sf):
    """A run's files written from the events (a document for each user, a chunk for each event, values rewritten for the model), then from those files to the report; its figures with all four overlays."""
    folder = scratch(spark, "run")
    events = t(spark, sf, "events")
    spoken = F.when(F.col("event_type") == "signup", "say 'up'").otherwise(F.col("event_type"))
    record = F.struct(F.when(F.col("event_id") % 6 != 0, spoken).alias("kind"), F.when(F.col("event_id") % 5 == 0, F.array(spoken)).alias("tags"), F.lit("quoted").alias("kind_evidence_spans"))
    who = F.col("user_id").cast("string").alias("contract_name")
    sinks.jsonl(events.select(who, F.col("event_id").alias("chunk_id"), record.alias("prediction")), f"{folder}/predictions.jsonl")
    kinds = ["click", "error", "purchase", 'say "up"', "view"]
    gold = F.struct(F.when(F.col("user_id") % 4 == 1, 'say "up"').when(F.col("user_id") % 4 != 0, "click").alias("kind"), F.when(F.col("user_id") % 3 != 0, F.array(*map(F.lit, kinds))).alias("tags"))
    sinks.jsonl(events.select(who, F.col("event_id").alias("chunk_id"), gold.alias("gold")), f"{folder}/gold.jsonl")
    put(spark, f"{folder}/values.json", json.dumps({k: {'say "up"': "say 'up'"} for k in ("kind", "tags")} | {"unused": {}}))
    heads = [c.split()[0] for c in RISK.split(", ")]
    rows = [{"field": "kind", "cardinality": "6", "pcl_risk": "0.9"}, {"field": "tags", "cardinality": "5", "pcl_risk": "0.5"}]
    put(spark, f"{folder}/risk.csv", "\n".join(",".join(r.get(h, "") for h in heads) for r in [dict(zip(heads, heads)), *rows]))
    schema = run_report.schema_text({"contract_name": {"type": "string"}, "kind": {"type": ["string", "null"], "enum": [*kinds, None]}, "tags": {"type": ["array", "null"], "items": {"type": "string", "enum": kinds}}})
    run_report.report_run(spark, folder, schema, f"{folder}/risk.csv", f"{folder}/values.json", "events")
    lines = [x for x in get(spark, f"{folder}/analysis.md").split("\n") if x.startswith("| ") and x.split()[1].rstrip(":") in ("overall", "kind", "top_risk", "substituted")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


_OUT = "CASE WHEN {p} IS NULL AND gk IS NULL THEN 'correct_abstain' WHEN gk IS NULL THEN 'hallucination' WHEN {p} IS NULL THEN 'over_abstain' WHEN {p} = gk THEN 'correct_value' ELSE 'wrong_value' END"


@query(f"""{_RUN} SELECT mapped, outcome, count(*) AS n FROM (SELECT true AS mapped, {_OUT.format(p='p')} AS outcome FROM u LEFT JOIN k USING (user_id) UNION ALL SELECT false, {_OUT.format(p="replace(p, chr(34), chr(39))")} FROM u LEFT JOIN k USING (user_id)) GROUP BY ALL""")
def dic05_with_and_without_a_dictionary(spark, sf):
    """Outcomes of a run whose values were rewritten for the model: with the dictionary given, and without it."""
    events = t(spark, sf, "events")
    who = F.col("user_id").cast("string").alias("contract_name")
    spoken = F.when(F.col("event_type") == "signup", "say 'up'").otherwise(F.col("event_type"))
    preds = events.select(who, F.col("event_id").alias("chunk_id"), F.to_json(F.struct(F.when(F.col("event_id") % 6 != 0, spoken).alias("kind"))).alias("prediction"))
    golds = events.select(who, F.col("event_id").alias("chunk_id"), F.to_json(F.struct(F.when(F.col("user_id") % 4 == 1, 'say "up"').when(F.col("user_id") % 4 != 0, "click").alias("kind"))).alias("gold"))
    dimension = spark.createDataFrame([(0, "kind", "single_choice", False, [])], fields.FIELDS)
    words = spark.createDataFrame([("kind", 'say "up"', "say 'up'")], "field string, canonical string, modified string")
    counts = lambda given: lifecycle.merge_and_score(preds, golds, dimension, words if given else None)["scored"].groupBy(F.lit(given).alias("mapped"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts(True).union(counts(False))


@query("SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'unchanged' ELSE 'not_checked' END AS status FROM nation")
def src14_heads(spark, sf):
    """Recorded heads of repositories beside those of now: a warning, not an error."""
    n = t(spark, sf, "nation")
    recorded = n.select(F.col("n_name").alias("name"), F.sha1("n_name").alias("sha"))
    now = n.where("n_nationkey % 3 <> 2").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 1, F.sha1("n_name")).otherwise(F.lit("other")).alias("sha"))
    return pins.heads(recorded, now).select("name", "status")


@query("SELECT s_suppkey AS doc_id, k::INTEGER AS chunk_id, s_name || ' ' || k AS text FROM supplier, range(2) AS r(k)")
def snk05_chunk_texts(spark, sf):
    path = scratch(spark, "dump")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_id"))
    sinks.chunk_texts(rows.select("doc_id", "chunk_id", F.concat("s_name", F.lit(" "), F.col("chunk_id").cast("string")).alias("text")), path)
    return files.jsonl(spark, path, "doc_id long, chunk_id int, text string").select("doc_id", "chunk_id", "text")


@query("SELECT 'predictions' AS file, c_custkey AS contract_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'gold', c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey < 12 UNION ALL SELECT 'conflicts', c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def snk06_merge_outputs(spark, sf):
    """Predictions, the gold lines of merged documents only (JN04), conflicts."""
    path = scratch(spark, "merge")
    c = t(spark, sf, "customer").withColumnRenamed("c_custkey", "contract_name")
    sinks.merge_outputs(c.where("c_acctbal >= 0"), c.where("c_nationkey < 12"), c.where("c_mktsegment = 'HOUSEHOLD'"), path)
    read = lambda x: files.jsonl(spark, f"{path}/{x}", "contract_name long").select(F.lit(x).alias("file"), "contract_name")
    return read("predictions").union(read("gold")).union(read("conflicts"))


@query("SELECT c_custkey AS contract_name, c_name AS gold FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jn04_gold_of_merged(spark, sf):
    path = scratch(spark, "merge")
    golds = t(spark, sf, "customer").select(F.col("c_custkey").alias("contract_name"), F.col("c_name").alias("gold"))
    merged = t(spark, sf, "orders").select(F.col("o_custkey").alias("contract_name")).distinct()
    sinks.merge_outputs(merged, golds, merged.limit(0), path)
    return files.jsonl(spark, f"{path}/gold", "contract_name long, gold string")


@query("SELECT row_number() OVER (ORDER BY c_name) AS line, c_name FROM customer")
def snk08_sample_manifest(spark, sf):
    """Every customer's name as a line; lines are numbered as they stand in the files."""
    path = scratch(spark, "names")
    sinks.sample_manifest(t(spark, sf, "customer").select("c_name"), path)
    lines = files.with_ordinal(spark.read.text(path))
    return ranks.global_ranks(lines, "ordinal").select((F.col("rank") + 1).alias("line"), F.col("value").alias("c_name"))


@query("SELECT * FROM (VALUES ('CONFIG.md', 'e1_a: python run.py {{other}}'), ('run.sh', '#!/bin/sh|set -eu|python run.py'), ('manifest.json', '{|  \"name\": \"e1_a\"|}')) AS v(file, text)")
def snk09_run_folder(spark, sf):
    folder = scratch(spark, "run")
    sinks.run_folder(files.local(folder), {"name": "e1_a"}, "python run.py", "{{name}}: {{command}} {{other}}")
    return spark.createDataFrame([(x, get(spark, f"{folder}/{x}").strip().replace("\n", "|")) for x in ("CONFIG.md", "run.sh", "manifest.json")], "file string, text string")


@query("SELECT rpad(r_name, 12, ' ') || ' ' || lpad(format('{:,}', 1234 * (r_regionkey + 1)), 12, ' ') || ' ' || lpad(format('{:,.2f}', r_regionkey * 1000.5), 12, ' ') AS line FROM region")
def snk10_console_table(spark, sf):
    rows = t(spark, sf, "region").select("r_name", (1234 * (F.col("r_regionkey") + 1)).cast("long").alias("n"), (F.col("r_regionkey") * 1000.5).cast("double").alias("x"))
    return spark.createDataFrame([(x,) for x in sinks.console_table(rows).split("\n")[1:]], "line string")


# ---------------------------------------------------------------- run logs, resume


@query("SELECT count(*) AS calls, count(*) FILTER (n_nationkey % 4 <> 0) AS succeeded, sum(n_nationkey)::BIGINT AS input_tokens, 0::BIGINT AS cached_tokens, 0::BIGINT AS output_tokens, sum(n_regionkey)::BIGINT AS reasoning_tokens, sum(n_nationkey * 0.5) AS wall_s FROM nation")
def agg17_usage_of_a_log(spark, sf):
    rows = [{"duration_s": r.n_nationkey * 0.5, "usage": {"input_tokens": r.n_nationkey, "output_tokens_details": {"reasoning_tokens": r.n_regionkey}}, "error": None if r.n_nationkey % 4 else "busy"} for r in t(spark, sf, "nation").collect()]
    return extract.usage_summary(files.run_log(spark, put(spark, f"{scratch(spark, 'log')}/log.json", json.dumps(rows))))


def _digest_client():
    def client(system: str, user: str) -> tuple[str, dict]:
        return json.dumps({"digest": hashlib.md5(user.encode()).hexdigest()}), {"input_tokens": len(user)}

    return client


@query("SELECT conv_id, turn, '{\"digest\": \"' || md5(coalesce(text, '')) || '\"}' AS prediction, length(coalesce(text, '')) AS input_tokens FROM conversations")
def ext01_resumed_extraction(spark, sf):
    """A run over some turns, then one over all, which asks for the rest only: every answer is a durable record of its own."""
    turns = t(spark, sf, "conversations").select(F.col("conv_id").alias("contract_name"), F.col("turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("input"))
    path = scratch(spark, "answers")
    lifecycle.resumed_extraction(turns.where("chunk_id % 2 = 0"), path, _digest_client, "system")
    answers = lifecycle.resumed_extraction(turns, path, _digest_client, "system")
    return answers.select(F.col("contract_name").cast("long").alias("conv_id"), F.col("chunk_id").alias("turn"), "prediction", "input_tokens")


@query("SELECT event_id, user_id, event_type FROM events")
def snk02_record_log(spark, sf):
    """Events through a stream into a record log, and the whole stream once more from its start: batches that come again replace themselves."""
    path, source = scratch(spark, "log"), f"{sf}/events.parquet"
    folder, _, name = source.rpartition("/")
    schema = spark.read.parquet(source).schema
    for attempt in ("first", "again"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).select("event_id", "user_id", "event_type")
        query_ = stream.writeStream.format(records.format_for(spark)).options(path=path, keys="event_id", stream="events", checkpointLocation=f"{path}-{attempt}").outputMode("append").trigger(availableNow=True).start()
        query_.awaitTermination()
    return records.read_records(spark, path, "event_id long, user_id long, event_type string")


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus <> 'F'")
def set02_difference_after_limit(spark, sf):
    """The set of keys to do without those done, the limit before it."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return corpus.todo(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), ["o_orderkey"], limit=500, order="o_orderkey")


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS v FROM events),
         n AS (SELECT user_id, v, count(*) AS n, min(event_id) AS f FROM e WHERE v IS NOT NULL GROUP BY ALL),
         r AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS k FROM n),
         s AS (SELECT user_id, count(*) FILTER (n = m) AS tops, any_value(v) FILTER (n = m) AS top, max(k) AS k, string_agg(v, '|' ORDER BY f) AS every, string_agg(v, '|' ORDER BY f) FILTER (n = m) AS tied FROM r GROUP BY user_id)
    SELECT 'f' AS field, CASE WHEN tops = 1 THEN 'majority_vote' ELSE 'tie_to_null' END AS mode, CASE WHEN tops = 1 THEN top END AS picked, CASE WHEN tops = 1 THEN every ELSE tied END AS values, user_id::VARCHAR AS contract_name FROM s WHERE k > 1"""
)
def snk06_conflict_log(spark, sf):
    """The conflict log of a merge, written as JSON lines and read back with its schema."""
    cells = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("contract_name"), F.col("event_id").alias("chunk_id"), F.lit("f").alias("field"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("value_json"))
    merged, conflicts = merge.merge_documents(cells, spark.createDataFrame([(0, "f", "freetext", False, [])], fields.FIELDS))
    path = scratch(spark, "merge")
    sinks.merge_outputs(merged, merged, conflicts, path)
    log = files.jsonl(spark, f"{path}/conflicts", "contract_name string, field string, mode string, values array<string>, picked string")
    return log.select("field", "mode", "picked", F.array_join("values", "|").alias("values"), "contract_name")
