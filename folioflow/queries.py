"""Registered queries of the engine over the driver's tables, and the same in SQL.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import scalars
from folioflow.operators import cells as cells_
from folioflow.operators import chunking, compare, corpus, extract, fields, grounding, merge, patterns, pins, ranks, risk, scoring
from folioflow.registry import QUERIES, SQL, query, t  # noqa: F401  the entry module reads the first two here
from folioflow.sources import files

# ---------------------------------------------------------------- shared inputs: two rules as runs, labels as gold

FIELDS = [(0, "quality", "single_choice", False, ["0", "1"]), (1, "toxic", "single_choice", False, ["0", "1"])]

RUN1 = {"quality": "CASE WHEN n_chars < 200 THEN NULL WHEN n_chars % 5 = 0 THEN '0' ELSE '1' END", "toxic": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '1' ELSE '0' END"}
RUN2 = {"quality": "CASE WHEN n_chars < 300 THEN NULL WHEN n_chars % 7 = 0 THEN '0' ELSE '1' END", "toxic": "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '1' ELSE '0' END"}
GOLD = {"quality": "CAST(quality AS STRING)", "toxic": "CASE WHEN toxic = 1 THEN '1' WHEN quality = 1 THEN '0' END"}


def _long(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Unpivot in one pass: an array of (field, value) for each row, exploded."""
    entries = F.array(*[F.struct(F.lit(k).alias("field"), F.expr(v).alias("value_json")) for k, v in rules.items()])
    return df.select("doc_id", F.explode(entries).alias("e")).select("doc_id", "e.field", "e.value_json")


def _long_sql(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {v.replace('STRING', 'VARCHAR')} AS value_json FROM {table}" for k, v in rules.items())


_WITH = f"WITH p1 AS ({_long_sql('documents', RUN1)}), p2 AS ({_long_sql('documents', RUN2)}), g AS ({_long_sql('labels', GOLD)})"
_OUTCOME = "CASE WHEN {p} IS NULL AND {g} IS NULL THEN 'correct_abstain' WHEN {g} IS NULL THEN 'hallucination' WHEN {p} IS NULL THEN 'over_abstain' WHEN {p} = {g} THEN 'correct_value' ELSE 'wrong_value' END"
_SCORED = _WITH + f", c AS (SELECT p1.doc_id, p1.field, 'single_choice' AS kind, p1.value_json AS p, g.value_json AS g, {_OUTCOME.format(p='p1.value_json', g='g.value_json')} AS outcome FROM p1 JOIN g USING (doc_id, field))"
_COUNTS = "count(*) AS n, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in scoring.OUTCOMES) + ", count(*) FILTER (outcome LIKE 'correct%') AS correct, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (outcome LIKE 'correct%')::DOUBLE / count(*) END AS accuracy"
_PAIRED = _WITH + f", c AS (SELECT doc_id, field, p1.value_json AS a, p2.value_json AS b, {_OUTCOME.format(p='p1.value_json', g='g.value_json')} AS o1, {_OUTCOME.format(p='p2.value_json', g='g.value_json')} AS o2 FROM p1 JOIN p2 USING (doc_id, field) JOIN g USING (doc_id, field))"


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    return _long(docs, RUN1), _long(docs, RUN2), _long(labels, GOLD)


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, fields.FIELDS)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    p1, _, g = _runs(spark, sf)
    return scoring.score_cells(p1, g, _fields(spark), "doc_id")


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return compare.paired_cells(*_runs(spark, sf), doc="doc_id")


# ---------------------------------------------------------------- scoring


@query(_SCORED + f" SELECT field, {_COUNTS} FROM c GROUP BY field")
def outcome_report(spark, sf):
    """The flagship: predictions joined to gold, classified, counted."""
    return scoring.subset_stats(_scored(spark, sf), "field")


@query(_SCORED + " SELECT doc_id, field, p AS pred_json, g AS gold_json, outcome FROM c")
def cls01_cell_outcome(spark, sf):
    return _scored(spark, sf).select("doc_id", "field", "pred_json", "gold_json", "outcome")


@query(_PAIRED + " SELECT doc_id, field, o1, o2 FROM c")
def cls02_blind_outcome(spark, sf):
    return _paired(spark, sf).select("doc_id", "field", "o1", "o2")


@query(_SCORED + f", f AS (SELECT *, field = 'toxic' AS is_top, CASE WHEN field = 'quality' THEN coalesce(g = '0', false) END AS is_sub FROM c) SELECT 'overall' AS overlay, NULL AS \"group\", {_COUNTS} FROM f UNION ALL SELECT 'kind', kind, {_COUNTS} FROM f GROUP BY kind UNION ALL SELECT 'top_risk', is_top::VARCHAR, {_COUNTS} FROM f GROUP BY is_top UNION ALL SELECT 'substituted', is_sub::VARCHAR, {_COUNTS} FROM f WHERE is_sub IS NOT NULL GROUP BY is_sub")
def agg08_overlay_stats(spark, sf):
    top = spark.createDataFrame([("toxic",)], "field string")
    dictionary = spark.createDataFrame([("quality", "0", "zero")], "field string, canonical string, modified string")
    return scoring.overlay_stats(scoring.with_overlays(_scored(spark, sf), top, dictionary))


@query(_SCORED + " SELECT doc_id, field, outcome FROM c WHERE outcome NOT LIKE 'correct%' ORDER BY doc_id, CASE field WHEN 'quality' THEN 0 ELSE 1 END LIMIT 50")
def srt05_first_mismatches(spark, sf):
    return scoring.mismatches(_scored(spark, sf), 50, ("doc_id", "ordinal")).select("doc_id", "field", "outcome")


# ---------------------------------------------------------------- run against run


@query(_PAIRED + " SELECT o1, o2, count(*) AS n FROM c GROUP BY o1, o2")
def agg09_confusion(spark, sf):
    return compare.confusion(_paired(spark, sf))


@query(_PAIRED + " SELECT o1, o2, count(*) AS n FROM c WHERE o1 <> o2 GROUP BY o1, o2")
def srt04_outcome_flips(spark, sf):
    return compare.outcome_flips(_paired(spark, sf))


@query(_PAIRED + " SELECT field, count(*) FILTER (a IS DISTINCT FROM b) AS flips, count(*) AS n FROM c GROUP BY field")
def agg10_flips_by_field(spark, sf):
    return compare.flips_by_field(_paired(spark, sf))


@query(_PAIRED + " SELECT field, count(*) FILTER (a IS DISTINCT FROM b) AS flips, count(*) AS n FROM c GROUP BY field HAVING flips > 0 ORDER BY flips DESC, field LIMIT 10")
def srt03_most_volatile(spark, sf):
    return compare.most_volatile(_paired(spark, sf))


@query(_PAIRED + " SELECT field, doc_id, a AS p1, b AS p2, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS rank FROM c WHERE a IS DISTINCT FROM b) WHERE rank <= 3")
def agg11_examples(spark, sf):
    return compare.examples(_paired(spark, sf), 3, "doc_id").select("field", "doc_id", "p1", "p2", "rank")


@query(_PAIRED + ", s AS (SELECT count(*) AS n, count(*) FILTER (a IS NOT DISTINCT FROM b) AS same, count(*) FILTER (o1 = o2) AS alike, count(*) FILTER (o1 LIKE 'correct%') AS c1, count(*) FILTER (o2 LIKE 'correct%') AS c2 FROM c) SELECT n, same AS same_value, same::DOUBLE / n AS value_agreement, alike::DOUBLE / n AS outcome_agreement, c1 AS correct1, c2 AS correct2, abs(c1 - c2) AS delta, abs(c1 - c2)::DOUBLE / n AS noise_floor FROM s")
def agg12_agreement(spark, sf):
    return compare.agreement(_paired(spark, sf))


@query(_PAIRED + " SELECT DISTINCT doc_id FROM c")
def set01_key_intersection(spark, sf):
    p1, p2, g = _runs(spark, sf)
    return p1.select("doc_id").intersect(p2.select("doc_id")).intersect(g.select("doc_id"))


# ---------------------------------------------------------------- merge

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"
_VOTES = f"WITH e AS (SELECT user_id, 'f' || ({_K} % 7) AS field, event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS v FROM events), n AS (SELECT user_id, field, v, count(*) AS n, min(event_id) AS first FROM e WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY user_id, field ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY user_id, field) AS k FROM n), s AS (SELECT user_id, field, max(k) AS k, count(*) FILTER (r = 1) AS tops, max(v) FILTER (r = 1) AS top, sum(n)::BIGINT AS votes, string_agg(v, '|' ORDER BY first) AS every, string_agg(v, '|' ORDER BY first) FILTER (r = 1) AS tied, string_agg(v || ':' || n, '|' ORDER BY v) AS dist FROM r GROUP BY user_id, field)"


def _event_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return t(spark, sf, "events").select("user_id", F.concat(F.lit("f"), (k % 7).cast("string")).alias("field"), F.col("event_id").alias("chunk_id"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("value_json"))


@query(_VOTES + " SELECT d.user_id, d.field, CASE WHEN tops = 1 THEN top END AS picked, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN 'majority_vote' ELSE 'tie_to_null' END END AS mode, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN every ELSE tied END END AS values, coalesce(votes, 0) AS n_votes FROM (SELECT DISTINCT user_id, field FROM e) d LEFT JOIN s USING (user_id, field)")
def agg03_majority_vote(spark, sf):
    v = merge.vote(_event_cells(spark, sf), ["user_id", "field"])
    return v.select("user_id", "field", "picked", "mode", F.array_join("values", "|").alias("values"), "n_votes")


@query(_VOTES + " SELECT user_id, field, dist FROM s")
def agg06_vote_distribution(spark, sf):
    v = merge.vote(_event_cells(spark, sf), ["user_id", "field"]).where("n_votes > 0")
    pairs = F.array_sort(F.transform(F.map_entries("vote_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return v.select("user_id", "field", F.array_join(pairs, "|").alias("dist"))


@query("SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels FROM events GROUP BY 1, 2")
def agg04_label_union(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.to_json(F.array("event_type")).alias("value_json"))
    return merge.union_labels(e, ["user_id", "day"]).select("user_id", "day", F.array_join("labels", "|").alias("labels"))


@query(_VOTES + ", per AS (SELECT u.user_id, count(*) FILTER (s.k > 1) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id GROUP BY 1) SELECT count(*) AS documents, sum(n)::BIGINT AS conflicts, min(n) AS least, avg(n) AS mean, max(n) AS most FROM per")
def agg14_conflict_summary(spark, sf):
    votes = merge.vote(_event_cells(spark, sf), ["user_id", "field"])
    return merge.conflict_summary(t(spark, sf, "events").select("user_id"), votes.where("mode IS NOT NULL"), "user_id")


@query(_VOTES + " SELECT CASE WHEN tops = 1 THEN 'majority_vote' ELSE 'tie_to_null' END AS mode, count(*) AS n FROM s WHERE k > 1 GROUP BY 1")
def agg15_conflicts_by_mode(spark, sf):
    return merge.conflicts_by_mode(merge.vote(_event_cells(spark, sf), ["user_id", "field"]).where("mode IS NOT NULL"))


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def agg01_collect_sorted(spark, sf):
    g = merge.collected(t(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return g.select("conv_id", F.array_join(F.transform("rows", lambda r: r["role"]), "|").alias("roles"), F.size("rows").cast("long").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def agg02_first_per_key(spark, sf):
    return files.first_per_key(t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("ordinal")), "user_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def src02_last_per_key(spark, sf):
    return files.last_per_key(t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("ordinal")), "user_id").select("user_id", "event_type", "event_id")


# ---------------------------------------------------------------- chunking

_FIXED = "WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS size, 0 AS chunk_id, 0::BIGINT AS s, least(4000, length(text))::BIGINT AS e FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, text, size, chunk_id + 1, s + 3800, least(s + 7800, size) FROM c WHERE e < size)"


@query(_FIXED + " SELECT doc_id, chunk_id, s AS char_start, e AS char_end, e - s AS n_chars, (e - s) // 4 AS approx_tokens, CASE WHEN e = size THEN 'eof' ELSE 'hard' END AS boundary_kind, md5(substr(text, s + 1, e - s)) AS digest, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS n_chunks FROM c")
def chk04_fixed_chunks(spark, sf):
    c = chunking.fixed_chunks(t(spark, sf, "documents"), target=4000, overlap=200)
    return c.select("doc_id", "chunk_id", "char_start", "char_end", "n_chars", "approx_tokens", "boundary_kind", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chunks")


@query(_FIXED + ", n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM c) SELECT doc_id, chunk_id, md5('Contract: ' || doc_id || chr(10) || 'Chunk ' || (chunk_id + 1) || ' of ' || total || chr(10) || chr(10) || substr(text, s + 1, e - s)) AS digest FROM n")
def prj01_chunk_header(spark, sf):
    c = chunking.fixed_chunks(t(spark, sf, "documents"), target=4000, overlap=200)
    text = scalars.chunk_header(F.col("doc_id").cast("string"), "chunk_id", "n_chunks", "text")
    return c.select("doc_id", "chunk_id", F.md5(text.cast("binary")).alias("digest"))


@query(_FIXED + ", x AS (SELECT c.*, d.lang, (e - s) // 4 AS tok FROM c JOIN documents d USING (doc_id)), per AS (SELECT lang, doc_id, count(*) AS k FROM x GROUP BY ALL), a AS (SELECT lang, count(*) AS n_documents, list_sort(list(k))[floor(count(*) * 0.5)::INTEGER + 1] AS median_chunks, max(k) AS most_chunks FROM per GROUP BY lang), b AS (SELECT lang, count(*) AS n_chunks, list_sort(list(tok))[floor(count(*) * 0.5)::INTEGER + 1] AS tokens_p50, list_sort(list(tok))[least(floor(count(*) * 0.95)::INTEGER, count(*) - 1) + 1] AS tokens_p95, max(tok) AS tokens_max, avg(CASE WHEN tok < 900 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS fits_percent, count(*) FILTER (e = size) AS n_eof, count(*) FILTER (e < size) AS n_hard FROM x GROUP BY lang) SELECT * FROM a JOIN b USING (lang)")
def agg13_split_summary(spark, sf):
    docs = t(spark, sf, "documents")
    chunks = chunking.fixed_chunks(docs, target=4000, overlap=200).join(docs.select("doc_id", "lang"), "doc_id")
    return corpus.split_summary(chunks, by="lang", doc="doc_id", tokens="approx_tokens", fits=900).drop("n_article", "n_section", "n_paragraph", "n_sentence")


# ---------------------------------------------------------------- corpus: filters, joins, samples, splits


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def jn05_resume(spark, sf):
    return corpus.todo(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) ANTI JOIN labels USING (doc_id)")
def flt04_limit_then_resume(spark, sf):
    return corpus.todo(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), ["doc_id"], limit=100, order="doc_id")


@query("SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 1")
def jn01_assemble(spark, sf):
    labels = corpus.usable(t(spark, sf, "labels").withColumn("usable", F.col("quality") == 1), "usable")
    docs = t(spark, sf, "documents")
    whole, _ = corpus.assemble(labels.select("doc_id"), t(spark, sf, "labels").select("doc_id", "quality"), docs.select("doc_id", "n_chars"), "doc_id")
    return whole.select("doc_id", "quality", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 1")
def agg18_one_shot(spark, sf):
    return corpus.one_shot(t(spark, sf, "documents").select("doc_id", "n_chars"), t(spark, sf, "labels"), "doc_id", "n_chars")


@query("SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UINTEGER % 10 AS b FROM documents)")
def smp02_hash_split(spark, sf):
    return corpus.hash_split(t(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents GROUP BY doc_id ORDER BY md5(doc_id::VARCHAR || '42'), doc_id LIMIT 15")
def smp01_hash_sample(spark, sf):
    return corpus.hash_sample(t(spark, sf, "documents"), "doc_id", 15)


# The seeded places depend on the number of names alone: those of the three sizes of the table.
_NAMES = (200, 1_000, 10_000)
_RANKED = "WITH r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT 'doc_' || doc_id AS name FROM documents))"
_PLACES = " UNION ALL ".join(f"SELECT {n} AS n, unnest({ranks.drawn(n, 15, 42)}) AS rank" for n in _NAMES)
_CODES = " ".join(f"WHEN {n} THEN '{ranks.split_codes(n, 42, 0.8, 0.1).decode()}'" for n in _NAMES)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))


@query(f"{_RANKED} SELECT name FROM r JOIN ({_PLACES}) USING (n, rank)")
def smp01_exact_sample(spark, sf):
    return corpus.exact_sample(_names(spark, sf), 15)


@query(f"{_RANKED} SELECT name, CASE substr(CASE n {_CODES} END, rank + 1, 1) WHEN '0' THEN 'train' WHEN '1' THEN 'val' ELSE 'test' END AS split FROM r")
def smp02_exact_split(spark, sf):
    return corpus.exact_split(_names(spark, sf))


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS documents FROM documents GROUP BY lang")
def agg16_distinct_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT 'long' AS split, doc_id FROM documents WHERE n_chars >= 5000 UNION ALL SELECT 'short', doc_id FROM documents WHERE n_chars < 5000")
def set06_union_splits(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars")
    return corpus.union_splits({"long": d.where("n_chars >= 5000").select("doc_id"), "short": d.where("n_chars < 5000").select("doc_id")})


@query("SELECT avg(CASE WHEN n_chars // 4 < 1000 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS fits_percent, count(*) FILTER (contains(text, '\"')) AS quoted FROM documents")
def flt11_threshold(spark, sf):
    return t(spark, sf, "documents").agg((F.avg(F.when(scalars.approx_tokens("text") < 1000, 1.0).otherwise(0.0)) * 100).alias("fits_percent"), F.count_if(F.contains("text", F.lit('"'))).alias("quoted"))


@query("SELECT lang, list_sort(list(n_chars))[floor(count(*) * 0.5)::INTEGER + 1] AS p50, list_sort(list(n_chars))[least(floor(count(*) * 0.95)::INTEGER, count(*) - 1) + 1] AS p95 FROM documents GROUP BY lang")
def srt07_order_statistics(spark, sf):
    return scalars.order_statistics(t(spark, sf, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p95": 0.95})


# ---------------------------------------------------------------- risk


@query("WITH v AS (SELECT source AS field, quality::VARCHAR AS v FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT field, v, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT field, count(v) AS n_distinct_observed, coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS support, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS null_count FROM n GROUP BY field), m AS (SELECT field, v, n FROM n WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, v) = 1) SELECT field, n_distinct_observed, support, null_count, m.v AS majority_answer, coalesce(m.n, 0) AS majority_count, null_count::DOUBLE / (null_count + support) AS absence_rate, CASE WHEN support = 0 THEN 0 ELSE coalesce(m.n, 0)::DOUBLE / support END AS majority_share, (null_count::DOUBLE / (null_count + support)) * (CASE WHEN support = 0 THEN 0 ELSE coalesce(m.n, 0)::DOUBLE / support END) AS pcl_risk FROM s LEFT JOIN m USING (field)")
def agg19_field_risk(spark, sf):
    cells = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("field"), F.col("quality").cast("string").alias("value_json"))
    return risk.field_risk(cells)


@query("SELECT p_partkey::VARCHAR AS field FROM part WHERE p_size <= 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def srt02_top_risk(spark, sf):
    parts = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("field"), F.col("p_size").cast("string").alias("cardinality"), F.col("p_retailprice").cast("string").alias("pcl_risk"), F.col("p_partkey").alias("ordinal"))
    return scoring.top_risk_fields(parts)


# ---------------------------------------------------------------- dictionaries


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS value FROM orders")
def dic02_remap(spark, sf):
    cells = t(spark, sf, "orders").select("o_orderkey", F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"))
    words = spark.createDataFrame([("priority", "1-URGENT", "urgent"), ("priority", "5-LOW", "low")], "field string, canonical string, modified string")
    return fields.remap(cells, words).select("o_orderkey", "value")


@query("SELECT doc_id, 'say ' || chr(39) || lang || chr(39) || ' ' || doc_id AS modified FROM documents WHERE doc_id % 2 = 0")
def dic01_quote_dictionary(spark, sf):
    label = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('say \"', lang, '\" ', doc_id) ELSE lang END")
    dim = t(spark, sf, "documents").select(F.col("doc_id").alias("field"), F.array(label, "source").alias("labels"))
    return fields.quote_dictionary(dim).select(F.col("field").alias("doc_id"), "modified")


# ---------------------------------------------------------------- grounding

@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def jn11_verbatim_passages(spark, sf):
    """Passages found verbatim in whichever documents hold them, by one automaton over all passages."""
    return patterns.passages_in(t(spark, sf, "benchmark").select("item_id", F.col("text").alias("span")), t(spark, sf, "documents").select("doc_id", "text"))


_LOCAL = "WITH ev AS (SELECT * FROM (SELECT conv_id, role AS field, trim(unnest(string_split(text, '. '))) AS span FROM conversations) WHERE span <> ''), gold AS (SELECT DISTINCT conv_id, role AS field, 'yes' AS v FROM conversations), hit AS (SELECT DISTINCT ev.conv_id, ev.field, c.turn FROM ev JOIN conversations c ON c.conv_id = ev.conv_id AND contains(c.text, ev.span)), local AS (SELECT g.conv_id, c.turn, g.field, CASE WHEN h.turn IS NOT NULL THEN g.v END AS value_json FROM gold g JOIN conversations c USING (conv_id) LEFT JOIN hit h ON h.conv_id = g.conv_id AND h.field = g.field AND h.turn = c.turn)"


def _local(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence is every sentence of every turn, for the field of its role; the gold has all roles of a conversation."""
    turns = t(spark, sf, "conversations").select(F.col("conv_id").alias("contract_name"), F.col("turn").alias("chunk_id"), "role", "text")
    glued = F.array_join(F.split("text", "\\. "), "<omitted>")
    evidence = grounding.spans_of(turns.select("contract_name", F.col("role").alias("field"), glued.alias("evidence")), ["contract_name", "field"])
    gold = turns.select("contract_name", F.col("role").alias("field"), F.lit("yes").alias("value_json")).distinct()
    return grounding.localized_gold(gold, turns, evidence), evidence, turns


@query(_LOCAL + " SELECT conv_id, turn, field, value_json FROM local")
def doc01_localized_gold(spark, sf):
    return _local(spark, sf)[0].select(F.col("contract_name").alias("conv_id"), F.col("chunk_id").alias("turn"), "field", "value_json")


@query(_LOCAL + ", k AS (SELECT conv_id, turn, role AS field FROM conversations WHERE turn % 2 = 0), j AS (SELECT k.*, l.value_json AS gold FROM k LEFT JOIN local l USING (conv_id, turn, field)), f AS (SELECT count(*) AS located FROM (SELECT DISTINCT conv_id, field FROM local WHERE value_json IS NOT NULL)), a AS (SELECT count(*) AS with_evidence FROM (SELECT DISTINCT conv_id, field FROM ev)) SELECT (SELECT count(*) FROM j) AS commits, (SELECT count(*) FROM j WHERE gold IS NULL) AS fabricated, (SELECT count(*) FILTER (gold IS NULL)::DOUBLE / count(*) FROM j) AS fabrication_rate, located, with_evidence, located::DOUBLE / with_evidence AS coverage FROM f, a")
def doc03_fabrication(spark, sf):
    local, evidence, turns = _local(spark, sf)
    commits = turns.where("chunk_id % 2 = 0").select("contract_name", "chunk_id", F.col("role").alias("field"), F.lit("yes").alias("value_json"))
    return grounding.fabrication(commits, local, evidence)


@query(_LOCAL + f", k AS (SELECT conv_id, turn, role AS field, CASE WHEN turn % 2 = 0 THEN 'yes' END AS p FROM conversations), c AS (SELECT field, {_OUTCOME.format(p='p', g='value_json')} AS outcome FROM k JOIN local USING (conv_id, turn, field)) SELECT field, {_COUNTS} FROM c GROUP BY field")
def doc02_chunk_scores(spark, sf):
    """Chunk answers against localized gold."""
    local, _, turns = _local(spark, sf)
    preds = turns.select("contract_name", "chunk_id", F.col("role").alias("field"), F.when(F.col("chunk_id") % 2 == 0, F.lit("yes")).alias("value_json"))
    dim = spark.createDataFrame([(i, r, "single_choice", False, ["yes"]) for i, r in enumerate(("user", "assistant", "system"))], fields.FIELDS)
    return scoring.subset_stats(scoring.score_cells(preds, local, dim, "contract_name", "chunk_id"), "field")


@query("SELECT conv_id, turn, role AS field FROM conversations WHERE turn % 2 = 0 AND NOT contains(lower(text), CASE role WHEN 'user' THEN 'the' ELSE 'and' END)")
def doc06_anchorless(spark, sf):
    turns = t(spark, sf, "conversations")
    cells = turns.select("conv_id", "turn", F.col("role").alias("field"), F.when(F.col("turn") % 2 == 0, F.lit("yes")).alias("value_json"))
    anchors = spark.createDataFrame([("user", "the"), ("assistant", "and"), ("system", "and")], "field string, phrase string")
    return grounding.anchorless(cells, turns, anchors, ["conv_id", "turn"]).select("conv_id", "turn", "field")


@query("SELECT doc_id FROM labels WHERE (quality = 0) <> (toxic = 1)")
def doc05_invariant(spark, sf):
    cells = t(spark, sf, "labels").select("doc_id", F.expr("CASE WHEN quality = 0 THEN '0' END").alias("value_json"), F.expr("CASE WHEN toxic = 1 THEN '1' END").alias("evidence_json"))
    return grounding.invariant_violations(cells).select("doc_id")


@query("WITH p AS (SELECT user_id, event_id % 50 AS c, count(*) FILTER (event_id % 6 <> 0) AS n FROM events GROUP BY ALL) SELECT list_sort(list(n))[floor(count(*) * 0.5)::INTEGER + 1] AS median, avg(n) AS mean, max(n) AS most, count(*) FILTER (n > 2) AS full_chunks, count(*) AS chunks FROM p")
def agg20_fill_distribution(spark, sf):
    cells = t(spark, sf, "events").select("user_id", (F.col("event_id") % 50).alias("c"), F.when(F.col("event_id") % 6 != 0, F.lit("x")).alias("value_json"))
    return grounding.fill_distribution(cells, ["user_id", "c"], many=2)


@query(_VOTES + " SELECT user_id, count(*) FILTER (k > 1) AS contradictory, count(*) AS fields FROM s GROUP BY user_id")
def agg21_contradictions(spark, sf):
    return grounding.contradictions(_event_cells(spark, sf), "user_id")


# ---------------------------------------------------------------- JSON cells

@query(f"SELECT event_id, 'k' AS field, {_K}::VARCHAR AS value_json FROM events")
def prj10_observed_cells(spark, sf):
    return cells_.observed(t(spark, sf, "events").select("event_id", "props"), "props", ["event_id"])


@query(f"SELECT event_id, 'k' AS field, {_K}::VARCHAR AS value_json FROM events UNION ALL SELECT event_id, 'absent', NULL FROM events")
def prj09_cells_over_schema(spark, sf):
    dim = spark.createDataFrame([(0, "k", "freetext", False, []), (1, "absent", "freetext", False, [])], fields.FIELDS)
    return cells_.over_schema(t(spark, sf, "events").select("event_id", "props"), dim, "props", ["event_id"])


@query("SELECT o_orderkey::VARCHAR AS contract_name, '{\"contract_name\":\"' || o_orderkey || '\",\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS record FROM orders")
def prj11_pivot(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("contract_name"), F.explode(F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("v")))).alias("c"))
    return cells_.pivot(o.select("contract_name", "c.field", F.concat(F.lit('"'), "c.v", F.lit('"')).alias("value_json")))


@query(_WITH + " SELECT doc_id, count(value_json) AS n_non_null FROM p1 GROUP BY doc_id")
def prj04_filled(spark, sf):
    return cells_.filled(_runs(spark, sf)[0], ["doc_id"])


# ---------------------------------------------------------------- pins, text, resume


@query("WITH pins AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents), cur AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS now FROM documents WHERE doc_id % 9 <> 0) SELECT path, sha256, now, CASE WHEN now IS NULL THEN 'missing' WHEN now <> sha256 THEN 'mismatch' ELSE 'match' END AS status FROM pins LEFT JOIN cur USING (path)")
def jn09_drift(spark, sf):
    d = t(spark, sf, "documents")
    pinned = d.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    changed = d.where("doc_id % 9 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return pins.drift(pinned, changed)


@query("SELECT doc_id, coalesce(left(text, 50), 'null') AS shown, length(text) // 4 AS tokens FROM documents")
def prj14_value_display(spark, sf):
    return t(spark, sf, "documents").select("doc_id", scalars.value_display("text").alias("shown"), scalars.approx_tokens("text").alias("tokens"))


@query("SELECT doc_id, list_sort(list_distinct([lang, source, lang])) = list_sort(list_distinct([source, lang])) AS as_sets, list_sort([lang, source, lang]) = list_sort([source, lang]) AS as_lists FROM documents")
def set04_set_equality(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", scalars.set_equal(F.array("lang", "source", "lang"), F.array("source", "lang")).alias("as_sets"), scalars.multiset_equal(F.array("lang", "source", "lang"), F.array("source", "lang")).alias("as_lists"))


@query(_SCORED + ", s AS (SELECT field, count(*) AS n, count(*) FILTER (outcome LIKE 'correct%') AS k FROM c GROUP BY field) SELECT field, k::DOUBLE / n AS rate FROM s")
def prj19_rate(spark, sf):
    s = scoring.subset_stats(_scored(spark, sf), "field")
    return s.select("field", scalars.rate("correct", "n").alias("rate"))


@query("SELECT count(*) AS calls, count(*) FILTER (event_type <> 'error') AS succeeded, sum(event_id)::BIGINT AS input_tokens, 0::BIGINT AS cached_tokens, sum(user_id)::BIGINT AS output_tokens, sum(event_id % 3)::BIGINT AS reasoning_tokens, count(*) * 0.5::DOUBLE AS wall_s FROM events")
def agg17_usage(spark, sf):
    e = t(spark, sf, "events")
    usage = F.struct(F.col("event_id").alias("input_tokens"), F.struct(F.lit(None).cast("long").alias("cached_tokens")).alias("input_tokens_details"), F.col("user_id").alias("output_tokens"), F.struct((F.col("event_id") % 3).alias("reasoning_tokens")).alias("output_tokens_details"))
    return extract.usage_summary(e.select(usage.alias("usage"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"), F.lit(0.5).alias("duration_s")))


from folioflow import file_queries, join_queries, record_queries, stream_queries  # noqa: E402, F401  they register more, and use what is above
