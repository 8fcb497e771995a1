"""Registered queries of projections, filters, chunks, multilabel fields, dictionaries, schemas and scalar functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import scalars, sql_surface
from folioflow.operators import cells as cells_
from folioflow.operators import chunking, compare, corpus, extract, fields, grounding, merge, scoring
from folioflow.plans import lifecycle
from folioflow.queries import _COUNTS, _FIXED, _OUTCOME, _PAIRED, _SCORED, _VOTES, GOLD, RUN1, _event_cells, _long, _paired, _scored
from folioflow.registry import query, t

# ---------------------------------------------------------------- corpus rows and projections


@query(
    _FIXED
    + """, n AS (SELECT *, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total FROM c)
    SELECT doc_id::VARCHAR AS contract_name, chunk_id, total AS n_chunks_in_contract, s AS char_start, e AS char_end, CASE WHEN e = size THEN 'eof' ELSE 'hard' END AS boundary_kind,
           md5('Contract: ' || doc_id || chr(10) || 'Chunk ' || (chunk_id + 1) || ' of ' || total || chr(10) || chr(10) || substr(text, s + 1, e - s)) AS digest,
           '{"contract_name":"' || doc_id || '","quality":' || quality || ',"toxic":' || CASE WHEN toxic = 1 THEN '1' ELSE 'null' END || '}' AS target_json,
           e - s AS input_chars, (e - s) // 4 AS input_tokens_approx, (2 + toxic)::INTEGER AS n_target_non_null, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS corpus_status
    FROM n JOIN labels USING (doc_id)"""
)
def prj02_corpus_rows(spark, sf):
    """All 12 columns of a corpus row, the name among the filled fields (PRJ03)."""
    name = F.col("doc_id").cast("string").alias("contract_name")
    labels = t(spark, sf, "labels")
    target = F.to_json(F.struct(name, "quality", F.when(F.col("toxic") == 1, 1).alias("toxic")), {"ignoreNullFields": "false"})
    chunks = chunking.fixed_chunks(t(spark, sf, "documents"), target=4000, overlap=200).withColumn("contract_name", F.col("doc_id").cast("string"))
    rows = chunking.corpus_rows(chunks, labels.select(name, target.alias("target_json")), labels.select(name, F.when(F.col("quality") == 1, "good").otherwise("poor").alias("status")))
    return rows.withColumn("digest", F.md5(F.col("input").cast("binary"))).drop("input")


@query(_FIXED + " SELECT doc_id::VARCHAR AS contract_name, chunk_id, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS n FROM c JOIN labels USING (doc_id)")
def prj06_chunk_count(spark, sf):
    return prj02_corpus_rows(spark, sf).select("contract_name", "chunk_id", F.col("n_chunks_in_contract").alias("n"))


_RUN1_ROWS = f"(SELECT doc_id, {RUN1['quality'].replace('STRING', 'VARCHAR')} AS q, {RUN1['toxic'].replace('STRING', 'VARCHAR')} AS x FROM documents)"


@query(f"SELECT doc_id, 1 + (q IS NOT NULL)::BIGINT + (x IS NOT NULL)::BIGINT AS n_non_null FROM {_RUN1_ROWS}")
def prj03_filled_with_name(spark, sf):
    return cells_.filled(_long(t(spark, sf, "documents"), RUN1), ["doc_id"], with_name=True)


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def prj05_approx_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", scalars.approx_tokens("text").alias("tokens"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN NULL WHEN 2 THEN o_orderpriority END AS value FROM orders")
def prj07_first_present_key(spark, sf):
    """A key that is there with a null counts as present; without any key there is no value."""
    line = """CASE o_orderkey % 4 WHEN 0 THEN concat('{"input":"', o_orderstatus, '","text":"b"}') WHEN 1 THEN '{"prompt":null,"input":"a"}' WHEN 2 THEN concat('{"text":"', o_orderpriority, '"}') ELSE '{"other":1}' END"""
    return t(spark, sf, "orders").select("o_orderkey", F.expr(line).alias("record")).select("o_orderkey", cells_.first_present("record", "prompt", "input", "text").alias("value"))


@query("SELECT doc_id, f AS field FROM documents, (VALUES ('lang'), ('source')) AS v(f)")
def prj12_without_evidence(spark, sf):
    """Fields that end in ``_evidence_spans`` go, from cells and from records alike."""
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source")
    names = F.array(*map(F.lit, ("lang", "lang_evidence_spans", "source", "source_evidence_spans")))
    cells = cells_.without_evidence(docs.where("doc_id % 2 = 0").select("doc_id", F.explode(names).alias("field")))
    record = F.to_json(F.struct("lang", F.array("lang").alias("lang_evidence_spans"), "source", F.array().cast("array<string>").alias("source_evidence_spans")))
    return cells.union(cells_.observed(docs.where("doc_id % 2 <> 0").select("doc_id", record.alias("r")), "r", ["doc_id"]).select("doc_id", "field"))


@query("SELECT doc_id, left(trim(regexp_replace(regexp_extract(right(text, 120), '[^\\n]*$'), '\\s+', ' ', 'g')), 60) AS shown FROM documents")
def prj13_preview(spark, sf):
    return t(spark, sf, "documents").select("doc_id", scalars.preview("text").alias("shown"))


@query("SELECT item_id, 'system:s|user:q|assistant:a|user:' || md5(text) AS chat, 'system:s|user:' || md5(text) AS plain FROM benchmark")
def prj15_chat_messages(spark, sf):
    user = F.md5(F.col("text").cast("binary"))
    show = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return t(spark, sf, "benchmark").select("item_id", show(scalars.chat_messages(F.lit("s"), user, (F.lit("q"), F.lit("a")))).alias("chat"), show(scalars.chat_messages(F.lit("s"), user)).alias("plain"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN '__idx__' ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN event_id ELSE user_id END AS number FROM events")
def prj16_row_key(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("contract_name"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("chunk_id"), F.col("event_id").alias("ordinal"))
    return e.select("event_id", cells_.row_key().alias("k")).select("event_id", "k.name", "k.number")


@query("SELECT p_partkey, split_part(n, '_', 1) AS stage, ltrim(substr(n, length(split_part(n, '_', 1)) + 1), '_') AS variation FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'e' || p_size ELSE 'e' || p_size || '_' || replace(p_name, ' ', '_') END AS n FROM part)")
def prj17_run_name(spark, sf):
    name = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('e', p_size) ELSE concat('e', p_size, '_', replace(p_name, ' ', '_')) END")
    stage, variation = scalars.stage_and_variation(name)
    return t(spark, sf, "part").select("p_partkey", stage.alias("stage"), variation.alias("variation"))


@query("SELECT p_partkey, p_type AS role, '/d=' || p_size || '/' || p_name AS path, p_partkey % 2 = 0 AS copy FROM part")
def prj18_input_spec(spark, sf):
    spec = F.expr("concat(p_type, '=/d=', p_size, '/', p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ':nocopy' END)")
    return t(spark, sf, "part").select("p_partkey", scalars.input_spec(spec).alias("s")).select("p_partkey", "s.role", "s.path", "s.copy")


@query("SELECT user_id, CASE WHEN n = 0 THEN '—' ELSE printf('%.1f%%', 100.0::DOUBLE * k / n) END AS shown FROM (SELECT user_id, count(*) FILTER (event_id % 6 = 1) AS n, count(*) FILTER (event_id % 12 = 1) AS k FROM events GROUP BY user_id)")
def prj20_percent_text(spark, sf):
    per = t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 6 == 1).alias("n"), F.count_if(F.col("event_id") % 12 == 1).alias("k"))
    return per.select("user_id", scalars.percent_text("k", "n").alias("shown"))


# ---------------------------------------------------------------- filters


@query("SELECT doc_id FROM labels WHERE quality = 1")
def flt01_usable(spark, sf):
    return corpus.usable(t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("usable_for_snippet_training"))).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def flt02_by_name(spark, sf):
    return corpus.pick(t(spark, sf, "documents").select("doc_id", "lang"), name="fr", key="lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 17")
def flt03_by_ordinal(spark, sf):
    """The ordinal goes before the name."""
    return corpus.pick(t(spark, sf, "documents").select("doc_id", "lang"), name="xx", line=17, key="lang", ordinal="doc_id")


@query(_SCORED + " SELECT doc_id, field FROM c WHERE field = 'quality'")
def flt05_scored_kinds(spark, sf):
    """Of two fields one is free text, which is not scored."""
    dim = spark.createDataFrame([(0, "quality", "single_choice", False, ["0", "1"]), (1, "toxic", "freetext", False, [])], fields.FIELDS)
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    return scoring.score_cells(_long(docs, RUN1), _long(labels, GOLD), dim, "doc_id").select("doc_id", "field")


@query("SELECT p_partkey::VARCHAR AS field FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 4 <> 2 AND p_size <= 5")
def flt06_few_values(spark, sf):
    """Cardinalities and risks are text: what does not parse is passed over."""
    p = t(spark, sf, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("field"), F.when(F.col("p_partkey") % 4 == 1, "many").otherwise(F.col("p_size").cast("string")).alias("cardinality"), F.when(F.col("p_partkey") % 4 == 2, "").otherwise(F.col("p_retailprice").cast("string")).alias("pcl_risk"), F.col("p_partkey").alias("ordinal"))
    return scoring.few_valued(rows).select("field")


@query(_SCORED + " SELECT doc_id, field, outcome FROM c WHERE outcome NOT LIKE 'correct%'")
def flt07_all_mismatches(spark, sf):
    return scoring.all_mismatches(_scored(spark, sf)).select("doc_id", "field", "outcome")


@query("SELECT event_id, 'k' AS field FROM events WHERE event_id % 4 = 0")
def flt08_objects_only(spark, sf):
    """Records that are no object (a list, a text, a number, nothing) give no cells."""
    shape = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[1]' WHEN 2 THEN '\"k\"' END")
    return cells_.observed(t(spark, sf, "events").select("event_id", shape.alias("prediction")), "prediction", ["event_id"]).select("event_id", "field")


@query("SELECT p_partkey AS field, p_name || ' \"' || p_partkey || '\"' AS canonical FROM part WHERE p_partkey % 3 = 0")
def flt09_labels_with_quotes(spark, sf):
    label = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' \"', p_partkey, '\"') ELSE p_name END")
    return fields.quote_dictionary(t(spark, sf, "part").select(F.col("p_partkey").alias("field"), F.array(label, F.lit("plain")).alias("labels"))).select("field", "canonical")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang = 'fr' OR source = 'wiki' END AS is_substituted FROM documents")
def flt10_any_affected_label(spark, sf):
    """Does the gold list hold any label that the dictionary rewrites? Fields without such labels have no answer."""
    gold = F.to_json(F.array("lang", "source")).alias("gold_json")
    cells = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise("tags").alias("field"), gold)
    words = spark.createDataFrame([("tags", "fr", "x"), ("tags", "wiki", "y")], "field string, canonical string, modified string")
    return scoring.with_overlays(cells, spark.createDataFrame([], "field string"), words).select("doc_id", "is_substituted")


@query("SELECT doc_id, lang = source OR doc_id % 4 = 0 AS repeats, lang = 'fr' AS unknown FROM documents WHERE lang = source OR doc_id % 4 = 0 OR lang = 'fr'")
def flt12_array_violations(spark, sf):
    d = t(spark, sf, "documents")
    found = F.when(F.col("doc_id") % 4 == 0, F.array("lang", "source", "source")).otherwise(F.array("lang", "source"))
    labels = [r[0] for r in d.select("lang").union(d.select("source")).distinct().where("lang <> 'fr'").collect()]
    dim = spark.createDataFrame([(0, "tags", "multilabel", True, labels)], fields.FIELDS)
    return fields.array_violations(d.select("doc_id", F.lit("tags").alias("field"), found.alias("labels_found")), dim).select("doc_id", "repeats", "unknown")


# ---------------------------------------------------------------- chunks at boundaries

_CUT = """[q FOR q IN range(high - low) IF substr(w, q + 2, 1) {head} AND regexp_matches(substr(w, q + 2, high - low - q), '{pattern}'){more}]"""
_FIRST = " AND NOT regexp_matches(substr(w, 2, q), '\\n\\s*$')"
_KINDS = {
    "article": _CUT.format(head="= 'A'", pattern="^(ARTICLE|Article)\\s+([IVX]+|\\d+)\\b", more=" AND NOT regexp_matches(substr(w, q + 1, 1), '\\w')"),
    "section": _CUT.format(head="= chr(10)", pattern="^\\n\\s*(Section|SECTION)?\\s*\\d+\\.\\d+\\b", more=_FIRST),
    "paragraph": _CUT.format(head="= chr(10)", pattern="^\\n\\s*\\n", more=_FIRST),
    "sentence": _CUT.format(head="= '.'", pattern="^\\.\\s+[A-Z\"'']", more=""),
}
#: Window by window: for each kind the places in it where a boundary begins, the last of the first kind that has any.
_CHUNKS = f"""WITH RECURSIVE c AS (
      SELECT doc_id, text, length(text) AS size, -1 AS chunk_id, -1::BIGINT AS s, 200::BIGINT AS e, '' AS kind, false AS done FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, text, size, chunk_id + 1, s2, CASE WHEN fin THEN size ELSE coalesce(low + coalesce(article, section, paragraph, sentence), high) END,
             CASE WHEN fin THEN 'eof' WHEN article IS NOT NULL THEN 'article' WHEN section IS NOT NULL THEN 'section' WHEN paragraph IS NOT NULL THEN 'paragraph' WHEN sentence IS NOT NULL THEN 'sentence' ELSE 'hard' END, fin
      FROM (SELECT *, {', '.join(f'CASE WHEN NOT fin THEN list_max({x}) END AS {k}' for k, x in _KINDS.items())}
            FROM (SELECT *, CASE WHEN fin THEN '' ELSE substr(text, low, high - low + 1) END AS w
                  FROM (SELECT *, s2 + 4000 >= size AS fin, greatest(s2 + 3600, s2 + 1) AS low, s2 + 4000 AS high FROM (SELECT *, greatest(e - 200, s + 1) AS s2 FROM c WHERE NOT done)))))
   , k AS (SELECT * FROM c WHERE chunk_id >= 0)"""


def _boundary_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(t(spark, sf, "documents"), target=4000, backoff=400, overlap=200)


@query(_CHUNKS + " SELECT doc_id, chunk_id, s AS char_start, e AS char_end, e - s AS n_chars, (e - s) // 4 AS approx_tokens, kind AS boundary_kind, md5(substr(text, s + 1, e - s)) AS digest, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS n_chunks FROM k")
def chk01_boundary_chunks(spark, sf):
    return _boundary_chunks(spark, sf).withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


@query(_CHUNKS + " SELECT doc_id, chunk_id, s AS char_start, e AS char_end, e - s AS n_chars, (e - s) // 4 AS approx_tokens, kind AS boundary_kind, md5(substr(text, s + 1, e - s)) AS digest FROM k")
def chk01_table_function(spark, sf):
    """The chunker called from SQL, beside each document."""
    sql_surface.register(spark)
    text = "SELECT d.doc_id, chunk_id, char_start, char_end, c.n_chars, approx_tokens, boundary_kind, md5(c.text) AS digest FROM {docs} AS d, LATERAL boundary_chunks(d.text, 4000, 400, 200, true) AS c"
    return spark.sql(text, docs=t(spark, sf, "documents"))


@query(
    f"{_VOTES}, p AS (SELECT d.user_id, d.field, CASE WHEN tops = 1 THEN top END AS picked, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN 'majority_vote' ELSE 'tie_to_null' END END AS mode, CASE WHEN k > 1 THEN CASE WHEN tops = 1 THEN every ELSE tied END END AS values, coalesce(votes, 0) AS n_votes, CASE WHEN d.user_id % 5 <> 0 THEN 'click' END AS gold_json FROM (SELECT DISTINCT user_id, field FROM e) d LEFT JOIN s USING (user_id, field)) SELECT user_id AS doc, field, picked, mode, values, n_votes, gold_json, {_OUTCOME.format(p='picked', g='gold_json')} AS outcome FROM p"
)
def plan03_merge_and_score_as_sql(spark, sf):
    """Vote and outcome in one flow of SQL text alone."""
    sql_surface.register(spark)
    cells = _event_cells(spark, sf).withColumnRenamed("user_id", "doc")
    gold = cells.select("doc", "field").distinct().select("doc", "field", F.lit("single_choice").alias("kind"), F.when(F.col("doc") % 5 != 0, "click").alias("gold_json"))
    return spark.sql(sql_surface.MERGE_AND_SCORE, cells=cells, gold=gold)


@query(
    _CHUNKS
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM k JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT doc_id::VARCHAR AS contract_name, chunk_id, kind AS boundary_kind, md5('Contract: ' || doc_id || chr(10) || 'Chunk ' || (chunk_id + 1) || ' of ' || total || chr(10) || chr(10) || substr(text, s + 1, e - s)) AS digest,
           CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UINTEGER % 10 AS b FROM n)"""
)
def plan01_corpus_build(spark, sf):
    """The first flow: usable documents with target and text into chunk rows with their split."""
    labels = t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("contract_name"), "quality")
    hygiene = labels.select("contract_name", (F.col("quality") == 1).alias("usable_for_snippet_training"), F.lit("ok").alias("status"))
    targets = labels.select("contract_name", F.to_json(F.struct("contract_name", "quality")).alias("target_json"))
    texts = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("contract_name"), "text")
    rows = lifecycle.build_corpus(hygiene, targets, texts, target=4000, backoff=400, overlap=200)
    return rows.select("contract_name", "chunk_id", "boundary_kind", F.md5(F.col("input").cast("binary")).alias("digest"), "split")


@query(_CHUNKS + " SELECT kind AS boundary_kind, count(*) AS n FROM k GROUP BY kind")
def chk02_boundary_kinds(spark, sf):
    """How often each kind was the best of its window."""
    return _boundary_chunks(spark, sf).groupBy("boundary_kind").agg(F.count(F.lit(1)).alias("n"))


@query(_CHUNKS + " SELECT doc_id, chunk_id, s + 4000 - e AS back FROM k WHERE kind NOT IN ('eof', 'hard')")
def chk03_last_match(spark, sf):
    """How far before the ideal end the last match of the best kind begins."""
    cut = _boundary_chunks(spark, sf).where("boundary_kind NOT IN ('eof', 'hard')")
    return cut.select("doc_id", "chunk_id", (F.col("char_start") + 4000 - F.col("char_end")).alias("back"))


# ---------------------------------------------------------------- joins, aggregates and sets of the scoring


@query(_SCORED + " SELECT DISTINCT doc_id FROM c")
def jn02_documents_of_both_sides(spark, sf):
    return _scored(spark, sf).select("doc_id").distinct()


@query(_PAIRED + " SELECT doc_id, field, a AS p1, b AS p2, g.value_json AS g FROM c JOIN g USING (doc_id, field)")
def jn03_three_way(spark, sf):
    return _paired(spark, sf).select("doc_id", "field", "p1", "p2", "g")


@query(_SCORED + " SELECT doc_id, field, field = 'toxic' AS is_top FROM c")
def jn07_top_flag(spark, sf):
    none = spark.createDataFrame([], "field string, canonical string, modified string")
    return scoring.with_overlays(_scored(spark, sf), spark.createDataFrame([("toxic",)], "field string"), none).select("doc_id", "field", "is_top")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'français' WHEN lang = 'de' THEN 'deutsch' ELSE lang END AS value FROM documents")
def jn08_lookup_or_self(spark, sf):
    words = spark.createDataFrame([("lang", "fr", "français"), ("lang", "de", "deutsch"), ("other", "en", "english")], "field string, canonical string, modified string")
    return fields.remap(t(spark, sf, "documents").select("doc_id", F.lit("lang").alias("field"), F.col("lang").alias("value")), words).select("doc_id", "value")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)) WHERE r = 1")
def jn10_outside_the_sample(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return corpus.one_shot(d, d.where("lang = 'en'"), "doc_id", "n_chars").select("doc_id")


@query(_SCORED + f" SELECT {_COUNTS} FROM c")
def agg07_subset_stats(spark, sf):
    return scoring.subset_stats(_scored(spark, sf))


# Votes and label lists over events: arrays, empty ones, a text where a list should be, nulls.
_LABELS = """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '"text"' WHEN event_id % 5 = 0 THEN '[]' ELSE '["x' || (event_id % 3) || '","' || event_type || '","' || event_type || '"]' END"""


def _label_cells(spark: SparkSession, sf: str) -> DataFrame:
    value = F.expr(_LABELS)
    return t(spark, sf, "events").select(F.col("user_id").cast("string").alias("contract_name"), F.col("event_id").alias("chunk_id"), F.lit("labels").alias("field"), value.alias("value_json"))


_UNION = f"""u AS (SELECT user_id, CASE WHEN count(x) > 0 THEN '["' || string_agg(DISTINCT x, '","' ORDER BY x) || '"]' END AS labels
    FROM (SELECT user_id, unnest(CASE WHEN v LIKE '[%' AND v <> '[]' THEN string_split(replace(replace(replace(v, '["', ''), '"]', ''), '","', '|'), '|') ELSE [NULL] END) AS x FROM (SELECT user_id, {_LABELS} AS v FROM events)) GROUP BY user_id)"""


@query(f"WITH {_UNION} SELECT user_id::VARCHAR AS doc, labels FROM u")
def agg04_union_of_lists(spark, sf):
    """Lists of several labels, empty lists, texts where a list should be, nulls."""
    return merge.union_labels(_label_cells(spark, sf), ["contract_name"]).select(F.col("contract_name").alias("doc"), F.to_json("labels").alias("labels"))


@query(
    f"""WITH {_UNION}, e AS (SELECT user_id, event_id, CASE WHEN event_id % 6 <> 0 AND user_id % 13 <> 0 THEN event_type END AS v FROM events),
         n AS (SELECT user_id, v, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM n),
         s AS (SELECT user_id, count(*) AS tops, any_value(v) AS top FROM m WHERE n = m GROUP BY user_id)
    SELECT user_id::VARCHAR AS doc, 'type' AS field, CASE WHEN tops = 1 THEN top END AS value FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)
    UNION ALL SELECT user_id::VARCHAR, 'labels', labels FROM u"""
)
def agg05_merge_documents(spark, sf):
    """A voted field (some documents have nothing but nulls, which stay null) and a multilabel one, by their kind."""
    votes = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("contract_name"), F.col("event_id").alias("chunk_id"), F.lit("type").alias("field"), F.expr("CASE WHEN event_id % 6 <> 0 AND user_id % 13 <> 0 THEN event_type END").alias("value_json"))
    dim = spark.createDataFrame([(0, "type", "single_choice", False, []), (1, "labels", "multilabel", True, [])], fields.FIELDS)
    merged, _ = merge.merge_documents(votes.union(_label_cells(spark, sf)), dim)
    return merged.select(F.col("contract_name").alias("doc"), "field", F.col("value_json").alias("value"))


@query("WITH n AS (SELECT user_id, event_id % 7 AS f, count(DISTINCT event_type) AS k FROM events GROUP BY ALL), p AS (SELECT user_id, count(*) FILTER (k > 1) AS n FROM n GROUP BY user_id) SELECT sum(n)::BIGINT AS conflicts, avg(n) AS mean, max(n) AS most FROM p")
def agg22_conflict_totals(spark, sf):
    cells = t(spark, sf, "events").select("user_id", (F.col("event_id") % 7).cast("string").alias("field"), F.col("event_id").alias("chunk_id"), F.col("event_type").alias("value_json"))
    votes = merge.vote(cells, ["user_id", "field"])
    return merge.conflict_summary(cells.select("user_id"), votes.where("mode IS NOT NULL"), "user_id").select("conflicts", "mean", "most")


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels FROM events GROUP BY user_id")
def srt06_labels_in_order(spark, sf):
    cells = t(spark, sf, "events").select("user_id", F.to_json(F.array("event_type")).alias("value_json"))
    return merge.union_labels(cells, ["user_id"]).select("user_id", F.array_join("labels", "|").alias("labels"))


@query(f"WITH {_UNION} SELECT user_id, coalesce(length(labels) - length(replace(labels, ',', '')) + 1, 0)::INTEGER AS n FROM u")
def set03_union_size(spark, sf):
    return merge.union_labels(_label_cells(spark, sf), ["contract_name"]).select(F.col("contract_name").cast("long").alias("user_id"), F.coalesce(F.size(F.col("labels")), F.lit(0)).alias("n"))


_TAGS = {
    "p": """CASE doc_id % 5 WHEN 1 THEN '["' || lang || '","' || source || '","' || lang || '"]' WHEN 2 THEN '"' || lang || '"' WHEN 3 THEN '["' || source || '","' || lang || '"]' WHEN 4 THEN '["' || lang || '"]' END""",
    "g": """CASE WHEN doc_id % 7 <> 0 THEN '["' || lang || '","' || source || '"]' END""",
}
_TAGGED = "WITH r AS (SELECT doc_id, {p} AS p, {g} AS g, doc_id % 5 IN ({same}) AS same FROM documents) SELECT doc_id, CASE WHEN p IS NULL AND g IS NULL THEN 'correct_abstain' WHEN g IS NULL THEN 'hallucination' WHEN p IS NULL THEN 'over_abstain' WHEN same THEN 'correct_value' ELSE 'wrong_value' END AS outcome FROM r"


def _tags(spark: SparkSession, sf: str, side: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.lit("tags").alias("field"), F.expr(_TAGS[side]).alias("value_json"))


@query(_TAGGED.format(**_TAGS, same="1, 3"))
def cls01_multilabel_outcome(spark, sf):
    """Lists are equal as sets; a text where a list should be is wrong."""
    dim = spark.createDataFrame([(0, "tags", "multilabel", True, [])], fields.FIELDS)
    return scoring.score_cells(_tags(spark, sf, "p"), _tags(spark, sf, "g"), dim, "doc_id").select("doc_id", "outcome")


@query(_TAGGED.format(**_TAGS, same="3"))
def set05_lists_by_duplicates(spark, sf):
    """The kind-blind rule: lists are equal as sorted lists, so a label twice is not the same."""
    p, g = _tags(spark, sf, "p"), _tags(spark, sf, "g")
    return compare.paired_cells(p, p, g, "doc_id").select("doc_id", F.col("o1").alias("outcome"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang = 'fr', false) END AS is_substituted FROM documents")
def cls05_substituted_gold(spark, sf):
    cells = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "lang").otherwise("other").alias("field"), F.to_json(F.struct(F.col("lang").alias("v"))).alias("j"))
    cells = cells.select("doc_id", "field", F.regexp_extract("j", r'^\{"v":(.*)\}$', 1).alias("gold_json"))
    words = spark.createDataFrame([("lang", "fr", "français")], "field string, canonical string, modified string")
    return scoring.with_overlays(cells, spark.createDataFrame([], "field string"), words).select("doc_id", "is_substituted")


@query("SELECT doc_id, lang = 'en' OR lang = 'fr' AS usable FROM documents")
def smp03_usable_sample(spark, sf):
    """Both parts of a sample that holds all documents: those that are usable and those that are not."""
    d = t(spark, sf, "documents").select("doc_id", "lang")
    usable, excluded = corpus.evaluation_sample(d.select("doc_id"), d.where("lang IN ('en', 'fr')"), "doc_id")
    return usable.withColumn("usable", F.lit(True)).union(excluded.withColumn("usable", F.lit(False)))


@query(
    "WITH s AS (SELECT DISTINCT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '42'), doc_id LIMIT 200) SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS usable FROM s"
)
def jn06_sample_usable(spark, sf):
    """A seeded sample of all documents: its usable names and those that are not, which are reported."""
    sample = corpus.hash_sample(t(spark, sf, "documents"), "doc_id", 200)
    usable, excluded = corpus.evaluation_sample(sample, t(spark, sf, "labels").where("quality = 1"), "doc_id")
    return usable.withColumn("usable", F.lit(True)).union(excluded.withColumn("usable", F.lit(False)))


_ROLES = "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN 'odd' ELSE role END"


@query(f"WITH r AS (SELECT conv_id, turn, role, {_ROLES} AS p, CASE WHEN turn % 4 <> 3 THEN role END AS g FROM conversations WHERE role <> 'system') SELECT role AS field, {_OUTCOME.format(p='p', g='g')} AS outcome, count(*) AS n FROM r GROUP BY ALL")
def doc09_compare_by_id(spark, sf):
    """Answers matched to gold by id, one role left out."""
    turns = t(spark, sf, "conversations").where("role <> 'system'")
    side = lambda x: turns.select("conv_id", "turn", F.col("role").alias("field"), F.expr(x).alias("value_json"))
    dim = spark.createDataFrame([(0, "user", "single_choice", False, []), (1, "assistant", "single_choice", False, [])], fields.FIELDS)
    return scoring.score_cells(side(_ROLES), side("CASE WHEN turn % 4 <> 3 THEN role END"), dim, "conv_id", "turn").groupBy("field", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- dictionaries and schemas

_WORDS = [("priority", "1-URGENT", "urgent"), ("priority", "5-LOW", "low"), ("status", "F", "filled")]


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WORDS, "field string, canonical string, modified string")


@query("SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus || '|-' AS value FROM orders")
def dic03_inverse_of_lists(spark, sf):
    """Lists of modified, canonical, foreign and null values go back to the canonical form; unknown values and nulls stay."""
    seen = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise(F.col("o_orderpriority"))
    cells = t(spark, sf, "orders").select("o_orderkey", F.lit("priority").alias("field"), F.array(seen, F.col("o_orderstatus"), F.lit(None)).alias("value"))
    return fields.remap(cells, _words(spark), to="canonical", frm="modified").select("o_orderkey", F.array_join("value", "|", "-").alias("value"))


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW' AS changed, o_orderpriority AS back FROM orders")
def dic04_inverse_remap(spark, sf):
    """There and back: what the dictionary holds differs in between."""
    cells = t(spark, sf, "orders").select("o_orderkey", F.lit("priority").alias("field"), F.col("o_orderpriority").alias("was"), F.col("o_orderpriority").alias("value"))
    there = fields.remap(cells, _words(spark)).withColumn("changed", F.col("was") != F.col("value"))
    return fields.remap(there, _words(spark), to="canonical", frm="modified").select("o_orderkey", "changed", F.col("value").alias("back"))


@query(
    """WITH e AS (SELECT user_id, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'say "error"' ELSE event_type END AS v FROM events), c AS (SELECT user_id, CASE v WHEN 'say "error"' THEN 'say "error"' ELSE v END AS v FROM e),
         n AS (SELECT user_id, CASE WHEN v = 'error' THEN 'say "error"' ELSE v END AS v, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM n)
    SELECT user_id::VARCHAR AS contract_name, CASE WHEN count(*) = 1 THEN any_value('"' || replace(v, '"', chr(92) || '"') || '"') END AS value_json FROM m WHERE n = m GROUP BY user_id"""
)
def dic04_merge_and_remap(spark, sf):
    """JSON strings go back to the canonical form before the vote, so that two spellings of one answer do not compete."""
    answer = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), 'say "error"').otherwise(F.col("event_type"))
    preds = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("contract_name"), F.col("event_id").alias("chunk_id"), F.to_json(F.struct(answer.alias("kind"))).alias("prediction"))
    words = spark.createDataFrame([("kind", 'say "error"', "error")], "field string, canonical string, modified string")
    golds = preds.select("contract_name", "chunk_id", F.lit("{}").alias("gold"))
    dim = spark.createDataFrame([(0, "kind", "single_choice", False, [])], fields.FIELDS)
    return lifecycle.merge_and_score(preds, golds, dim, words)["merged"].select("contract_name", "value_json")


@query("SELECT p_brand AS field, string_agg(DISTINCT p_name || ' \"' || p_size || '\"', '|' ORDER BY p_name || ' \"' || p_size || '\"') AS affected FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def dic06_affected_values(spark, sf):
    """The set of canonical values with a double quote, by field."""
    label = F.expr("CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' \"', p_size, '\"') ELSE p_name END")
    dim = t(spark, sf, "part").select(F.col("p_brand").alias("field"), F.array(label, "p_type").alias("labels"))
    return fields.quote_dictionary(dim).groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("affected"))


_REWRITTEN = {
    "$schema": "s", "$id": "i", "x-note": 1, "title": "t", "type": "object", "additionalProperties": False,
    "properties": {"title": {"type": ["string", "null"], "enum": ["a", None], "description": "d"}, "x-own": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"type": "string", "pattern": "p", "deprecated": True}}},
    "patternProperties": {"default": {"type": ["null", "integer"], "minimum": 0, "$comment": "c", "readOnly": True}},
}
#: What is left, as canonical JSON.
_LEFT = {
    "dic07_without_validation": '{"additionalProperties":false,"patternProperties":{"default":{"readOnly":true,"type":["null","integer"]}},"properties":{"title":{"description":"d","enum":["a",null],"type":["string","null"]}},"title":"t","type":"object"}',
    "dic08_without_annotations": '{"$id":"i","additionalProperties":false,"patternProperties":{"default":{"$comment":"c","minimum":0,"readOnly":true,"type":["null","integer"]}},"properties":{"title":{"description":"d","enum":["a",null],"type":["string","null"]}},"title":"t","type":"object"}',
    "dic09_for_grammar": '{"additionalProperties":false,"patternProperties":{"default":{"anyOf":[{"type":"null"},{"minimum":0,"type":"integer"}]}},"properties":{"title":{"anyOf":[{"type":"null"},{"enum":["a",null],"type":"string"}]},"x-own":{"items":{"pattern":"p","type":"string"},"minItems":1,"type":"array"}},"type":"object"}',
}


def _schema_query(name: str, rewrite):
    def f(spark, sf):
        return spark.createDataFrame([(json.dumps(rewrite(_REWRITTEN), sort_keys=True, separators=(",", ":")),)], "schema string")

    f.__name__ = name
    query(f"SELECT '{_LEFT[name]}' AS schema")(f)


_schema_query("dic07_without_validation", fields.strip_validation)
_schema_query("dic08_without_annotations", fields.strip_annotations)
_schema_query("dic09_for_grammar", fields.for_grammar)


# A schema for each part: its brand and type as choices, its size as a label.
_SCHEMA_TEXT = """'{"$schema":"d","title":"T","type":"object","x-own":1,"properties":{"contract_name":{"type":"string"},"brand":{"type":["string","null"],"enum":["' || p_brand || '","' || p_type || '",null],"description":"q"},"size":{"type":["array","null"],"items":{"type":"string","enum":["s' || p_size || '"]},"uniqueItems":true,"minItems":1},"loose":{"type":["array","null"],"items":{"enum":[1,"z"]}},"note":{"type":["string","null"],"pattern":"p"}}}'"""


def _schemas(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.expr(_SCHEMA_TEXT).alias("schema"))


@query("SELECT p_partkey, f.* FROM part, LATERAL (VALUES (0, 'contract_name', 'meta', false, ''), (1, 'brand', 'single_choice', false, p_brand || '|' || p_type), (2, 'size', 'multilabel', true, 's' || p_size), (3, 'loose', 'multilabel', false, 'z'), (4, 'note', 'freetext', false, '')) AS f(ordinal, field, kind, is_multilabel, labels)")
def src12_fields_of_schemas(spark, sf):
    """The fields of every part's schema with both rules for kinds (CLS03, CLS04), as column expressions."""
    return fields.schema_fields(_schemas(spark, sf)).withColumn("labels", F.array_join("labels", "|"))


_ENUM = """["' || p_brand || '","' || p_type || '",null]"""
_LABEL = """["s' || p_size || '"]"""


@query(f"""SELECT p_partkey, '{{"properties":{{"brand":{{"description":"q","enum":{_ENUM},"type":["string","null"]}},"contract_name":{{"type":"string"}},"loose":{{"items":{{"enum":[1,"z"]}},"type":["array","null"]}},"note":{{"type":["string","null"]}},"size":{{"items":{{"enum":{_LABEL},"type":"string"}},"type":["array","null"]}}}},"title":"T","type":"object"}}' AS schema FROM part""")
def dic07_schemas_without_validation(spark, sf):
    return fields.rewritten(_schemas(spark, sf), fields.strip_validation)


@query(f"""SELECT p_partkey, '{{"properties":{{"brand":{{"description":"q","enum":{_ENUM},"type":["string","null"]}},"contract_name":{{"type":"string"}},"loose":{{"items":{{"enum":[1,"z"]}},"type":["array","null"]}},"note":{{"pattern":"p","type":["string","null"]}},"size":{{"items":{{"enum":{_LABEL},"type":"string"}},"minItems":1,"type":["array","null"]}}}},"title":"T","type":"object"}}' AS schema FROM part""")
def dic08_schemas_without_annotations(spark, sf):
    return fields.rewritten(_schemas(spark, sf), fields.strip_annotations)


@query(f"""SELECT p_partkey, '{{"properties":{{"brand":{{"anyOf":[{{"type":"null"}},{{"enum":{_ENUM},"type":"string"}}]}},"contract_name":{{"type":"string"}},"loose":{{"anyOf":[{{"type":"null"}},{{"items":{{"enum":[1,"z"]}},"type":"array"}}]}},"note":{{"anyOf":[{{"type":"null"}},{{"pattern":"p","type":"string"}}]}},"size":{{"anyOf":[{{"type":"null"}},{{"items":{{"enum":{_LABEL},"type":"string"}},"minItems":1,"type":"array"}}]}}}},"type":"object"}}' AS schema FROM part""")
def dic09_schemas_for_grammar(spark, sf):
    return fields.rewritten(_schemas(spark, sf), fields.for_grammar)


# ---------------------------------------------------------------- extraction


def _measure(spark: SparkSession, sf: str, client) -> DataFrame:
    c = chunking.fixed_chunks(t(spark, sf, "documents"), target=4000, overlap=200)
    return extract.extract(c.select(F.col("doc_id").cast("string").alias("contract_name"), "chunk_id", F.col("text").alias("input")), client, "measure", pause=0)


@query(_FIXED + """ SELECT doc_id::VARCHAR AS contract_name, chunk_id, CASE WHEN (e - s) % 3 <> 0 THEN '{"length": ' || (e - s) || '}' END AS prediction, CASE WHEN (e - s) % 3 = 0 THEN 'torn' END AS raw, CASE WHEN (e - s) % 3 = 0 THEN 3 ELSE 1 END::INTEGER AS attempts, (e - s) // 4 AS input_tokens, 5::BIGINT AS output_tokens, (e - s) % 3 = 0 AS failed FROM c""")
def ext01_extraction(spark, sf):
    """Every chunk through a deterministic stand-in for a model, some of whose answers never parse (EXT05: their raw text is kept)."""

    def client():
        return lambda system, user: ("torn" if len(user) % 3 == 0 else json.dumps({"length": len(user)}), {"input_tokens": len(user) // 4, "output_tokens": 5})

    done = _measure(spark, sf, client)
    return done.select("contract_name", "chunk_id", "prediction", "raw", "attempts", "input_tokens", "output_tokens", F.col("error").isNotNull().alias("failed"))


_PIECES = ("", "{", '"a"', ":", " ", '"', "}")


def _blank_lover() -> Callable[[dict], str]:
    """A decoder for an object with one text of a given length, whose scores always prefer blanks."""
    blank, scores = frozenset({4}), {4: 9.0, 5: 1.0}

    def decode(row: dict) -> str:
        def allowed(out: list[int]) -> list[int]:
            text = "".join(_PIECES[i] for i in out)
            if len(out) < 3:
                return [len(out) + 1]
            if text.count('"') == 2:
                return [4, 5]
            if text.count('"') == 3:
                return [4, 5] if len(text) - text.rindex('"') - 1 < row["n"] else [5]
            return [0] if text.endswith("}") else [6]

        return "".join(_PIECES[i] for i in extract.constrained_decode(lambda out: scores, allowed, 0, surface=_PIECES.__getitem__, blanks=blank))

    return decode


@query("SELECT c_custkey, c_nationkey % 9 AS n, '{\"a\":' || '  ' || '\"' || repeat(' ', (c_nationkey % 9)::INTEGER) || '\"}' AS answer FROM customer")
def ext02_constrained_decode(spark, sf):
    """Greedy decoding in the tasks, with scores that prefer blanks: between tokens two of them are the most, inside a string there is no cap."""
    rows = t(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 9).alias("n"))
    return extract.decoded(rows, ["c_custkey", "n"], _blank_lover)


@query("""SELECT event_id, event_id % 3 = 1 AS in_string, event_id % 3 = 2 AND event_id % 2 = 0 AS escaped, CASE WHEN event_id % 3 = 0 THEN (event_id % 4)::INTEGER ELSE 0 END AS blank_run FROM events WHERE event_id % 3 <> 2
    UNION ALL SELECT event_id, true, event_id % 2 = 0, 0 FROM events WHERE event_id % 3 = 2""")
def ext03_json_structure(spark, sf):
    """Closed objects with blanks behind, open strings, open strings that end in one or two backslashes."""
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN concat(props, repeat(' ', cast(event_id % 4 AS int))) WHEN 1 THEN concat('{"a": "', event_type, '  ') ELSE concat('{"a": "', event_type, CASE WHEN event_id % 2 = 0 THEN '\\\\' ELSE '\\\\\\\\' END) END""")
    return t(spark, sf, "events").select("event_id", scalars.json_structure(text).alias("s")).select("event_id", "s.in_string", "s.escaped", "s.blank_run")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def ext04_blank_tokens(spark, sf):
    """Ids of the tokens that are white space only, in a vocabulary made of the parts' names."""
    token = F.expr("CASE WHEN p_partkey % 3 = 0 THEN repeat(' ', CAST(p_partkey % 50 + 1 AS INT)) ELSE concat(p_name, ' ', p_partkey) END")
    return extract.blank_tokens(t(spark, sf, "part").select(token.alias("token"), F.col("p_partkey").alias("id")))


@query("SELECT event_id, event_id % 3 <> 0 AS parsed, CASE WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) END AS raw FROM events")
def ext05_raw_if_unparsed(spark, sf):
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) ELSE props END").alias("raw")
    return t(spark, sf, "events").select("event_id", text).select("event_id", cells_.parse_or_null("raw").isNotNull().alias("parsed"), cells_.raw_if_unparsed("raw").alias("raw"))


@query("SELECT event_id, event_id % 3 <> 0 AS parsed, CASE WHEN event_id % 3 <> 0 THEN regexp_extract(props, '[0-9]+', 0) END AS k FROM events")
def prj08_unwrapped(spark, sf):
    """Records under a wrapper, flat ones, and ones that do not parse."""
    e = t(spark, sf, "events").select("event_id", F.expr("""CASE event_id % 3 WHEN 0 THEN '{"prediction":' WHEN 1 THEN concat('{"prediction":', props, '}') ELSE props END""").alias("r"))
    return e.select("event_id", cells_.parse_or_null("r").isNotNull().alias("parsed"), F.get_json_object(cells_.unwrapped("r", "prediction"), "$.k").alias("k"))


# ---------------------------------------------------------------- grounding, over every turn and whole lines

_LINES = "(SELECT conv_id, turn, role, text, CASE WHEN conv_id % 3 = 0 THEN upper(l) ELSE l END AS span FROM (SELECT conv_id, turn, role, text, trim(unnest(string_split(text, '. '))) AS l FROM conversations)) WHERE span <> ''"


def _line_spans(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Each sentence of each turn as evidence, glued by ``<omitted>``; those of every third conversation are not verbatim."""
    glued = F.array_join(F.transform(F.split("text", "\\. "), lambda x: F.when(F.col("conv_id") % 3 == 0, F.upper(x)).otherwise(x)), "<omitted>")
    return grounding.spans_of(turns.withColumn("evidence", glued), keys)


@query(f"SELECT count(*) AS spans, count(*) FILTER (contains(text, span)) AS verbatim, count(*) FILTER (contains(text, span))::DOUBLE / count(*) AS grounding_rate FROM {_LINES}")
def doc04_grounding_rate(spark, sf):
    """Evidence of every turn, each of its sentences a span; some of it is not verbatim."""
    turns = t(spark, sf, "conversations")
    return grounding.grounding_rate(_line_spans(turns, ["conv_id", "turn"]), turns, ["conv_id", "turn"])


# ---------------------------------------------------------------- scalar functions by category


@query("SELECT doc_id, string_agg(trim(x), '|' ORDER BY i) FILTER (trim(x) <> '') AS spans FROM (SELECT doc_id, unnest(string_split(lang || ' <omitted> ' || source || '<omitted><omitted> ' || lang, '<omitted>')) AS x, unnest(range(4)) AS i FROM documents) GROUP BY doc_id")
def fn_omitted_split(spark, sf):
    glued = F.concat("lang", F.lit(" <omitted> "), "source", F.lit("<omitted><omitted> "), "lang")
    return t(spark, sf, "documents").select("doc_id", F.array_join(scalars.split_evidence(glued), "|").alias("spans"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UINTEGER % 16 AS bucket, sha256(lang) AS digest FROM documents")
def fn_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", scalars.hash_bucket("doc_id", 16).alias("bucket"), F.sha2("lang", 256).alias("digest"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"b\":[1,\"' || event_type || '\"]}' AS canonical FROM events")
def fn_json_canonical(spark, sf):
    """Parsed and written again: keys in order, no white space."""
    text = F.expr("""concat('{ "b": [1, "', event_type, '"],  "a": ', event_id, ' }')""")
    return t(spark, sf, "events").select("event_id", F.to_json(cells_.parse_or_null(text)).alias("canonical"))
