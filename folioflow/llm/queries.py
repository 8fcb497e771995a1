"""The queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.common import scratch
    from folioflow.llm.token_store import read_store, write_store

    folder = scratch(spark, "store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_store(spark, folder)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.tag_paths import extract

    found = extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("_row.page_id", "_row.url", "text", "n_chars")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("_row.doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.parity_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import line_crf

    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs, model, carry=["doc_id"])
    return scored.select("_row.doc_id", line_crf.held_out(F.col("_row.doc_id")).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return mixed.select("_row.doc_id", "_row.source", "block", "slot", "release", "deadline", "place")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm import decision_list

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.apply_rules(docs, rules).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return made.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.common import scratch
    from folioflow.llm.lexical_search import build_index, search

    index = build_index(table(spark, sf_dir, "documents"), scratch(spark, "index"))
    return search(index, table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_store, op2_warc_zip, op3_decontaminate, op4_tag_paths, op5_licenses, op6_token_counts, op7_parity_join, op8_line_crf, op9_mixing, op10_decision_list, op11_fill_middle, op12_packing, op13_lexical_search)
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TERMS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_BLANK = f"regexp_extract_all({_FOLD}, '[^ \\t-\\r]+')"

SQL: dict[str, str] = {
    "op2_warc_zip": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS target FROM p)
        SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM target AND target IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
        FROM q""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
             b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
             bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
             ks AS (SELECT DISTINCT k FROM bw),
             dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
             h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
             hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_parity_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
             r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             n AS (SELECT *, length(t) AS n, [('0x' || substr(h, 8 * i - 7, 8))::UINTEGER::BIGINT for i in [1, 2, 3, 4]] AS x FROM d),
             c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
             p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
             s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_terms FROM d),
             m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
             tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
             wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, n_docs),
             q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
             x AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
}
