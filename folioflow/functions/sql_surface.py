"""The engine's rules as SQL: a table function and functions of the session (sections 2.18 and 2.19).

``register(spark)`` once, then flows can be written as SQL text alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioflow.operators import chunking

CHUNK_FIELDS = [T.StructField("chunk_id", T.IntegerType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("approx_tokens", T.LongType()), T.StructField("boundary_kind", T.StringType())]


def _whole(value, name: str, least: int) -> int:
    if value is None or value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


@udtf
class BoundaryChunks:
    """CHK01 as a table function: ``boundary_chunks(text, target, backoff, overlap [, with_text])``. A null or empty text has no chunks."""

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument, backoff: AnalyzeArgument, overlap: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        """The columns follow from the arguments: the chunk's text is there if the last one is a true constant."""
        if text.dataType != T.StringType():
            raise ValueError("boundary_chunks: the first argument is a text")
        for argument, name, least in ((target, "target", 1), (backoff, "backoff", 0), (overlap, "overlap", 0)):
            if argument.isConstantExpression:
                _whole(argument.value, name, least)
        texts = [T.StructField("text", T.StringType())] if with_text is not None and with_text.value else []
        return AnalyzeResult(T.StructType([*CHUNK_FIELDS, *texts]))

    def eval(self, text: str | None, target: int, backoff: int, overlap: int, with_text: bool = False):
        for i, s in enumerate(chunking.spans(text or "", target, backoff, overlap)):
            n = s.end - s.start
            row = (i, s.start, s.end, n, n // 4, s.kind)
            yield (*row, text[s.start : s.end]) if with_text else row


#: CLS01. Lists are equal as sets; a list against another shape is wrong. The order of the tests matters.
OUTCOME = """
CREATE OR REPLACE TEMPORARY FUNCTION cell_outcome(kind STRING, pred STRING, gold STRING) RETURNS STRING RETURN CASE
  WHEN pred IS NULL AND gold IS NULL THEN 'correct_abstain'
  WHEN gold IS NULL THEN 'hallucination'
  WHEN pred IS NULL THEN 'over_abstain'
  WHEN kind <> 'multilabel' AND pred = gold THEN 'correct_value'
  WHEN kind = 'multilabel' AND startswith(ltrim(pred), '[') AND startswith(ltrim(gold), '[')
    AND array_sort(array_distinct(from_json(pred, 'array<string>'))) = array_sort(array_distinct(from_json(gold, 'array<string>'))) THEN 'correct_value'
  ELSE 'wrong_value' END"""

#: AGG03 over a field's values in the order in which they were first seen, with their votes.
VOTE = """
CREATE OR REPLACE TEMPORARY FUNCTION vote_of(votes ARRAY<STRUCT<first: BIGINT, v: STRING, n: BIGINT>>)
RETURNS STRUCT<picked: STRING, mode: STRING, `values`: ARRAY<STRING>, n_votes: BIGINT> RETURN named_struct(
  'picked', CASE WHEN size(filter(votes, e -> e.n = array_max(transform(votes, x -> x.n)))) = 1 THEN filter(votes, e -> e.n = array_max(transform(votes, x -> x.n)))[0].v END,
  'mode', CASE WHEN size(votes) > 1 THEN CASE WHEN size(filter(votes, e -> e.n = array_max(transform(votes, x -> x.n)))) = 1 THEN 'majority_vote' ELSE 'tie_to_null' END END,
  'values', CASE WHEN size(votes) > 1 THEN CASE WHEN size(filter(votes, e -> e.n = array_max(transform(votes, x -> x.n)))) = 1 THEN transform(array_sort(votes), e -> e.v)
            ELSE transform(array_sort(filter(votes, e -> e.n = array_max(transform(votes, x -> x.n)))), e -> e.v) END END,
  'n_votes', aggregate(votes, 0L, (a, e) -> a + e.n))"""


def register(spark: SparkSession) -> None:
    """``boundary_chunks``, ``cell_outcome`` and ``vote_of`` in the session."""
    spark.udtf.register("boundary_chunks", BoundaryChunks)
    spark.sql(OUTCOME)
    spark.sql(VOTE)


#: A flow as text: cells of chunks (``doc``, ``field``, ``chunk_id``, ``value_json``) are voted on, and held against gold (``doc``, ``field``, ``kind``, ``gold_json``).
MERGE_AND_SCORE = """
WITH counts AS (SELECT doc, field, value_json AS v, count(value_json) AS n, min(chunk_id) AS first FROM {cells} GROUP BY doc, field, value_json),
     voted AS (SELECT doc, field, vote_of(collect_list(named_struct('first', first, 'v', v, 'n', n)) FILTER (WHERE v IS NOT NULL)) AS r FROM counts GROUP BY doc, field)
SELECT doc, field, r.picked, r.mode, array_join(r.`values`, '|') AS `values`, r.n_votes, g.gold_json, cell_outcome(g.kind, r.picked, g.gold_json) AS outcome
FROM voted JOIN {gold} AS g USING (doc, field)"""
