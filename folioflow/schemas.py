"""Explicit schemas of the records that the engine reads and writes, as DDL."""

PREDICTION = "contract_name string, chunk_id int, prediction string"
GOLD = "contract_name string, chunk_id int, gold string"
RISK = "field string, category string, cardinality int, n_distinct_observed int, support int, null_count int, absence_rate double, majority_answer string, majority_count int, majority_share double, pcl_risk double"
RUN_LOG = "label string, contract_name string, chunk_id int, attempts int, duration_s double, usage struct<input_tokens:long,input_tokens_details:struct<cached_tokens:long>,output_tokens:long,output_tokens_details:struct<reasoning_tokens:long>,total_tokens:long>, error string"
