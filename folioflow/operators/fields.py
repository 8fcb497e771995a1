"""The field dimension and value dictionaries (SRC12, CLS03, CLS04, DIC01 to DIC09, FLT09, FLT12)."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "ordinal int, field string, kind string, is_multilabel boolean, labels array<string>"


def _types(prop: dict) -> list:
    t = prop.get("type", [])
    return t if isinstance(t, list) else [t]


def field_kind(prop: dict) -> str:
    """CLS03: what a property of the JSON Schema holds: one of an enum, an array of enum labels, a plain name, or free text."""
    if "enum" in prop:
        return "single_choice"
    if "array" in _types(prop) and "enum" in prop.get("items", {}):
        return "multilabel"
    return "meta" if _types(prop) == ["string"] else "freetext"


def is_multilabel(prop: dict) -> bool:
    """CLS04: does a merge take the union of this property's labels? Arrays of enum strings only."""
    items = prop.get("items", {})
    return "array" in _types(prop) and items.get("type") == "string" and "enum" in items


def load_fields(spark: SparkSession, schema: str | dict) -> DataFrame:
    """SRC12: the properties of a JSON Schema as a dimension table."""
    props = (json.loads(schema) if isinstance(schema, str) else schema)["properties"]
    rows = []
    for i, (name, p) in enumerate(props.items()):
        labels = p.get("enum") or p.get("items", {}).get("enum") or []
        rows.append((i, name, field_kind(p), is_multilabel(p), [x for x in labels if isinstance(x, str)]))
    return spark.createDataFrame(rows, FIELDS)


def schema_fields(schemas: DataFrame, schema: str = "schema") -> DataFrame:
    """SRC12, CLS03, CLS04 over a table of JSON Schemas (text): the other columns with ``ordinal, field, kind, is_multilabel, labels`` for each property, in the order of the text. Null and unparseable schemas have none."""
    others = [c for c in schemas.columns if c != schema]
    props = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    rows = schemas.select(*others, F.posexplode(props).alias("ordinal", "field", "_p"))
    items = F.get_json_object("_p", "$.items")
    has = lambda text, key: F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))
    text = F.get_json_object("_p", "$.type")
    types = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    listed = F.array_contains(types, "array")
    kind = F.when(has(F.col("_p"), "enum"), "single_choice").when(listed & has(items, "enum"), "multilabel").when(types == F.array(F.lit("string")), "meta").otherwise("freetext")
    union = F.coalesce(listed & (F.get_json_object("_p", "$.items.type") == "string") & has(items, "enum"), F.lit(False))
    enum = F.from_json(F.coalesce(F.get_json_object("_p", "$.enum"), F.get_json_object("_p", "$.items.enum"), F.lit("[]")), "array<variant>")
    labels = F.transform(F.filter(enum, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    return rows.select(*others, "ordinal", "field", kind.alias("kind"), union.alias("is_multilabel"), labels.alias("labels"))


def rewritten(schemas: DataFrame, rewrite: Callable[[dict], dict], schema: str = "schema") -> DataFrame:
    """DIC07 to DIC09 over a table of JSON Schemas: each rewritten in its row, as JSON with sorted keys; null ones stay."""
    names = schemas.columns
    place = names.index(schema)

    def run(batches):
        for b in batches:
            texts = [None if x is None else json.dumps(rewrite(json.loads(x)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns)], names=names)

    return schemas.mapInArrow(run, schemas.schema)


def quote_dictionary(fields: DataFrame) -> DataFrame:
    """DIC01, DIC06, FLT09: (field, canonical, modified) for labels with a double quote, which becomes a single one."""
    labels = fields.select("field", F.explode("labels").alias("canonical")).where(F.contains("canonical", F.lit('"')))
    return labels.select("field", "canonical", F.replace("canonical", F.lit('"'), F.lit("'")).alias("modified"))


def remap(cells: DataFrame, dictionary: DataFrame, value: str = "value", to: str = "modified", frm: str = "canonical") -> DataFrame:
    """DIC02, DIC03, DIC04, JN08: values looked up by field; nulls and unknown values stay. Swap ``to`` and ``frm`` to go back.

    ``value`` may be a string or an array of strings. The dictionary is one small
    map for each field, made before the join.
    """
    maps = dictionary.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct(frm, to))).alias("_map"))
    joined = cells.join(F.broadcast(maps), "field", "left")  # a shuffle by field would put all cells into as many tasks as there are fields
    if dict(cells.dtypes)[value].startswith("array"):
        new = F.transform(value, lambda v: F.coalesce(F.try_element_at("_map", v), v))
    else:
        new = F.coalesce(F.try_element_at("_map", F.col(value)), F.col(value))
    return joined.withColumn(value, F.when(F.col("_map").isNull(), F.col(value)).otherwise(new)).drop("_map").select(cells.columns)


def remap_json(cells: DataFrame, dictionary: DataFrame, value: str = "value_json", to: str = "canonical", frm: str = "modified") -> DataFrame:
    """DIC03, DIC04 over JSON texts: a string, or the strings of a list, looked up by field. All else stays as it is written."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    maps = dictionary.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct(frm, to))).alias("_map"), F.map_from_entries(F.collect_list(F.struct(text(frm), text(to)))).alias("_texts"))
    listed = F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>"))
    changed = F.to_json(F.transform(listed, lambda v: F.coalesce(F.try_element_at("_map", v), v)))
    new = F.when(F.exists(listed, lambda v: F.try_element_at("_map", v).isNotNull()), changed).otherwise(F.coalesce(F.try_element_at("_texts", F.col(value)), F.col(value)))
    joined = cells.join(F.broadcast(maps), "field", "left")  # a shuffle by field would put all cells into as many tasks as there are fields
    return joined.withColumn(value, F.when(F.col("_map").isNull(), F.col(value)).otherwise(new)).select(cells.columns)


# ---------------------------------------------------------------- schema rewriting, driver side

# Keywords that the stricter of the two strips drops, those that a grammar has no use for, and those that hold properties by name.
VALIDATION = frozenset("minLength maxLength pattern format minimum maximum minItems maxItems uniqueItems".split())
UNUSED = frozenset("description title $schema $id $comment examples default readOnly writeOnly deprecated uniqueItems".split())
BY_NAME = frozenset("properties patternProperties definitions $defs".split())


def _strip(node: Any, drop) -> Any:
    if isinstance(node, dict):
        return {k: _strip(v, drop) for k, v in node.items() if not drop(k)}
    return [_strip(x, drop) for x in node] if isinstance(node, list) else node


def strip_validation(schema: dict) -> dict:
    """DIC07: without ``$`` and ``x-`` keys and validation keywords, at every level (property names of these forms included)."""
    return _strip(schema, lambda k: k[:1] == "$" or k[:2] == "x-" or k in VALIDATION)


def strip_annotations(schema: dict) -> dict:
    """DIC08: without ``$schema``, ``x-`` keys and ``uniqueItems``."""
    return _strip(schema, lambda k: k in ("$schema", "uniqueItems") or k[:2] == "x-")


def for_grammar(schema: Any) -> Any:
    """DIC09: for a grammar compiler: without what does not constrain an answer, and a type that may also be null as a choice between null and the rest. Properties are never taken for keywords, whatever their names."""
    if not isinstance(schema, dict):
        return [for_grammar(x) for x in schema] if isinstance(schema, list) else schema
    out = {}
    for key, value in schema.items():
        if key in BY_NAME and isinstance(value, dict):
            out[key] = {name: for_grammar(x) for name, x in value.items()}
        elif key not in UNUSED and not key.startswith("x-"):
            out[key] = for_grammar(value)
    match out.get("type"):
        case ["null", kind] | [kind, "null"]:
            return {"anyOf": [{"type": "null"}, out | {"type": kind}]}
    return out


def array_violations(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """FLT12: array values (column ``labels_found``) with a label twice or one that the field does not admit."""
    known = cells.join(fields.where("is_multilabel").select("field", "labels"), "field")
    twice = F.size("labels_found") != F.size(F.array_distinct("labels_found"))
    foreign = F.size(F.array_except("labels_found", "labels")) > 0
    return known.where(twice | foreign).select(*cells.columns, twice.alias("repeats"), foreign.alias("unknown"))
