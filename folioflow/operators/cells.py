"""Nested records as long cells and back (PRJ03, PRJ04, PRJ07 to PRJ12, PRJ16, EXT05, FLT08).

The core table is ``cells(doc, chunk_id, field, value_json)``: canonical JSON
text, null for an abstention. Fields are rows, so another field is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "contract_name"
EVIDENCE = "_evidence_spans"


def parse_or_null(text: str | Column) -> Column:
    """EXT05: a VARIANT, null where the text is not JSON."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def raw_if_unparsed(raw: str) -> Column:
    """EXT05: the text itself where it did not parse."""
    return F.when(parse_or_null(raw).isNull(), F.col(raw))


def unwrapped(record: str, wrapper: str) -> Column:
    """PRJ08: the object under ``wrapper`` or, if there is none, the record itself (JSON text)."""
    return F.coalesce(F.get_json_object(record, f"$.{wrapper}"), F.col(record))


def first_present(record: str, *names: str) -> Column:
    """PRJ07: the value of the first key that is there, null or not. Coalescing would pass over a null."""
    keys = F.json_object_keys(record)
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), F.get_json_object(record, f"$.{n}")).otherwise(out)
    return out


def row_key(name: str = KEY, chunk: str = "chunk_id", ordinal: str = "ordinal") -> Column:
    """PRJ16: name and chunk, or the row's ordinal where either is missing."""
    named = F.col(name).isNotNull() & F.col(chunk).isNotNull()
    return F.when(named, F.struct(F.col(name).alias("name"), F.col(chunk).cast("long").alias("number"))).otherwise(F.struct(F.lit("__idx__").alias("name"), F.col(ordinal).cast("long").alias("number")))


def observed(records: DataFrame, record: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    """PRJ10: a cell for each key that occurs, without the document's name and without evidence spans (PRJ12, always).

    Null, unparseable and non-object records (FLT08) give no cells.
    """
    keep = keep or [c for c in records.columns if c != record]
    view = records.select(*keep, parse_or_null(record).alias("_v"))
    exploded = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    value = F.when(~F.is_variant_null("value"), F.to_json("value"))
    return exploded.where("key IS NOT NULL").where((F.col("key") != KEY) & ~F.endswith("key", F.lit(EVIDENCE))).select(*keep, F.col("key").alias("field"), value.alias("value_json"))


def over_schema(records: DataFrame, fields: DataFrame, record: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    """PRJ09: a cell for each record and each field of the schema, null where the key is missing or null.

    The field table is a dimension of fixed size; it is exploded inside the row,
    so that records are neither shuffled nor joined.
    """
    keep = keep or [c for c in records.columns if c != record]
    names = [r.field for r in fields.select("field").orderBy("ordinal").collect()]
    # Parsed once a row; each field is read out of the variant. A name is quoted in the path.
    rows = records.select(*keep, parse_or_null(record).alias("_v"))
    path = lambda n: "$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.try_variant_get("_v", path(n), "variant").alias("v")) for n in names])
    found = rows.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.field", "e.v")
    return found.select(*keep, "field", F.when(~F.is_variant_null("v"), F.to_json("v")).alias("value_json"))


def pivot(cells: DataFrame, doc: str = KEY) -> DataFrame:
    """PRJ11: the cells of a document as one JSON record, its name first, null fields kept."""
    body = F.array_sort(F.collect_list(F.struct("field", F.coalesce("value_json", F.lit("null")).alias("v"))))
    pairs = F.transform(body, lambda e: F.concat(F.to_json(F.struct(e["field"].alias("k"))), F.lit("\x00"), e["v"]))
    entry = F.transform(pairs, lambda p: F.concat(F.regexp_replace(F.substring_index(p, "\x00", 1), r'^\{"k":|\}$', ""), F.lit(":"), F.substring_index(p, "\x00", -1)))
    name = F.regexp_replace(F.to_json(F.struct(F.col(doc).alias("k"))), r'^\{"k":|\}$', "")
    grouped = cells.groupBy(doc).agg(entry.alias("_entries"))
    return grouped.select(doc, F.concat(F.lit(f'{{"{KEY}":'), name, F.when(F.size("_entries") > 0, F.concat(F.lit(","), F.array_join("_entries", ","))).otherwise(""), F.lit("}")).alias("record"))


def filled(cells: DataFrame, keys: list[str], with_name: bool = False) -> DataFrame:
    """PRJ03, PRJ04: non-null fields of each record, its name counted or not."""
    return cells.groupBy(*keys).agg((F.count("value_json") + int(with_name)).alias("n_non_null"))


def without_evidence(cells: DataFrame) -> DataFrame:
    """PRJ12: cells but for evidence spans."""
    return cells.where(~F.endswith("field", F.lit(EVIDENCE)))
