"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def approx_tokens(text: ColumnOrName) -> Column:
    """PRJ05: a quarter of the code points, rounded down."""
    return F.floor(F.length(_c(text)) / 4)


def chunk_header(name: ColumnOrName, index: ColumnOrName, total: ColumnOrName, text: ColumnOrName) -> Column:
    """PRJ01: the text of a chunk under a header with its document and number (from 1)."""
    return F.concat(F.lit("Contract: "), _c(name), F.lit("\nChunk "), (_c(index) + 1).cast("string"), F.lit(" of "), _c(total).cast("string"), F.lit("\n\n"), _c(text))


def preview(text: ColumnOrName, tail: int = 120, width: int = 60) -> Column:
    """PRJ13: the last line of the last ``tail`` characters, white space collapsed, cut to ``width``."""
    last = F.substring_index(F.right(_c(text), F.lit(tail)), "\n", -1)
    return F.left(F.trim(F.regexp_replace(last, "\\s+", " ")), F.lit(width))


def value_display(value: ColumnOrName, width: int = 50) -> Column:
    """PRJ14: ``null`` for null, else the first ``width`` characters."""
    return F.coalesce(F.left(_c(value).cast("string"), F.lit(width)), F.lit("null"))


def rate(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """PRJ19: part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), F.lit(0.0))


def percent_text(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """PRJ20: one decimal and a percent sign, a dash where whole is 0.

    Rounded as the exact value of the double says, ties to even, like
    ``plans.report.percent``; Java's formatter rounds its shortest digits instead.
    """
    v = 100 * _c(part).cast("double") / F.nullif(_c(whole), F.lit(0))
    # Ten times v as a double and what it lacks: 8 v and 2 v are exact, so is the error of their sum.
    s = 8 * v + 2 * v
    lack = (8 * v - (s - (s - 8 * v))) + (2 * v - (s - 8 * v))
    whole_tenths, rest = F.floor(s), s - F.floor(s)
    up = (rest > 0.5) | ((rest == 0.5) & ((lack > 0) | ((lack == 0) & (whole_tenths % 2 == 1))))
    tenths = whole_tenths + F.when(up, 1).otherwise(0)
    return F.when(_c(whole) == 0, F.lit("—")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def set_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """SET04: equal as sets, duplicates and order aside."""
    return F.array_sort(F.array_distinct(_c(a))) == F.array_sort(F.array_distinct(_c(b)))


def multiset_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """SET05: equal as sorted lists; duplicates count."""
    return F.array_sort(_c(a)) == F.array_sort(_c(b))


def order_statistics(rows: DataFrame, by: list[str], x: str, places: dict[str, float]) -> DataFrame:
    """SRT07: for each group and each (name, p) the value at place floor(n p) (from 0, at most n - 1) of the group's sorted values; null if it has none.

    Neither an interpolated nor a discrete percentile. Values are counted first
    (partially on the map side) and the counts summed up in order, so that a group
    holds its distinct values only, however many rows it has.
    """
    keys = by or ["_all"]
    counted = (rows if by else rows.withColumn("_all", F.lit(0))).groupBy(*keys, x).agg(F.count(x).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_first()))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = counted.select(*keys, F.col(x).alias("_x"), upto.alias("_upto"), total.alias("_total"))
    place = lambda p: F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1)
    found = [F.min(F.when(F.col("_upto") > place(p), F.col("_x"))).alias(name) for name, p in places.items()]
    out = ranked.groupBy(*keys).agg(*found)
    return out if by else rows.agg(F.lit(0).alias("_all")).join(out, "_all", "left").drop("_all")


def split_evidence(text: ColumnOrName) -> Column:
    """Spans of an evidence text whose pieces are glued by ``<omitted>``, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(_c(text), "<omitted>"), lambda s: F.trim(s)), lambda s: s != "")


def stage_and_variation(name: ColumnOrName) -> tuple[Column, Column]:
    """PRJ17: what stands before the first underscore of a run's name, and the rest."""
    name = _c(name)
    stage = F.substring_index(name, "_", 1)
    return stage, F.ltrim(F.substring(name, F.length(stage) + 1, F.length(name)), F.lit("_"))


def input_spec(spec: ColumnOrName) -> Column:
    """PRJ18: ``role=path`` or ``role=path:nocopy`` as a struct (role, path, copy)."""
    spec = _c(spec)
    role = F.substring_index(spec, "=", 1)
    rest = F.substring(spec, F.length(role) + 2, F.length(spec))
    copied = ~F.endswith(rest, F.lit(":nocopy"))
    return F.struct(role.alias("role"), F.when(copied, rest).otherwise(F.regexp_replace(rest, ":nocopy$", "")).alias("path"), copied.alias("copy"))


def chat_messages(system: ColumnOrName, user: ColumnOrName, example: tuple[ColumnOrName, ColumnOrName] | None = None) -> Column:
    """PRJ15: two turns, or four with one worked example between them."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), _c(text).alias("content"))
    shown = [turn("user", example[0]), turn("assistant", example[1])] if example else []
    return F.array(turn("system", system), *shown, turn("user", user))


def hash_bucket(key: ColumnOrName, buckets: int) -> Column:
    """A bucket number from the md5 of the key, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(_c(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def json_structure(text: ColumnOrName) -> Column:
    """EXT03: state of a JSON lexer at the end of a text: (in_string, escaped, run of structural white space). A fold over characters inside the JVM."""
    start = F.struct(F.lit(False).alias("in_string"), F.lit(False).alias("escaped"), F.lit(0).alias("blank_run"))

    def step(s: Column, ch: Column) -> Column:
        quote = (ch == '"') & ~s["escaped"]
        inside = F.when(quote, ~s["in_string"]).otherwise(s["in_string"])
        escaped = s["in_string"] & (ch == "\\") & ~s["escaped"]
        blank = ~s["in_string"] & ch.isin(" ", "\t", "\n", "\r")
        return F.struct(inside.alias("in_string"), escaped.alias("escaped"), F.when(blank, s["blank_run"] + 1).otherwise(0).alias("blank_run"))

    return F.aggregate(F.filter(F.split(_c(text), ""), lambda ch: ch != ""), start, step)
