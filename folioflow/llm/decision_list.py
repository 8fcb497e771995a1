"""Quality rules: a learned decision list over text statistics (operator 10, native).

The statistics and the verdict are Spark SQL expressions only. The list is
learned by sequential covering on the driver from the statistics of a bounded
sample of labelled documents (``SAMPLE``, those of lowest hash of id): each rule
is a conjunction of thresholds, grown on two thirds of the sample by information
gain and pruned on the last third; rules go on until none is precise enough.
The result is an ordered CASE expression whose default is to keep.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import quoted

#: Labelled documents that the list is learned from, at most.
SAMPLE = 8_192
#: A rule rejects only if so much of what it covers is labelled bad, in growing and in pruning.
PRECISION = 0.9

# Symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / word_chars",
    "upper_rate": "n_upper / word_chars",
    "digit_rate": "n_digits / word_chars",
    "bang_rate": "n_bangs / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "distinct_rate": "n_distinct / n_words",
}


def _count(characters: str) -> Column:
    """How many characters of a class stand in t: the length of what is left without runs of others."""
    return F.length(F.regexp_replace("t", f"[^{characters}]+", ""))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is thus made once for a row wherever the optimizer moves the expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words in 3-word windows found twice or more. A window is the chained hash of its words. Most texts repeat none;
#: the others sort theirs to find the repeated starts, each of which covers 3 words or as many as there are before the next.
_REPEATED = _let(
    "CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE cast(array() AS array<bigint>) END",
    "windows",
    "CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0 ELSE "
    + _let(
        "sort_array(transform(windows, (h, i) -> struct(h, i)))",
        "ranked",
        _let(
            "sort_array(filter(transform(ranked, (s, k) -> CASE WHEN (k > 0 AND ranked[greatest(k - 1, 0)].h = s.h) OR (k < size(ranked) - 1 AND ranked[least(k + 1, size(ranked) - 1)].h = s.h) THEN s.i END), p -> p IS NOT NULL))",
            "starts",
            "aggregate(transform(starts, (p, k) -> CASE WHEN k < size(starts) - 1 THEN least(3, starts[least(k + 1, size(starts) - 1)] - p) ELSE 3 END), 0, (a, x) -> a + x)",
        ),
    )
    + " END",
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` with base statistics and the features of the list; a null text has no words."""
    row = F.struct(*[docs[quoted(c)].alias(c) for c in docs.columns]).alias("_row")
    t = docs.select(row, F.coalesce(docs[quoted(text)].cast("string"), F.lit("")).alias("t"))
    solid = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = t.select(
        "_row",
        F.expr(_let("array_remove(split(regexp_replace(t, '[\\\\t-\\\\r]', ' '), ' '), '')", "words", f"struct(size(words) AS n_words, length(array_join(words, '')) AS word_chars, size(array_distinct(words)) AS n_distinct, {_REPEATED} AS n_repeat_words)")).alias("w"),
        F.transform(F.array(solid), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))[0].alias("l"),
        F.struct(_count(re.escape(SYMBOLS)).alias("n_symbols"), _count("A-Z").alias("n_upper"), _count("0-9").alias("n_digits"), _count("!?").alias("n_bangs")).alias("c"),
    )
    flat = counted.select("_row", *[F.col(f"{g}.{x}").cast("long").alias(x) for g, names in (("w", ("n_words", "word_chars", "n_distinct", "n_repeat_words")), ("l", ("n_lines", "n_dup_lines")), ("c", ("n_symbols", "n_upper", "n_digits", "n_bangs"))) for x in names])
    ratios = [F.expr(f"coalesce(try_divide({x.split(' / ')[0]}, {x.split(' / ')[1]}), 0D)").alias(k) for k, x in FEATURES.items()]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *ratios, failed.alias("base_failed"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.at_least

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold


Rule = tuple[Condition, ...]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: list[dict]) -> Condition | None:
    """The threshold with the most information gain over the rows."""
    p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
    best, chosen = 1e-9, None
    for f in FEATURES:
        ordered = sorted(rows, key=lambda r: r[f])
        p = n = 0
        for before, r in zip(ordered, ordered[1:]):
            p, n = p + before["bad"], n + (not before["bad"])
            if before[f] < r[f]:
                middle = (before[f] + r[f]) / 2
                for at_least, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                    if gain > best and before[f] < middle <= r[f]:
                        best, chosen = gain, Condition(f, at_least, middle)
    return chosen


def _worth(rule: Rule, rows: list[dict]) -> float:
    hit = [r for r in rows if all(c.holds(r) for c in rule)]
    p = sum(r["bad"] for r in hit)
    return (2 * p - len(hit)) / len(hit) if hit else -1.0


def learn(rows: list[dict], precision: float = PRECISION, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering: grow a conjunction, prune it from its end, keep it if precise, drop what it covers, repeat."""
    rules: list[Rule] = []
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    while any(r["bad"] for r in grow):
        rule: Rule = ()
        left = grow
        while len(rule) < most_conditions and any(not r["bad"] for r in left) and (c := _best_condition(left)):
            rule += (c,)
            left = [r for r in left if c.holds(r)]
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda x: (_worth(x, prune), -len(x)))
        hit = [r for r in grow + prune if all(c.holds(r) for c in rule)]
        if len(hit) < 5 or sum(r["bad"] for r in hit) < precision * len(hit):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents. Ids with several labels count by their lowest, ids with several texts by the one of smallest digest; null ids and labels do not count; without labels there are no rules."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", F.col(quoted(text)).alias("text")).join(F.broadcast(chosen), "doc_id")
    # An id that repeats is one document. Its rows meet as figures, on the map side first: no text is shuffled.
    found = statistics(labelled).select("_row.doc_id", F.struct(F.md5(F.col("_row.text").cast("binary")).alias("digest"), (F.col("_row.quality") == 0).alias("bad"), "base_failed", *FEATURES).alias("r"))
    rows = found.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*").drop("digest").collect()
    return learn([r.asDict() for r in sorted(rows, key=lambda r: r.doc_id) if not r.base_failed])


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered CASE: the first rule that holds rejects, the default keeps."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = out.when(holds, False)
    return out.otherwise(True)


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``_row`` with the base statistics, ``base_failed`` and ``kept``.

    Null and empty texts have no words and so fail; texts of any length are counted
    whole; repeated rows give repeated rows, an empty table an empty result; other
    columns stay inside ``_row`` whatever their names.
    """
    return statistics(docs, text).withColumn("kept", verdict(rules)).drop(*FEATURES)
