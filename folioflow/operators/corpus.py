"""Corpus selection, splits and summaries (JN01, JN05, JN06, JN10, AGG13, AGG16 to AGG18, FLT01 to FLT04, FLT11, SET02, SET06, SMP01 to SMP03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.scalars import hash_bucket
from folioflow.operators.ranks import BLOCK, drawn, global_ranks, splits


def usable(hygiene: DataFrame, flag: str = "usable_for_snippet_training") -> DataFrame:
    """FLT01."""
    return hygiene.where(F.col(flag))


def assemble(hygiene: DataFrame, targets: DataFrame, texts: DataFrame, key: str = "contract_name") -> tuple[DataFrame, DataFrame]:
    """JN01: documents that have target and text, and the names of those skipped."""
    whole = hygiene.join(targets, key).join(texts, key)
    return whole, hygiene.select(key).join(whole.select(key), key, "left_anti")


def todo(rows: DataFrame, done: DataFrame, keys: list[str], limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """JN05, SET02, FLT04: rows still to do. The limit, if any, comes before the resume join; 0 means none of the rows, None all."""
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def pick(rows: DataFrame, name: str | None = None, line: int | None = None, key: str = "contract_name", ordinal: str = "ordinal") -> DataFrame:
    """FLT02, FLT03: rows by name, or the one with an ordinal, which takes precedence."""
    if line is not None:
        return rows.where(F.col(ordinal) == line)
    return rows if name is None else rows.where(F.col(key) == name)


def exact_sample(names: DataFrame, n: int = 15, seed: int = 42) -> DataFrame:
    """SMP01: a seeded simple sample over the sorted names, the same in each run. The generator draws places, which depend on the number of names alone; names stay in their rows."""
    column = names.columns[0]
    ranked = global_ranks(names.distinct(), column)
    places = drawn(ranked.count(), n, seed)
    chosen = names.sparkSession.createDataFrame([(i,) for i in places], "rank long")
    return ranked.join(F.broadcast(chosen), "rank").select(column)  # as many rows as are sampled


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP01 at scale: the n keys of lowest hash; a top-k, so only n rows a task travel."""
    return rows.select(key).distinct().orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def exact_split(names: DataFrame, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """SMP02: name -> split by a seeded shuffle of the sorted names; the rest is test. The driver shuffles places, 9 bytes each, and names meet their place's split in a join of blocks."""
    column = names.columns[0]
    ranked = global_ranks(names.distinct(), column)
    table = splits(names.sparkSession, ranked.count(), seed, train, val)
    code = F.substr("codes", (F.col("rank") % BLOCK + 1).cast("int"), F.lit(1))
    found = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(table, "block")
    return found.select(column, F.when(code == "0", "train").when(code == "1", "val").otherwise("test").alias("split"))


def hash_split(rows: DataFrame, key: str, train: int = 8, val: int = 1, of: int = 10) -> DataFrame:
    """SMP02 at scale: by the key's hash, so all rows of a key share a split, without a shuffle."""
    b = hash_bucket(key, of)
    return rows.withColumn("split", F.when(b < train, "train").when(b < train + val, "val").otherwise("test"))


def evaluation_sample(sample: DataFrame, usable_names: DataFrame, key: str = "contract_name") -> tuple[DataFrame, DataFrame]:
    """SMP03, JN06: sampled names that are usable, and those that are not."""
    return sample.join(usable_names.select(key), key, "left_semi"), sample.join(usable_names.select(key), key, "left_anti")


def one_shot(candidates: DataFrame, sample: DataFrame, key: str = "contract_name", fill: str = "n_non_null") -> DataFrame:
    """JN10, AGG18: of the documents outside the sample the fullest, the first by name if several are."""
    return candidates.join(sample.select(key), key, "left_anti").orderBy(F.desc(fill), key).limit(1)


def split_summary(chunks: DataFrame, by: str = "split", doc: str = "contract_name", tokens: str = "input_tokens_approx", fits: int = 31_000) -> DataFrame:
    """AGG13, AGG16, FLT11: documents, chunks, median and most chunks of a document, token p50, p95 and most, percent that fit, counts of boundary kinds.

    Chunks are read once: grouping sets count them by document and by size, and
    all figures, order statistics too, come from these counts without a join.
    """
    sets = chunks.groupingSets([[by, doc], [by, tokens, "boundary_kind"]], by, doc, tokens, "boundary_kind").agg(F.count(F.lit(1)).alias("_n"), (F.grouping_id() == 3).alias("_docs"))
    value, weight = F.when(F.col("_docs"), F.col("_n")).otherwise(F.col(tokens)), F.when(F.col("_docs"), 1).otherwise(F.col("_n"))
    kinds = ("article", "section", "paragraph", "sentence", "eof", "hard")
    of_kind = [F.sum(F.when(F.col("boundary_kind") == k, F.col("_n")).otherwise(0)).alias(f"n_{k}") for k in kinds]
    counted = sets.select("*", value.alias("_x"), weight.alias("_w")).groupBy(by, "_docs", "_x").agg(F.sum("_w").alias("_w"), *of_kind)
    known = F.sum(F.when(F.col("_x").isNotNull(), F.col("_w")).otherwise(0))
    ranked = counted.withColumns({"_upto": known.over(Window.partitionBy(by, "_docs").orderBy(F.col("_x").asc_nulls_first())), "_total": known.over(Window.partitionBy(by, "_docs"))})
    docs, own = F.col("_docs"), ~F.col("_docs")

    def at(p: float, which: Column) -> Column:
        place = F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1)
        return F.min(F.when(which & (F.col("_upto") > place), F.col("_x")))

    total = F.sum(F.when(own, F.col("_w")))
    return ranked.groupBy(by).agg(
        F.sum(F.when(docs, F.col("_w"))).alias("n_documents"), F.max(F.when(docs, F.col("_x"))).alias("most_chunks"), at(0.5, docs).alias("median_chunks"), total.alias("n_chunks"), F.max(F.when(own, F.col("_x"))).alias("tokens_max"),
        (F.sum(F.when(own & (F.col("_x") < fits), F.col("_w")).otherwise(0)).cast("double") / total * 100).alias("fits_percent"), *[F.sum(F.when(own, F.col(f"n_{k}"))).alias(f"n_{k}") for k in kinds],
        at(0.5, own).alias("tokens_p50"), at(0.95, own).alias("tokens_p95"),
    )


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """SET06: the splits' rows in one table, partitioned by name when written with ``partitionBy('split')``."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
