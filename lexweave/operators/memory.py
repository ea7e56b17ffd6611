"""Reuse of earlier results by text, and checks that a reply covers what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_texts(items: DataFrame, memory: DataFrame) -> DataFrame:
    """Distinct texts of ``items(text)`` that ``memory(source_text, target_text)`` doesn't answer (an empty answer is none)."""
    known = memory.where("target_text <> ''").select(F.col("source_text").alias("text")).distinct()
    return items.select("text").distinct().join(known, "text", "left_anti")


def winning_translations(fresh: DataFrame) -> DataFrame:
    """(source_text, target_text): of the first batch that holds a text the last of its duplicates. A minimum, combined before the shuffle."""
    first = F.min_by("translated", F.struct("batch_no", (-F.col("line_no")).alias("line_no")))
    return fresh.groupBy(F.col("text").alias("source_text")).agg(first.alias("target_text"))


def apply_memory(items: DataFrame, memory: DataFrame) -> DataFrame:
    """``items`` with ``translated`` and ``is_fallback``: the source text stands in where there is no answer."""
    known = memory.where("target_text <> ''").select(F.col("source_text").alias("text"), "target_text")
    joined = items.join(known, "text", "left")
    return joined.select(*items.columns, F.coalesce("target_text", "text").alias("translated"), F.col("target_text").isNull().alias("is_fallback"))


def id_set_report(expected: DataFrame, received: DataFrame, key: str, item: str = "item_id", text: str = "text") -> DataFrame:
    """Per ``key``: ids missing, unexpected, repeated and blank, and ``is_valid`` if there are none."""
    e = expected.select(key, item).distinct().withColumn("_e", F.lit(1))
    r = received.groupBy(key, item).agg(F.count("*").alias("_r"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("_b"))
    both = e.join(r, [key, item], "full_outer")
    out = both.groupBy(key).agg(
        F.count_if(F.col("_r").isNull()).alias("n_missing"),
        F.count_if(F.col("_e").isNull()).alias("n_unexpected"),
        F.sum(F.coalesce(F.col("_r") - 1, F.lit(0))).alias("n_repeated"),
        F.sum(F.coalesce("_b", F.lit(0))).alias("n_blank"),
    )
    return out.withColumn("is_valid", F.expr("n_missing + n_unexpected + n_repeated + n_blank = 0"))


def checkpoint_prefix(items: DataFrame, saved: DataFrame, key: str, seq: str = "seq", item: str = "item_id") -> DataFrame:
    """Per ``key``: whether the saved items are the first items, in order, without a gap."""
    s = saved.select(key, seq, F.col(item).alias("_saved"))
    joined = s.join(items.select(key, seq, item), [key, seq], "left")
    out = joined.groupBy(key).agg(F.count("*").alias("n_saved"), F.max(seq).alias("_last"), F.count_if(F.col("_saved").eqNullSafe(F.col(item))).alias("n_same"))
    return out.select(key, "n_saved", "n_same", F.expr("n_same = n_saved and _last = n_saved - 1").alias("is_prefix"))
