"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, release


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003)).alias("s")).first()
    return r["n"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join's sides are two shuffles and a hub can be split
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
    joined = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` are written, and read twice."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"))
    joined = down.join(least, F.col("u") == F.col("c"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    large = materialize(_large_star(edges))
    out = materialize(_small_star(large))
    release(large)
    return out


def partial_components(edges: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` after a few rounds, without waiting for the end, and the edges as they are then: nodes of one
    component may still differ, but equal labels always mean connected, and the edges connect the same nodes as before."""
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    for _ in range(rounds):
        now = _round(now)
    least = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    labels = least.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    return labels, now


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` → ``(node, component)`` for every node that has an edge; component is its smallest node.

    Each round is written to the shared folder. A hub's edges meet only in a
    ``min`` that is combined before the shuffle and written, and in a join that can be split.
    Self-loops, repeated and reversed edges are fine; an empty table gives none.
    """
    clean = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    now = materialize(clean)
    before = _stamp(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        last, now = now, _round(now)
        release(last)
        after = _stamp(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
