"""Positions, running sums and states in a total order, without one task for all rows or for a key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize


def parted(df: DataFrame, *keys: Column, parts: int | None = None, then=None) -> DataFrame:
    """``df`` dealt by range of ``keys``, sorted, passed through ``then`` and written, with ``_part`` and ``_own`` (its place in the part).

    Keys that order all rows part a key with most of them as well.
    """
    dealt = (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    own = F.monotonically_increasing_id()
    return materialize((then(dealt) if then else dealt).withColumns({"_part": F.shiftright(own, 33), "_own": own.bitwiseAND(F.lit((1 << 33) - 1))}))


def numbered(df: DataFrame, name: str, *order: Column, within: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, from 0 in each value of ``within``.

    Rows are dealt by range and sorted within partitions; a partition's rows follow the counts of those before it. Written
    once, as ranges come from a sample. Only the counts (one row per partition) meet in one task.
    """
    keys = [F.col(within).asc_nulls_first(), *order] if within else list(order)
    placed = parted(df, *keys)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if within is None:
        return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
    # a row for each value in each part it stands in, so rows of one value join in as many tasks as it has parts
    runs = placed.groupBy("_part", F.col(within).alias("_w")).agg(F.min("_own").alias("_at")).join(F.broadcast(before), "_part")
    first = runs.groupBy(F.col("_w").alias("_v")).agg(F.min(F.col("_at") + F.col("_before")).alias("_first"))
    shift = runs.join(first, F.col("_w").eqNullSafe(F.col("_v"))).select(F.col("_part").alias("_p"), "_w", (F.col("_before") - F.col("_first")).alias("_shift"))
    out = placed.join(shift, (F.col("_part") == F.col("_p")) & F.col(within).eqNullSafe(F.col("_w")))
    return out.withColumn(name, F.col("_own") + F.col("_shift")).drop("_part", "_own", "_p", "_w", "_shift")


def running_sum(df: DataFrame, name: str, value: Column, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to each, in ``order``.

    Parts are ranges of ``order``: each sums its own rows, after the sums of the parts before it (one row for each part). Rows that
    have ``_part`` and ``_own`` of this order stand in their parts already.
    """
    placed = df.withColumn("_value", value)
    if not {"_part", "_own"} <= set(df.columns):
        placed = parted(placed, *order, parts=parts)
    sums = placed.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_own", "_before", "_value")


def composed_states(df: DataFrame, key: str, order: list[str], symbol: str, steps: list[tuple[int, ...]], parts: int | None = None, keep: bool = False) -> DataFrame:
    """``df`` with ``_was`` and ``_is``: the state of ``key`` before and after each row, from state 0 on; a row of symbol k leads from
    state s to ``steps[k][s]``, a null one leaves it. Eight states at most. With ``keep`` rows keep ``_part`` and ``_own``, their places by key and order.

    Rows are dealt by range of key and order, so a key with most of them is many parts. A part doesn't know the state it begins
    with: it composes steps to maps of all states, packed in a number of three bits for each. The parts' last maps (one row for
    each part) then tell where each begins, and a look-up in its rows' maps finishes.
    """
    n = len(steps[0])
    packed = lambda m: sum(to << 3 * i for i, to in enumerate(m))
    same = tuple(range(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        last, now, runs = object(), same, -1
        for b in batches:
            before, after, numbers = [], [], []
            for k, x in zip(b.column(key).to_pylist(), b.column(symbol).to_pylist(), strict=True):
                if k != last:
                    last, now, runs = k, same, runs + 1
                before.append(packed(now))
                if x is not None:
                    if (now, x) not in known:
                        known[now, x] = tuple(steps[x][s] for s in now)
                    now = known[now, x]
                after.append(packed(now))
                numbers.append(runs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(numbers, pa.int64())], names=[*b.schema.names, "_was", "_is", "_run"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _was int, _is int, _run long"
    placed = parted(df, F.col(key), *[F.col(c) for c in order], parts=parts, then=lambda x: x.mapInArrow(run, schema))
    ends = placed.groupBy("_part").agg(F.min_by(key, "_own").alias("first"), F.max_by(key, "_own").alias("last"), F.max("_run").alias("runs"), F.max_by("_is", "_own").alias("map"))
    state, previous, begins = 0, (), []
    for r in ends.orderBy("_part").collect():  # a row for each part
        begin = state if previous == (r["first"],) else 0
        begins.append((r["_part"], begin))
        state, previous = r["map"] >> 3 * (0 if r["runs"] else begin) & 7, (r["last"],)
    known = df.sparkSession.createDataFrame(begins, "_part long, _begin int")
    begin = F.when(F.col("_run") == 0, F.col("_begin")).otherwise(F.lit(0))
    at = lambda c: F.call_function("shiftright", F.col(c), begin * 3).bitwiseAND(F.lit(7)).alias(c)
    return placed.join(F.broadcast(known), "_part").select(*df.columns, at("_was"), at("_is"), *(["_part", "_own"] if keep else []))  # a row for each part
