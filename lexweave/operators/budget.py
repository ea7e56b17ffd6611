"""Usage budgets: ledgers, their merge, and admission of requests under caps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.order import parted
from lexweave.session import materialize, release


def input_bound(body: Column) -> Column:
    """Upper bound of the tokens in a request: its bytes, and some for the frame."""
    return F.octet_length(body) + 256


def ledger(usage: DataFrame, *scope: str) -> DataFrame:
    """``usage(..., requests, input_bound, output_tokens)`` summed by scope; without a scope, the total."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "input_bound", "output_tokens")]
    return usage.groupBy(*scope).agg(*sums)


def merge_ledgers(a: DataFrame, b: DataFrame, key: str, counters: tuple[str, ...]) -> DataFrame:
    """The greater of every counter; a key that one side lacks counts as zero there."""
    right = b.select(key, *[F.col(c).alias(f"_{c}") for c in counters])
    both = a.select(key, *counters).join(right, key, "full_outer")
    return both.select(key, *[F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in counters])


COUNTERS = ("requests", "input_bound", "output_tokens")
#: Counters over which a reservation is held against the caps of its scopes.
SCOPES = {"job": ("deployment", "job"), "sample": ("deployment", "samples", "sample")}


def fold_admission(requests: Iterator[dict], caps: dict[str, dict[str, int]], used: dict | None = None) -> Iterator[str | None]:
    """For requests in order (kind, id and counters) the scope that refuses each, or None. A refused one uses nothing, so a later, smaller one
    may still fit. ``used`` holds what each scope has used and is updated."""
    used = {} if used is None else used
    for r in requests:
        keys = [(scope, r["id"] if scope == r["kind"] else "") for scope in SCOPES[r["kind"]]]
        over = next((k[0] for k in keys if any(used.get(k, {}).get(c, 0) + r[c] > caps[k[0]][c] for c in COUNTERS)), None)
        if over is None:
            for k in keys:
                mine = used.setdefault(k, dict.fromkeys(COUNTERS, 0))
                for c in COUNTERS:
                    mine[c] += r[c]
        yield "sample" if over == "samples" else over


_START = ("_total", "_samples", "_own_id")  # what a row's scopes have used before its part begins


def _folded(deployment: str, caps: dict[str, dict[str, int]], columns: list[str]):
    """Rows in order, with ``refused_by``; a part's deployments begin with what the rows say, or with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, {}
        for b in batches:
            has = {c: b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in (deployment, "_part", "kind", "id", *COUNTERS, *_START)}
            out = []
            for r in map(dict, (zip(has, x, strict=True) for x in zip(*has.values(), strict=True))):
                if (r["_part"], r[deployment]) != last:
                    last, used = (r["_part"], r[deployment]), {}
                for scope in SCOPES[r["kind"]]:
                    start = r["_total" if scope == "deployment" else "_samples" if scope == "samples" else "_own_id"]
                    if start is not None:
                        used.setdefault((scope, r["id"] if scope == r["kind"] else ""), dict(zip(COUNTERS, start, strict=True)))
                out.append(next(fold_admission(iter([r]), caps, used)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(out, pa.string())], names=[*columns, "refused_by"])

    return run


def _sums(rows: DataFrame, deployment: str, *keys: str) -> DataFrame:
    """What the admitted rows of each part use."""
    return rows.where("refused_by is null").groupBy(deployment, *keys, "_part").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def _before(rows: DataFrame, sums: DataFrame, deployment: str, *keys: str) -> DataFrame:
    """The sums of all earlier parts, for each part that has rows of these keys."""
    parts = rows.select(deployment, *keys, "_part").distinct().join(sums, [deployment, *keys, "_part"], "left")
    w = Window.partitionBy(deployment, *keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return parts.select(deployment, *keys, "_part", F.array(*[F.coalesce(F.sum(c).over(w), F.lit(0)) for c in COUNTERS]).alias("_used"))


def admit(requests: DataFrame, deployment: str, order: list[str], caps: dict[str, dict[str, int]], parts: int | None = None, report: list | None = None) -> DataFrame:
    """``requests(deployment, ..., kind, id, requests, input_bound, output_tokens)`` with ``refused_by``: null if admitted.

    A deployment's requests are one sequence in ``order``, as its total counts all of them. They are dealt by range of deployment and order,
    and every part is folded by itself, as if nothing had been used before. That is right for a deployment that one part holds. One
    that several parts hold is folded again, all parts side by side, from the sums that the parts before admitted, until no sum
    changes. What a part admits depends on earlier parts only, so each turn makes one more part final at least: the end is
    the sequence's own. Parts that fit whole under the caps, or that can't admit anything, are final at once, so turns follow from the
    few parts in which a cap is met. ``report`` gets the number of turns. Null deployments and ids are values like others.
    """
    columns = requests.columns
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", refused_by string"
    alone = parted(requests, F.col(deployment), *[F.col(c) for c in order], parts=parts, then=lambda df: df.mapInArrow(_folded(deployment, caps, columns), schema))
    # at most one deployment goes on from a part to the next
    wide = alone.groupBy(deployment).agg(F.min("_part").alias("a"), F.max("_part").alias("b")).where("a < b").select(F.col(deployment).alias("_wide"))
    wide = materialize(wide)
    same = F.col(deployment).eqNullSafe(F.col("_wide"))
    done = alone.join(F.broadcast(wide), same, "left_anti").select(*columns, "refused_by")
    turns = 0
    if not wide.isEmpty():
        # keys that are null have a mark of their own, so that plain joins meet them
        key = lambda c: F.to_json(F.struct(F.col(c).alias("k")))
        now = materialize(alone.join(F.broadcast(wide), same).drop("_wide").withColumns({"_d": key(deployment), "_i": key("id")}))
        at = materialize(_sums(now, "_d", "kind", "_i"))
        inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema if f.name != "refused_by") + ", refused_by string"
        names = [c for c in now.columns if c != "refused_by"]
        while True:
            turns += 1
            per = lambda which, name: _before(now.where(which), at.where(which).groupBy("_d", "_part").agg(*[F.sum(c).alias(c) for c in COUNTERS]), "_d").withColumnRenamed("_used", name)
            mine = _before(now, at, "_d", "kind", "_i").withColumnRenamed("_used", "_own_id")
            begun = now.drop("refused_by").join(F.broadcast(per("true", "_total")), ["_d", "_part"], "left").join(F.broadcast(per("kind = 'sample'", "_samples")), ["_d", "_part"], "left")  # two rows for each part at most
            begun = begun.join(mine, ["_d", "kind", "_i", "_part"]).repartition("_part").sortWithinPartitions("_part", "_own")
            after = materialize(begun.mapInArrow(_folded(deployment, caps, names), inner))
            sums = materialize(_sums(after, "_d", "kind", "_i"))
            changed = not sums.exceptAll(at).isEmpty() or not at.exceptAll(sums).isEmpty()
            release(now, at)
            now, at = after, sums
            if not changed:
                break
        done = done.unionByName(now.select(*columns, "refused_by"))
    if report is not None:
        report.append(turns)
    return done


def usage_report(usage: DataFrame) -> DataFrame:
    """``usage(id, model, requests, input_bound, output_tokens)`` as one line of JSON for each id, models in order."""
    per = usage.groupBy("id", "model").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    models = F.array_sort(F.collect_list(F.struct("model", *COUNTERS)))
    out = per.groupBy("id").agg(*[F.sum(c).alias(c) for c in COUNTERS], models.alias("models"))
    return out.select("id", F.to_json(F.struct(*COUNTERS, "models")).alias("report"))
