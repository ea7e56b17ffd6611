"""Mixing sources to target weights by pivotal dependent rounding.

Sources share ``share`` times all words by weight, none more than ``most`` times its own; the excess goes to the others by
weight until none is above. Each document of a source is to be taken ``r = target / size of the source`` times: ``floor(r)``
times for sure, and once more with the fractional part as probability, held as words (the probability times the size).

1. Documents get positions in the order of source and a hash, so groups of ``GROUP`` neighbours are bounded whatever repeats.
2. In a group documents meet one after another. Of two, mass is moved at random from one to the other, so that the expected
   value of each stays and their sum in words too, until one is taken or not. All but every ninth by size (the largest first) go this way; those
   and the last that is still fractional are the group's residuals.
3. Residuals of ``FAN`` groups form the next group, and so on: a reduction tree of which each level has a seventh of the groups.
4. The residuals of a source's last group are rounded from the largest on, each to the side that brings the sum nearer to the
   target. So a source misses its target by
   about the smallest of its last residuals, and at most by half of its largest document. A source of ``GROUP`` documents or fewer has this step only.

DataFrame functions only. Random numbers are hashes of positions, so reruns agree. Texts are read once, for their sizes.

Sources are ordered by code point, null last: a null source is a source. Null and empty texts, and texts of spaces, have no words and
are taken 0 times. Null and repeated ids, and repeated rows, are documents each on their own. A long text is one
number. An empty table gives no rows. Only id, source and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, release, table
from lexweave.operators.order import numbered

GROUP = 64
FAN = 7  # times 9 residuals of a group of 64 is 63
WORD = r"[^\x20\x09-\x0D]+"


def shares(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources(source, source_size, n)`` with ``target``: what all share by weight, up to ``most`` times the own size.

    Each turn caps the sources above their bound; what is left goes to the others by weight. A turn is one sum over
    the sources, and turns end when none is above, so only totals come to the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sources, "rank", F.col("source").asc_nulls_last())
    now = materialize(ranked.select("source", "source_size", "n", F.get(cycle, F.pmod("rank", F.lit(len(weights)))).alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("bound")))
    budget = now.agg(F.sum("source_size")).first()[0] or 0
    level, above = None, F.lit(False)  # the words for a weight of 1, and which sources stay at their bound
    while True:
        t = now.agg(F.sum(F.when(above, F.col("bound"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count(F.when(above, 1)).alias("k")).first()
        if not t["w"] or (level is not None and t["k"] == capped):
            break
        capped, level = t["k"], (share * budget - (t["held"] or 0)) / t["w"]
        above = F.col("weight") * F.lit(level) > F.col("bound")
    target = F.col("bound") if level is None else F.least("bound", F.col("weight") * F.lit(level))
    return now.select("source", "source_size", "n", target.alias("target"))


_DONE = "array<struct<pos:long,doc_id:{id},size:long,x:int>>"
_ITEM = "struct<pos:long,doc_id:{id},size:long,m:double>"


def _item(e: str, m: str) -> str:
    return f"named_struct('pos', {e}.pos, 'doc_id', {e}.doc_id, 'size', {e}.size, 'm', {m})"


def _done(e: str, x: int) -> str:
    return f"array(named_struct('pos', {e}.pos, 'doc_id', {e}.doc_id, 'size', {e}.size, 'x', {x}))"


def _pivots(items: str, id_type: str, seed: int) -> Column:
    """Documents met one after another: (carry, done). ``carry`` is the one that is still fractional.

    With probability d / (u + d) the carry gains u, what it can hold or the other can give; else it loses d.
    """
    u, d = "least(a.carry.size - a.carry.m, e.m)", "least(a.carry.m, e.size - e.m)"
    chance = f"(pmod(xxhash64(a.carry.pos, e.pos, {seed}), 1048576) + 0.5D) / 1048576"
    gains = f"{chance} * ({u} + {d}) < {d}"
    step = f"""CASE WHEN a.carry IS NULL THEN named_struct('carry', e, 'done', a.done)
      WHEN {gains} THEN IF(a.carry.size - a.carry.m <= e.m,
        named_struct('carry', {_item("e", "e.m - (a.carry.size - a.carry.m)")}, 'done', concat(a.done, {_done("a.carry", 1)})),
        named_struct('carry', {_item("a.carry", "a.carry.m + e.m")}, 'done', concat(a.done, {_done("e", 0)})))
      ELSE IF(a.carry.m <= e.size - e.m,
        named_struct('carry', {_item("e", "e.m + a.carry.m")}, 'done', concat(a.done, {_done("a.carry", 0)})),
        named_struct('carry', {_item("a.carry", "a.carry.m - (e.size - e.m)")}, 'done', concat(a.done, {_done("e", 1)}))) END"""
    start = f"named_struct('carry', CAST(NULL AS {_ITEM.format(id=id_type)}), 'done', CAST(array() AS {_DONE.format(id=id_type)}))"
    return F.expr(f"aggregate({items}, {start}, (a, e) -> {step})")


def _nearest(items: str, id_type: str) -> Column:
    """Documents from the largest on, each rounded so that the sum stays near to what is due."""
    err = lambda gain: f"a.err + {gain}"
    step = f"""IF(abs({err("e.size - e.m")}) < abs({err("-e.m")}),
      named_struct('err', {err("e.size - e.m")}, 'done', concat(a.done, {_done("e", 1)})),
      named_struct('err', {err("-e.m")}, 'done', concat(a.done, {_done("e", 0)})))"""
    return F.expr(f"aggregate({items}, named_struct('err', 0D, 'done', CAST(array() AS {_DONE.format(id=id_type)})), (a, e) -> {step}, a -> a.done)")


def _level(rows: DataFrame, width: int, id_type: str, seed: int) -> DataFrame:
    """``rows(source, n, pos, doc_id, size, m)`` → the same with ``x``, null for residuals. Groups are of ``width`` places each.

    A group has ``GROUP`` rows at most: so many places, or 9 residuals of each of ``FAN`` groups.
    """
    key = F.floor(F.col("pos") / F.lit(width)).cast("long")
    groups = rows.groupBy("source", key.alias("g")).agg(F.first("n").alias("n"), F.collect_list(F.struct("pos", "doc_id", "size", "m")).alias("items"))
    largest = "transform(sort_array(transform(items, e -> named_struct('size', -e.size, 'e', e))), s -> s.e)"  # ties by position
    last = F.col("n") <= width
    met = groups.select("source", "n", F.expr(largest).alias("items")).select("*", F.when(~last, _pivots("filter(items, (e, i) -> i % 9 <> 0)", id_type, seed)).alias("p"))
    none = F.expr(f"CAST(array() AS array<{_ITEM.format(id=id_type)}>)")
    left = F.when(last, none).otherwise(F.expr("concat(filter(items, (e, i) -> i % 9 = 0), array(p.carry))"))
    done = F.when(last, _nearest("items", id_type)).otherwise(F.col("p.done"))
    row = lambda e, m, x: F.struct(e["pos"].alias("pos"), e["doc_id"].alias("doc_id"), e["size"].alias("size"), m.cast("double").alias("m"), x.cast("int").alias("x"))
    both = F.concat(F.transform(done, lambda e: row(e, F.lit(None), e["x"])), F.transform(left, lambda e: row(e, e["m"], F.lit(None))))
    return met.select("source", "n", F.inline(both))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    if not weights or min(weights) <= 0 or share < 0 or most < 0:
        raise ValueError("weights must be positive, share and most not negative")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")))
    id_type = sized.schema["doc_id"].dataType.simpleString()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    due = shares(materialize(sources), weights, share, most)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = materialize(due.select(F.col("source").alias("s"), "n", "source_size", "target", F.floor(r).alias("sure"), (r - F.floor(r)).alias("p")))
    placed = numbered(sized, "pos", F.col("source").asc_nulls_last(), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("size"))
    firsts = materialize(placed.groupBy("source").agg(F.min("pos").alias("first")).withColumnRenamed("source", "s"))
    own = due.join(firsts, due["s"].eqNullSafe(firsts["s"])).select(due["s"], "n", "p", "first")
    rows = placed.join(own, F.col("source").eqNullSafe(F.col("s"))).select("source", "n", (F.col("pos") - F.col("first")).alias("pos"), "doc_id", "size", (F.col("size") * F.col("p")).alias("m"))
    most_rows, width, levels = due.agg(F.max("n")).first()[0] or 0, GROUP, []
    while True:
        levels.append(materialize(_level(rows, width, id_type, seed + len(levels))))
        if width >= most_rows:
            break
        rows, width = levels[-1].where("x is null").drop("x"), width * FAN
    release(sized)
    done = levels[0].where("x is not null")
    for level in levels[1:]:
        done = done.unionByName(level.where("x is not null"))
    out = done.select("source", "doc_id", "size", "x").join(due, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("sure") + F.col("x"))).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
