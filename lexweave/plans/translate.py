"""Translation of text items from extraction to recombined text, with an injected translator."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.memory import apply_memory, missing_texts
from lexweave.operators.segment import recombine, split_oversized
from lexweave.session import folder_exists, materialize, release

Translator = Callable[[list[str]], list[str]]


def mock_translator(texts: list[str]) -> list[str]:
    """Deterministic stand-in for a remote model."""
    return [f"[ES] {t}" for t in texts]


def with_bisection(translator: Translator, tries: int = 3) -> Translator:
    """A translator that asks again up to ``tries`` times, then for either half, down to single texts; an answer that leaves a text without one
    is a failure too. Exceptions named ``BudgetExceeded`` aren't tried again."""

    def ask(texts: list[str]) -> list[str]:
        error: Exception | None = None
        for _ in range(tries):
            try:
                out = translator(texts)
                if len(out) == len(texts) and all(out):
                    return out
                error = ValueError("the translator must answer every text")
            except BudgetExceeded:
                raise
            except Exception as e:  # noqa: BLE001  whatever a remote model's client raises
                error = e
        if len(texts) < 2:
            raise RuntimeError(f"no translation after {tries} tries") from error
        half = -(-len(texts) // 2)
        return ask(texts[:half]) + ask(texts[half:])

    return ask


class BudgetExceeded(RuntimeError):
    """No further request may be sent."""


def translate_texts(texts: DataFrame, translator: Translator) -> DataFrame:
    """(source_text, target_text) of ``texts(text)``, each text once, in Arrow batches. A retried task calls the translator again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = with_bisection(translator)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ask(b.column(0).to_pylist()) if b.num_rows else [], pa.string())], names=["source_text", "target_text"])

    return texts.select("text").mapInArrow(run, "source_text string, target_text string")


ROUND = "batch string, tries int, texts array<string>, answers array<string>, error string"


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    """All rounds of a ledger that stand in its folder, whole or not."""
    return spark.read.schema(ROUND).option("recursiveFileLookup", "true").parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], ROUND)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(source_text, target_text) of a ledger, each text once."""
    each = _attempts(spark, path).where("answers is not null").select(F.inline(F.arrays_zip(F.col("texts").alias("source_text"), F.col("answers").alias("target_text"))))
    return each.groupBy("source_text").agg(F.min("target_text").alias("target_text"))


def _batches(size: int):
    """(batch, tries, texts): a part's texts in batches of ``size``, named by part and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rest = TaskContext.get().partitionId(), 0, pa.array([], pa.string())
        for b in itertools.chain(batches, (None,)):
            held = rest if b is None else pa.concat_arrays([rest, b.column(0)])
            ends = [*range(0, len(held) + 1, size), *([len(held)] if b is None and len(held) % size else [])]
            rest = held.slice(ends[-1])
            if n := len(ends) - 1:
                names = pa.array([f"{part}-{made + k}" for k in range(n)])
                yield pa.RecordBatch.from_arrays([names, pa.array([0] * n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held.slice(0, ends[-1]))], names=["batch", "tries", "texts"])
                made += n

    return run


def translate_durably(texts: DataFrame, translator: Translator, path: str, *, batch: int = 20, tries: int = 3, most_tasks: int = 10_000) -> DataFrame:
    """(source_text, target_text) of the distinct ``texts(text)``, asked for in rounds over a ledger in the folder ``path``.

    A round asks once for every open batch, a task for each batch (for a few, beyond ``most_tasks``), and writes what came of it: answers,
    or what went wrong. Failed batches come again in the next round; after ``tries`` failures their halves do, down to single texts. A task's rows
    stand in the folder as soon as it ends, also if the round is then broken off, and a call on the same folder asks only for texts
    without an answer. So a lost executor or a killed driver costs the requests that were under way, and no answered text is asked for again.

    Batches are made where the distinct texts stand, so each part of theirs may end with a short one. A round's failures are read from
    its folder, where the next round leaves them if they lie in as many parts as it has tasks: then no text is shuffled again.

    An exhausted budget ends the call after its round, and so does a text that no try answers (when nothing else is open); answers stay.
    Null texts are left out; empty ones are asked for like others.
    """
    spark = texts.sparkSession
    resumed = folder_exists(spark, path)
    fresh = texts.select("text").where("text is not null").distinct()
    if resumed:
        fresh = fresh.join(answers(spark, path).select(F.col("source_text").alias("text")), "text", "left_anti")
    waiting = first = materialize(fresh.mapInArrow(_batches(batch), "batch string, tries int, texts array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                asked, out, error = b.column(2)[k].as_py(), None, None
                try:
                    out = translator(asked)
                    if len(out) != len(asked) or not all(out):
                        out, error = None, "an answer is missing"
                except BudgetExceeded:
                    error = BUDGET
                except Exception as e:  # noqa: BLE001  whatever a remote model's client raises
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([b.column(1)[k].as_py() + 1], pa.int32()), b.column(2).slice(k, 1), pa.array([out], pa.list_(pa.string())), pa.array([error], pa.string())], names=["batch", "tries", "texts", "answers", "error"])

    given_up, n = 0, waiting.count()
    spent, many = F.col("tries") >= tries, F.size("texts") > 1
    half = F.ceil(F.size("texts") / 2).cast("int")
    piece = lambda end, part: F.struct(F.concat("batch", F.lit(end)).alias("batch"), F.lit(0).alias("tries"), part.alias("texts"))
    halves = F.array(piece(".0", F.slice("texts", F.lit(1), half)), piece(".1", F.slice("texts", half + 1, F.size("texts"))))
    while n:
        at, tasks = f"{path}/{uuid.uuid4().hex}", min(n, most_tasks)
        dealt = waiting.coalesce(tasks) if waiting.rdd.getNumPartitions() >= tasks else waiting.repartition(tasks)
        # each task's file stands when it ends, not only when all have ended
        dealt.mapInArrow(run, ROUND).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(at)
        failed = spark.read.schema(ROUND).parquet(at).where("answers is null")
        counts = [F.count_if(F.col("error") == BUDGET), F.count_if(~spent), F.count_if(spent & many), F.count_if(spent & ~many)]
        broke, again, split, lost = failed.agg(*counts).first()
        if broke:
            raise BudgetExceeded("no further request may be sent; answers so far are kept")
        given_up, n = given_up + lost, again + 2 * split
        waiting = failed.select(F.inline(F.when(~spent, F.array(F.struct("batch", "tries", "texts"))).when(many, halves)))
    release(first)
    if given_up:
        raise RuntimeError(f"{given_up} texts without translation after {tries} tries each")
    if not resumed:  # the ledger holds what this call asked for
        return answers(spark, path)
    return answers(spark, path).join(texts.select(F.col("text").alias("source_text")).distinct(), "source_text", "left_semi")


BUDGET = "budget"


def translate_items(items: DataFrame, keys: list[str], memory: DataFrame, translator: Translator = mock_translator, ledger: str | None = None, known_pieces: bool = True) -> DataFrame:
    """``items(keys..., text)`` translated: long ones in pieces, known texts from memory, every other text once; with a folder for a
    ``ledger`` in rounds that can be resumed. Without ``known_pieces`` memory answers whole texts only, and a long text's pieces are all asked for."""
    pieces = split_oversized(items)
    whole = F.col("part").isNull() | F.lit(known_pieces)
    missing = missing_texts(pieces.where(whole), memory).union(pieces.where(~whole).select("text")).distinct()
    fresh = translate_durably(missing, translator, ledger) if ledger else translate_texts(missing, translator)
    known = memory.where("target_text <> ''").select(F.col("source_text").alias("text"), F.col("target_text").alias("_known"))
    done = apply_memory(pieces, fresh).join(known, "text", "left")
    return recombine(done.select(*keys, "part", F.coalesce(F.when(whole, F.col("_known")), "translated").alias("text")), keys)
