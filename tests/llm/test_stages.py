"""Every stage of the pipeline on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, names in use."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import lexweave.llm

BODY = " ".join(f"word{k} is plain prose number {k}." for k in range(60))
LEAK = "the quick brown fox jumps over a lazy dog while nine old sailors sing quietly below deck tonight"
DOCS = [
    (1, BODY, "en", "web", 1), (2, BODY, "en", "web", 1), (2, BODY, "en", "web", 1), (3, BODY + " and a little more at the end", "en", "web", 2),
    (4, None, None, None, None), (5, "", "en", "web", 0), (6, " \n\t\n", "en", "web", 3), (None, BODY, "en", "web", 1), (None, None, None, None, None),
    (7, "long text " * 60_000, "en", "web", 9), (8, "\n".join(f"line {k} of it" for k in range(20_000)), "en", "web", 9), (9, "x" * 300_000, "en", "web", 9),
    (10, f"before it {LEAK} after it", "en", "web", 4), (11, "Ünïcode \U0001f600 words " * 30, "de", "web", 4), (12, "Ünïcode \U0001f600 words " * 30, "de", "web", 4),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def internal_names() -> list[str]:
    """Every column name that the subpackage writes down."""
    found = set()
    for path in Path(lexweave.llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'"(_?[a-z][a-z0-9_]*)"', path.read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, d % 2, 0) for d in range(1, 13)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (None, "no id"), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def key(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in rows))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_rows_and_names(spark, sf_dir, name, stage):
    docs = spark.createDataFrame(DOCS, COLUMNS)
    extra = internal_names()
    named = docs.select("*", *[F.lit(7).alias(n) for n in extra])
    plain, wide = stage(spark, docs, sf_dir), stage(spark, named, sf_dir)
    if name == "packing":
        assert plain.groupBy("doc_id").agg(F.sum("length")).count() == len({d for d, *_ in DOCS})
        assert sorted(map(tuple, plain.select("doc_id", "length").collect()), key=str) == sorted(map(tuple, wide.select("doc_id", "length").collect()), key=str)
        return
    assert plain.columns == docs.columns and wide.columns == named.columns
    rows = plain.collect()
    assert key(rows) == key(wide.collect())
    kept = [(r.doc_id, r.text) for r in rows]
    if name == "line_dedup":
        assert {d for d, _ in kept} == {d for d, *_ in DOCS} - {2, 12} and kept.count((None, BODY)) == 1
    if name == "ngram_jaccard":
        assert {d for d, _ in kept} == {d for d, *_ in DOCS} - {2, 3, 12} and kept.count((None, BODY)) == 1
    if name == "benchmark_decontamination":
        assert key(rows) == sorted((d is None, d or 0, t is None, t or "") for d, t, *_ in DOCS if d != 10)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, sf_dir, empty_dir, name, stage):
    assert stage(spark, spark.createDataFrame([], COLUMNS), sf_dir).count() == 0
    docs = spark.createDataFrame([(1, "one text of a few words", "en", "web", 1)], COLUMNS)
    assert stage(spark, docs, empty_dir).select("doc_id").distinct().count() == 1
