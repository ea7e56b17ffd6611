"""Every registered query of the library against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lexweave.operators import segment
from lexweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or not isinstance(v, int | float):
            return str(v)
        return int(v) if float(v).is_integer() else round(float(v), 6)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(df.select(columns).collect()) == plain(want.select(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pieces_that_equal_known_lines(spark, tmp_path):
    """A long line's last piece is a line that memory knows: the SQL answers whole lines only from memory."""
    name, end = "translation_plan", "A known end."
    long = "Many words stand here. " * 104 + end
    assert len(long) > 2400 and segment.cut_text(long, 2400)[-1] == end
    spark.createDataFrame([(1, long), (2, end), (3, end)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    assert plain(df.select(columns).collect()) == plain(c.sql(ORACLE_SQL[name]).select(", ".join(columns)).fetchall())


def same_on(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = plain(df.select(columns).collect())
    assert got == plain(c.sql(ORACLE_SQL[name]).select(", ".join(columns)).fetchall())
    return got


def test_colours_of_null_and_empty_texts(spark, tmp_path):
    assert len(same_on(spark, tmp_path, "cover_colours", [(1, None), (2, ""), (3, " "), (4, "a\U0001f600"), (5, "e\u0301\r\n")])) == 5


def test_fences_around_blank_texts_and_images(spark, tmp_path):
    texts = [None, "", " ", "\n \t", "\r\n", " a\n", "x ![a](b) y", "![a](b)", "x ![", "x !", "!\0[a](b) \0\0 ![\0", "```json\na\n```", "![a\n](b)\n ![q](r)"]
    assert len(same_on(spark, tmp_path, "fences_and_images", list(enumerate(texts)))) == len(texts)


def test_ids_of_documents_of_any_length(spark, tmp_path):
    lines = lambda n: "\n".join(map(str, range(n)))
    assert len(same_on(spark, tmp_path, "id_set_validation", [(10 * n + k, lines(n)) for n in (1, 2, 12, 1001, 1002, 1100) for k in range(5)])) == 30
