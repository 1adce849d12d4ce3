"""The text queries that SQL can express against DuckDB, on the given tables and on odd rows."""

from collections import Counter

import duckdb
import pytest

from heronq.llm.queries import oracle_sql, queries
from tests.llm.cases import ODD_TEXTS, odd_documents

TABLES = ("documents", "embeddings", "pages")
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.3], [1.0, 0.9], [-1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0]]
    pages = [None, "", "a", "b", "a", "", "é" * 3000, "é" * 3000, "WARC/1.0\r\n\r\n", None]
    texts = [*ODD_TEXTS, *["Wording wordings, wordin×g’wording ÀPROPOS àpropos WORDING word\x01ing <S> <P"] * 4, "wording " * 40]
    odd_documents(spark, texts).coalesce(1).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i * 2, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{where}/embeddings.parquet")
    spark.createDataFrame([(i * 5, f"http://a/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{where}/pages.parquet")
    return str(where)


def agree(spark, where, files, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet{files}'")
    got, want = queries()[name](spark, where), con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert dict(got.dtypes) == {c: KINDS[str(k)] for c, k in zip(want.columns, want.types)}
    at = [want.columns.index(c) for c in columns]
    rows, expected = Counter(tuple(r[c] for c in columns) for r in got.collect()), Counter(tuple(r[i] for i in at) for r in want.fetchall())
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])
    assert rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, sf_dir, name):
    agree(spark, sf_dir, "", name)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb_on_odd_rows(spark, odd_dir, name):
    agree(spark, odd_dir, "/*.parquet", name)
