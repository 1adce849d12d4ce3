"""Every registered relational query against DuckDB on the same tables: columns, kinds of type, rows."""

import math
from collections import Counter

import duckdb
import pytest

from heronq.plans.catalog import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "INTEGER[]": "array<int>", "VARCHAR[]": "array<string>"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf_dir, duck, name):
    agree(spark, sf_dir, duck, name)


@pytest.mark.parametrize("name", ["predicates", "range_join_by_buckets"])
def test_equals_duckdb_on_more_rows(spark, name):
    """These match nothing in the smallest tables."""
    larger = f"{DATA}/sf0.01"
    assert agree(spark, larger, connect(larger), name) > 0


def agree(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert columns == sorted(kinds)
    assert {c: k for c, k in got.dtypes} == {c: KINDS.get(k, k) for c, k in kinds.items()}
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])
    return sum(rows.values())
