"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    kind = type(value).__name__
    if "bool" in kind:
        return bool(value)
    if "float" in kind or "Decimal" in kind:
        return round(float(value), 6)
    return int(value) if "int" in kind else str(value)


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert [x.replace(".0,", ",").replace(".0)", ")") for x in rows(got)] == [x.replace(".0,", ",").replace(".0)", ")") for x in rows(want)]


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        rows = QUERIES[name](spark, sf).toPandas()
        assert len(rows), name
        if name == "risk_model_group_folds":
            assert rows.probability.between(0, 1).all() and set(rows.fold) == {0, 1, 2}
            assert rows[rows.y == 1].probability.mean() > rows[rows.y == 0].probability.mean() + 0.1
        if name == "isolation_forest":
            assert rows.score.between(0, 1).all() and rows.vec_id.is_unique
        if name == "kmeans_entropy_select":
            assert len(rows) == 25 and rows.vec_id.is_unique and rows.cluster.dropna().is_unique
