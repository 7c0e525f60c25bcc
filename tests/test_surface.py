"""Operators of the surface, stores and samplers beside their queries."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import relational, rules, statistics, store
from tidemark.sources import shared, text


def test_places_and_pages(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    got = {r.k: r.place for r in relational.placed(df, [F.col("k").desc()]).collect()}
    assert got == {k: 101 - k for k in range(101)}
    assert relational.placed(df.where("false"), [F.col("k")]).count() == 0
    page = lambda n: [r.k for r in relational.clamped_page(df, [F.col("k")], n, 30).collect()]
    assert page(99) == list(range(90, 101)) and page(-3) == list(range(30))


def test_status_filter_ignores_unknown_values(spark):
    df = spark.createDataFrame([("F",), ("O",)], "s string")
    assert df.where(relational.one_of("s", ["x"], ["F"])).count() == 2 and df.where(relational.one_of("s", ["F", "x"], ["F"])).count() == 1


def test_balanced_and_filled(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "s string, k int")
    with pytest.raises(ValueError):
        statistics.balanced(df, "s", "k", 2, 1)
    filled = statistics.filled(df, "s", "k", 4, 1)
    assert {r.s: r["count"] for r in filled.groupBy("s").count().collect()} == {"a": 4, "b": 4}
    assert filled.where("s = 'a'").distinct().count() == 4


def test_finite_reaches_maps_and_arrays(spark):
    df = spark.sql("select array(double('NaN'), 1.0d) as a, map('x', double('Infinity'), 'y', 2.0d) as m, float('-Infinity') as f, cast(null as struct<v:double>) as s, 'text' as t")
    r = store.finite(df).first()
    assert r.a == [None, 1.0] and r.m == {"x": None, "y": 2.0} and r.f is None and r.s is None and r.t == "text"


def test_insert_new_keeps_what_is_there(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in store.insert_new(old, new, ["k"], ["v"]).collect()) == [(1, "old"), (2, "a"), (3, None)]


def test_documents_of_odd_text(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '"{\\"a\\": 2}"'), (3, "{"), (4, None), (5, "")], "k int, t string")
    assert [(r.k, r.doc.a) for r in text.documents_of(df, "t", "a int").orderBy("k").collect()] == [(1, 1), (2, 2)]


def test_names(spark):
    df = spark.createDataFrame([("220 x", "env-buf12", 993), ("a STLS", "none", 1)], "line string, name string, port int")
    rows = df.select(names.banner(F.col("line")), names.upgrade_keyword(F.col("line")), names.buffer_size(F.col("name")), names.protocol_of_port(F.col("port"))).collect()
    assert [tuple(r) for r in rows] == [("220", False, 12, "imap"), (None, True, None, None)]


def test_a_certificate_of_the_future(spark):
    when = rules.no(F.col("e")) & rules.yes(F.try_to_timestamp("n") > F.lit(rules.AS_OF).cast("timestamp"))
    df = spark.createDataFrame([(False, "2031-01-01T00:00:00Z"), (False, "2020-01-01T00:00:00+00:00"), (True, "2031-01-01T00:00:00Z"), (None, "2031-01-01T00:00:00Z"), (False, None), (False, "soon")], "e boolean, n string")
    assert [r.x for r in df.select(when.alias("x")).collect()] == [True, False, False, False, False, False]
    assert "Certificate not yet valid" in [k.name for k in rules.registry()]


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_history_orders_with_nulls_and_equal_lines(spark, tmp_path):
    import duckdb

    from tidemark.plans.catalog import ORACLE_SQL, QUERIES

    lines = [(1, 1, "2020-01-02"), (1, 2, None), (1, None, "2020-01-01"), (1, 3, "2020-01-01"), (2, 1, None), (2, None, None), (None, 1, "2020-01-01"), (None, 2, None)]
    equal = [(3, 1, "2020-01-01")] * 3 + [(3, 1, "2019-01-01")] * 2
    spark.createDataFrame(lines + equal, "l_orderkey bigint, l_linenumber int, d string").selectExpr("l_orderkey", "l_linenumber", "cast(d as timestamp) as l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(repr, map(tuple, QUERIES["history_orders"](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(map(repr, con.execute(ORACLE_SQL["history_orders"]).fetchall()))
    assert [x for x in got if x.startswith("(3")] == ["(3, 1, 1, 3)", "(3, 1, 2, 4)", "(3, 1, 3, 5)", "(3, 1, 4, 1)", "(3, 1, 5, 2)"]
