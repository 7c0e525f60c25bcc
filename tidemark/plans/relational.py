"""Filters, orders, pages, joins, sets and JSON paths (F, O, J, U, P, A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.plans.registry import query
from tidemark.sources.tables import read


@query("select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderstatus = 'O' and o_totalprice >= 100000 order by o_totalprice desc, o_orderkey limit 50 offset 20")
def orders_filtered_page(spark, sf):
    keep = rel.all_of(rel.equals("o_orderstatus", " O "), F.col("o_totalprice") >= 100000, rel.equals("o_orderpriority", "All"))
    order = rel.order_spec("price_desc", {"price": "o_totalprice"}, [F.col("o_orderkey")], [])
    return rel.page(read(spark, sf, "orders").where(keep).select("o_orderkey", "o_totalprice", "o_orderpriority"), order, 50, 20)


@query("select c_custkey, c_name from customer where contains(lower(c_name), '00012') or contains(lower(c_mktsegment), '00012')")
def customers_search(spark, sf):
    return read(spark, sf, "customer").where(rel.contains_any(["c_name", "c_mktsegment"], " 00012 ")).select("c_custkey", "c_name")


@query("select p_partkey, p_brand, row_number() over (order by case when regexp_matches(p_brand, '^Brand#[0-9]+$') then cast(substr(p_brand, 7) as bigint) else 999999 end desc, p_brand, p_partkey) as place from part")
def parts_numeric_suffix_order(spark, sf):
    return rel.placed(read(spark, sf, "part").select("p_partkey", "p_brand"), [rel.numeric_suffix("p_brand", "Brand#").desc(), F.col("p_brand"), F.col("p_partkey")])


@query("select * from (select o_orderkey, o_orderstatus from orders order by o_orderkey limit 100) where o_orderstatus = 'F'")
def page_then_filter(spark, sf):
    return rel.page(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [F.col("o_orderkey")], 100).where("o_orderstatus = 'F'")


@query("select o_custkey, round(sum(o_totalprice), 2) as spent, count(*) as n from orders group by 1 order by spent desc, o_custkey limit 10")
def topk_customers(spark, sf):
    spent = read(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("n"))
    return spent.orderBy(F.desc("spent"), "o_custkey").limit(10)


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) as has_run from customer")
def exists_flag(spark, sf):
    some = read(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey").distinct()
    return read(spark, sf, "customer").join(some, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_run"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join(spark, sf):
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return read(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select page_id, min(n_name) as nation from pages, (select lower(substr(n_name, 1, 2)) as code, n_name from nation) n where contains(url, '/' || n.code || '/') group by 1")
def theta_contains(spark, sf):
    codes = read(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("code"), "n_name")
    joined = read(spark, sf, "pages").select("page_id", "url").join(codes, F.expr("contains(url, concat('/', code, '/'))"))
    return joined.groupBy("page_id").agg(F.min("n_name").alias("nation"))


@query("with b as (select range as i, range * 50000.0 as low, (range + 1) * 50000.0 as high from range(0, 12)) select i, count(*) as n from orders join b on o_totalprice >= low and o_totalprice < high group by 1")
def range_join_bands(spark, sf):
    bands = spark.range(12).select(F.col("id").alias("i"), (F.col("id") * 50000.0).alias("low"), ((F.col("id") + 1) * 50000.0).alias("high"))
    return rel.banded(read(spark, sf, "orders").select("o_totalprice"), "o_totalprice", bands, "low", "high", 50000.0).groupBy("i").agg(F.count("*").alias("n"))


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'unknown') as first from events")
def json_coalesce(spark, sf):
    path = lambda p: F.get_json_object("props", p)
    return read(spark, sf, "events").select("event_id", path("$.k").alias("k"), F.coalesce(path("$.missing"), path("$.k"), F.lit("unknown")).alias("first"))


@query("select cast(json_extract_string(props, '$.k') as integer) % 10 as k, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def json_path_aggregate(spark, sf):
    v = read(spark, sf, "events").select(F.expr("try_variant_get(parse_json(props), '$.k', 'int')").alias("k"), "value")
    return v.groupBy((F.col("k") % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("select 'customer' as origin, c_nationkey as nation, count(*) as n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2")
def union_all_sources(spark, sf):
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("customer"))
    s = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("supplier"))
    return c.unionByName(s).select("origin", "nation", "n")


@query("select doc_id from documents intersect select doc_id from labels")
def intersect_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id"))


@query("select doc_id from documents except select doc_id from labels")
def except_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id").subtract(read(spark, sf, "labels").select("doc_id"))


@query("select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_tuples(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("select url_host, page_id from (select regexp_extract(url, '://([^/:?#]+)', 1) as url_host, page_id, row_number() over (partition by regexp_extract(url, '://([^/:?#]+)', 1) order by page_id) as r from pages) where r = 1")
def first_wins(spark, sf):
    hosts = read(spark, sf, "pages").select(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("url_host"), "page_id")
    return rel.first_by(hosts, ["url_host"], F.col("page_id"))


@query("select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1")
def agg_by_status(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2")
def pricing_summary(spark, sf):
    df = read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
def dimension_join(spark, sf):
    dims = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return read(spark, sf, "customer").join(dims, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select event_id, user_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) as rolling from events")
def rolling_mean(spark, sf):
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return read(spark, sf, "events").select("event_id", "user_id", F.round(F.avg("value").over(last), 6).alias("rolling"))


@query("select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as share from events group by 1, 2")
def frequency_share(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


@query("select s.s_suppkey, n.n_name, case when s.s_acctbal is null then null when isnan(s.s_acctbal) or isinf(s.s_acctbal) then null else s.s_acctbal end as balance from supplier s left join nation n on n.n_nationkey = s.s_nationkey")
def finite_or_null(spark, sf):
    b = F.col("s_acctbal")
    clean = F.when(~F.isnan(b) & (F.abs(b) < float("inf")), b)
    return read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name", clean.alias("balance"))


@query("select 'price not positive' as rule, o_orderkey as id from orders where o_totalprice <= 0 union all select 'unknown customer', o_orderkey from orders where o_custkey not in (select c_custkey from customer) union all select 'status outside vocabulary', o_orderkey from orders where o_orderstatus not in ('O', 'F', 'P')")
def violations(spark, sf):
    o = read(spark, sf, "orders")
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("o_orderkey").alias("id"))
    lost = o.join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rule(o.where("o_totalprice <= 0"), "price not positive").union(rule(lost, "unknown customer")).union(rule(o.where(~F.col("o_orderstatus").isin("O", "F", "P")), "status outside vocabulary"))
