"""Stores, files, validators and resampling over whole tables (K, S, F20-F23, N, H)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import resampling, statistics, store
from tidemark.plans.evaluation import _SCORED, scored
from tidemark.plans.registry import query
from tidemark.sources import text
from tidemark.sources.shared import shared_dir
from tidemark.sources.tables import FLOWS, flow_attributes, read

c = F.col


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey as family_id, case when c_custkey % 3 = 0 then 'changed' else c_mktsegment end as segment, c_nationkey as nation, case when c_custkey % 3 = 0 and c_mktsegment <> 'changed' then 2 else 1 end as stamp from customer where c_custkey % 5 <> 0 union all select c_custkey, c_mktsegment, c_nationkey, 2 from customer where c_custkey % 5 = 0")
def families_written_back(spark, sf):
    """An upsert with a guard over all columns is written to the store as one table, then read again."""
    rows = read(spark, sf, "customer").select(c("c_custkey").alias("family_id"), c("c_mktsegment").alias("segment"), c("c_nationkey").alias("nation"))
    current = rows.where("family_id % 5 <> 0").withColumn("stamp", F.lit(1))
    updates = rows.withColumns({"segment": F.when(c("family_id") % 3 == 0, F.when(c("family_id") % 5 == 0, c("segment")).otherwise("changed")).otherwise(c("segment")), "stamp": F.lit(2)})
    path = _folder(spark, "families")
    store.replace_table(store.upsert(current, updates, ["family_id"], ["segment", "nation"], "stamp").drop("outcome"), path)
    return spark.read.parquet(path)


@query("with r as (select p_partkey % 50 as family_id, sha256(p_brand || p_type) as digest, p_partkey as part from part), s as (select family_id, digest, -min(part) as part from r where part % 4 = 0 group by 1, 2), n as (select family_id, digest, min(part) as part from r group by 1, 2) select family_id, digest, coalesce(s.part, n.part) as part from n left join s using (family_id, digest)")
def captures_once(spark, sf):
    """Of a family and digest what is stored stays, whatever comes; of new ones the first of equals is kept."""
    rows = read(spark, sf, "part").select((c("p_partkey") % 50).alias("family_id"), F.sha2(F.concat("p_brand", "p_type"), 256).alias("digest"), c("p_partkey").alias("part"))
    stored = rows.where("part % 4 = 0").groupBy("family_id", "digest").agg((-F.min("part")).alias("part"))
    return store.insert_new(stored, rows, ["family_id", "digest"], ["part"])


@query("select c_custkey, case when n is null then 'pending' else 'done' end as status, strftime(last_run, '%Y-%m-%d') as last_run from customer left join (select o_custkey, count(*) as n, max(o_orderdate) as last_run from orders group by 1) o on o_custkey = c_custkey")
def family_status(spark, sf):
    """Status and last run follow from a family's flows when it is read."""
    runs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_run"))
    joined = read(spark, sf, "customer").select("c_custkey").join(runs, c("c_custkey") == c("o_custkey"), "left")
    return joined.select("c_custkey", F.when(c("last_run").isNull(), "pending").otherwise("done").alias("status"), F.date_format("last_run", "yyyy-MM-dd").alias("last_run"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def refreshed_view(spark, sf):
    """A stream of changes refreshes an aggregate table, once for all changes of a batch."""
    from tidemark.streaming import flows

    return flows.refresh(flows.events(spark, sf), lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["event_type"], ["n", "total"]).select("event_type", "n", F.round(c("total") / c("n"), 6).alias("mean"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'old' when s_suppkey % 2 = 0 then 'new' else 'old' end as auc, case when s_suppkey % 2 = 0 then 'added' end as brier from supplier")
def metrics_merged(spark, sf):
    """New metrics are merged into what is there, whose entries stay."""
    s = read(spark, sf, "supplier")
    old = F.when((c("s_suppkey") % 3 == 0) | (c("s_suppkey") % 2 == 1), F.create_map(F.lit("auc"), F.lit("old"))).otherwise(F.create_map().cast("map<string,string>"))
    new = F.when(c("s_suppkey") % 2 == 0, F.create_map(F.lit("auc"), F.lit("new"), F.lit("brier"), F.lit("added"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = s.select("s_suppkey", store.keep_existing(old, new).alias("m"))
    return merged.select("s_suppkey", F.try_element_at("m", F.lit("auc")).alias("auc"), F.try_element_at("m", F.lit("brier")).alias("brier"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'old' when s_suppkey % 2 = 0 then 'new' end as auc, case when s_suppkey % 2 = 0 then 'added' end as brier, case when s_suppkey % 3 = 0 then 'kept' end as seed, case when s_suppkey % 2 = 0 then 'whole' end as other from supplier")
def metrics_merged_deep(spark, sf):
    """Two levels: a metric that both have keeps its entries and gets those that it lacks."""
    s, k = read(spark, sf, "supplier"), c("s_suppkey")
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    none = m().cast("map<string,map<string,string>>")
    old = F.when(k % 3 == 0, m("model", m("auc", "old", "seed", "kept"))).otherwise(none)
    new = F.when(k % 2 == 0, m("model", m("auc", "new", "brier", "added"), "rival", m("other", "whole"))).otherwise(none)
    at = lambda a, b: F.try_element_at(F.try_element_at("m", F.lit(a)), F.lit(b))
    return s.select("s_suppkey", store.keep_existing_deep(old, new).alias("m")).select("s_suppkey", at("model", "auc").alias("auc"), at("model", "brier").alias("brier"), at("model", "seed").alias("seed"), at("rival", "other").alias("other"))


@query("select n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' as line from nation")
def sorted_json_lines(spark, sf):
    """Documents with sorted keys are written to two places; the second is read back."""
    rows = read(spark, sf, "nation").select("n_nationkey", store.sorted_json({"region": c("n_regionkey"), "name": c("n_name")}).alias("line"))
    paths = [_folder(spark, "json") for _ in range(2)]
    for p in paths:
        rows.select(F.concat_ws("\t", "n_nationkey", "line").alias("value")).write.text(p)
    return spark.read.text(paths[1]).select(F.split("value", "\t")[0].cast("int").alias("n_nationkey"), F.split("value", "\t")[1].alias("line"))


@query("select vec_id, case when vec_id % 3 = 0 then null else vec_id * 1.0 end as a, case when vec_id % 4 = 0 then null else vec_id * 2.0 end as b, len(embedding) as kept from embeddings")
def finite_documents(spark, sf):
    """NaN and infinities become null at any depth."""
    bad = lambda every, x: F.when(c("vec_id") % every == 0, F.lit("NaN").cast("double")).otherwise(x)
    doc = F.struct(bad(3, c("vec_id") * 1.0).alias("a"), F.struct(F.when(c("vec_id") % 4 == 0, F.lit("-Infinity").cast("double")).otherwise(c("vec_id") * 2.0).alias("b"), c("embedding").alias("list")).alias("inner"))
    clean = store.finite(read(spark, sf, "embeddings").select("vec_id", doc.alias("doc")))
    return clean.select("vec_id", c("doc.a").alias("a"), c("doc.inner.b").alias("b"), F.size("doc.inner.list").cast("bigint").alias("kept"))


@query("select p_partkey, p_brand, p_size, p_retailprice from part")
def csv_round_trip(spark, sf):
    """A CSV file with a header."""
    path = _folder(spark, "csv")
    rows = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    rows.write.option("header", True).csv(path)
    return text.csv_rows(spark, path, rows.schema)


@query("select c_custkey, c_name as name, c_nationkey as nation from customer where c_custkey % 7 <> 0")
def stored_documents(spark, sf):
    """Documents as JSON text, some of them quoted twice; malformed ones are left out."""
    doc = F.to_json(F.struct(c("c_name").alias("name"), c("c_nationkey").alias("nation")))
    quoted = F.concat(F.lit('"'), F.replace(doc, F.lit('"'), F.lit('\\"')), F.lit('"'))
    raw = read(spark, sf, "customer").select("c_custkey", F.when(c("c_custkey") % 7 == 0, "{broken").when(c("c_custkey") % 5 == 0, quoted).otherwise(doc).alias("data"))
    return text.documents_of(raw, "data", "name string, nation int").select("c_custkey", "doc.name", "doc.nation")


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as blob from orders group by 1")
def latest_blob(spark, sf):
    """S17."""
    return store.latest(read(spark, sf, "orders").select("o_custkey", "o_orderdate", c("o_orderkey").alias("blob")), ["o_custkey"], ["o_orderdate", "blob"]).select("o_custkey", "blob")


_SPLIT = "g as (select 'g' || (o_custkey % 40) as grp, case when o_custkey % 40 < 20 or o_custkey % 40 = 33 then 'D1' end as d1, case when o_custkey % 40 between 20 and 29 then 'D2' end as d2, case when o_custkey % 40 >= 30 then 'D3' end as d3, o_orderkey as k from orders)"


@query(f"with {_SPLIT}, s as (select grp, 'D1' as split, count(*) as n from g where d1 is not null group by 1 union all select grp, 'D2', count(*) from g where d2 is not null group by 1 union all select grp, 'D3', count(*) from g where d3 is not null group by 1) select 'groups in two splits' as rule, grp as what, count(*) as n from s group by grp having count(*) > 1 union all select 'locked split too small', 'D3', count(*) from s where split = 'D3' having count(*) < 12 union all select 'largest over smallest', 'D1', max(n) // min(n) from s where split = 'D1' having max(n) > 3 * min(n)")
def split_violations(spark, sf):
    """A row for each rule that the splits break."""
    k = c("o_custkey") % 40
    g = read(spark, sf, "orders").select(F.concat(F.lit("g"), k.cast("string")).alias("grp"), F.filter(F.array(F.when((k < 20) | (k == 33), "D1"), F.when(k.between(20, 29), "D2"), F.when(k >= 30, "D3")), lambda x: x.isNotNull()).alias("splits"))
    s = g.select("grp", F.explode("splits").alias("split")).groupBy("grp", "split").agg(F.count("*").alias("n"))
    twice = s.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("groups in two splits").alias("rule"), c("grp").alias("what"), "n")
    small = s.where("split = 'D3'").agg(F.count("*").alias("n")).where("n < 12").select(F.lit("locked split too small").alias("rule"), F.lit("D3").alias("what"), "n")
    ratio = s.where("split = 'D1'").agg(F.max("n").alias("a"), F.min("n").alias("b")).where("a > 3 * b").select(F.lit("largest over smallest").alias("rule"), F.lit("D1").alias("what"), F.expr("a div b").alias("n"))
    return twice.union(small).union(ratio)


@query(f"with {_SCORED}, m as (select avg(pow(p - y, 2)) as brier, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy, count(*) * 1.0 as n from s) select 'brier' as metric, round(brier, 9) as value, 'above' as broken from m where brier > 0.05 union all select 'accuracy', round(accuracy, 9), 'below' from m where accuracy < 0.99 union all select 'n', n, 'below' from m where n < 10")
def metric_gates(spark, sf):
    """Metrics that are outside their thresholds."""
    s = scored(spark, sf).agg(F.avg((c("p") - c("y")) ** 2).alias("brier"), F.avg(((c("p") >= 0.5) == (c("y") == 1)).cast("double")).alias("accuracy"), F.count("*").cast("double").alias("n"))
    return statistics.gates(s, {"brier": (None, 0.05), "accuracy": (0.99, None), "n": (10.0, None)})


_DRAW = "('0x' || substr(sha256({s} || '|' || r || '|' || {g}), 1, 8))::bigint / 4294967296.0"


@query(f"with {_SCORED}, r as (select unnest(range(1, 101)) as r), w as (select r, source, {_DRAW.format(s=3, g='source')} < 0.632120559 as drawn from r, (select distinct source from s)), b as (select r, avg(pow(p - y, 2)) as brier from s join w using (source) where drawn group by 1) select round(quantile_cont(brier, 0.025), 9) as low, round(quantile_cont(brier, 0.975), 9) as high, count(*) as rounds from b")
def set_bootstrap(spark, sf):
    """A family is in a round or not, as often as a draw with replacement would have it at all."""
    return resampling.interval(resampling.set_draws(resampling.group_sums(scored(spark, sf), "source", (c("p") - c("y")) ** 2), "source", 100, 3)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "rounds")


@query(f"with {_SCORED}, b as (select doc_id, pow(p - y, 2) as x, sha256('5|' || doc_id) as h from s), w as (select x, ('0x' || substr(h, 1, 2))::bigint % 64 as bucket from b), g as (select bucket, sum(x) as t, count(*) as n from w group by 1), r as (select unnest(range(1, 101)) as r), u as (select r, bucket, {_DRAW.format(s=5, g='bucket')} as u from r, g), d as (select r, bucket, case when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 else 5 end as times from u), e as (select r, sum(times * t) / nullif(sum(times * n), 0) as m from d join g using (bucket) group by 1) select round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, count(*) as rounds from e")
def bag_bootstrap(spark, sf):
    """Rows in 64 bags by hash; each bag is drawn 0 to 5 times a round, by the Poisson law."""
    s = scored(spark, sf).select(((c("p") - c("y")) ** 2).alias("x"), (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("5"), c("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("bigint") % 64).alias("bucket"))
    return resampling.interval(resampling.poisson_draws(resampling.group_sums(s, "bucket", c("x")), "bucket", 100, 5)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "rounds")


@query(f"with {_SCORED}, r as (select unnest(range(1, 51)) as r), u as (select r, doc_id, pow(p - y, 2) as x, {_DRAW.format(s=13, g='doc_id')} as u from r, s), d as (select r, x, case when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 else 5 end as times from u), e as (select r, sum(times * x) / nullif(sum(times), 0) as m from d group by 1) select round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, count(*) as rounds from e")
def row_bootstrap(spark, sf):
    """Each row is drawn by itself, 0 to 5 times a round by the Poisson law; a round is summed up before anything meets."""
    return resampling.interval(resampling.poisson_draws(resampling.group_sums(scored(spark, sf), "doc_id", (c("p") - c("y")) ** 2), "doc_id", 50, 13)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "rounds")


@query(f"with {_SCORED}, b as (select least(9, cast(floor(p * 10) as integer)) as bin, source, sum(y) as t, count(*) as n from s group by 1, 2), r as (select unnest(range(1, 101)) as r), u as (select r, source, {_DRAW.format(s=7, g='source')} as u from r, (select distinct source from s)), d as (select r, source, case when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 else 5 end as times from u), e as (select bin, r, sum(times * t) * 1.0 / nullif(sum(times * n), 0) as m from d join b using (source) group by 1, 2) select bin, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, count(m) as rounds from e group by 1")
def bin_bootstrap(spark, sf):
    """An interval of each bin's rate; a bin that a round leaves empty gives it no value."""
    s = scored(spark, sf).select("source", c("y").alias("x"), F.least(F.lit(9), F.floor(c("p") * 10).cast("int")).alias("bin"))
    sums = s.groupBy("bin", "source").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    return resampling.interval(resampling.poisson_draws(sums, "source", 100, 7, ["bin"]), ["bin"]).select("bin", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "rounds")


@query(f"with f as ({FLOWS}), x as (select case when version in ('TLS1.0', 'TLS1.1') then 1 else 0 end as y, -ja4_rarity as p from f where ja4_rarity is not null), r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from x) select round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auc from r")
def rarity_auc(spark, sf):
    """How well rarity alone, negated, ranks."""
    x = flow_attributes(spark, sf).where("ja4_rarity is not null").select(c("version").isin("TLS1.0", "TLS1.1").cast("int").alias("y"), (-c("ja4_rarity")).alias("p"))
    return statistics.roc_auc(x, "p", "y").select(F.round("auc", 9).alias("auc"))


@query("select f as feature, var_pop(x) > 1e-12 as varies from (select 1 as f, l_quantity as x from lineitem union all select 2, l_discount from lineitem union all select 3, 7.0 from lineitem) group by 1")
def varying_features(spark, sf):
    """Features without variance are told, and left out, rather than blurred."""
    rows = read(spark, sf, "lineitem").select(c("l_quantity").alias("1"), c("l_discount").alias("2"), F.lit(7.0).alias("3"))
    return statistics.varying(rows, ["1", "2", "3"]).select(c("feature").cast("int").alias("feature"), "varies")


@query("select vec_id, copy, round(embedding[1] * (1 + 0.02 * (('0x' || substr(sha256('9|' || vec_id || '|' || copy), 1, 8))::bigint / 4294967296.0 - 0.5)), 6) as x from embeddings, (select unnest(range(0, 3)) as copy)")
def expanded_rows(spark, sf):
    """Three copies of each row, blurred by up to one hundredth by hash."""
    v = read(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
    return resampling.expanded(v, "vec_id", "x", 3, 0.02, 9).select("vec_id", c("copy").cast("bigint").alias("copy"), F.round("x", 6).alias("x"))


@query(f"with {_SCORED}, t as (select y, ((doc_id * 53) % 997) / 997.0 as q, p from s), a as (select 'model' as name, p as p, y from t union all select 'rival', 0.6 * q + 0.4 * y, y from t), r as (select name, y, rank() over (partition by name order by p) + (count(*) over (partition by name, p) - 1) / 2.0 as rk from a), u as (select name, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc from r group by 1), b as (select name, avg(pow(p - y, 2)) as brier from a group by 1) select name, round(auc, 9) as auc, round(brier, 9) as brier, auc = max(auc) over () as promoted from u join b using (name)")
def model_comparison(spark, sf):
    """A row for each model; that of the largest AUC is promoted."""
    s = scored(spark, sf)
    q = ((c("doc_id") * 53) % 997) / 997.0
    a = s.select(F.explode(F.array(F.struct(F.lit("model").alias("name"), c("p").alias("p"), c("y").alias("y")), F.struct(F.lit("rival").alias("name"), (0.6 * q + 0.4 * c("y")).alias("p"), c("y").alias("y")))).alias("m")).select("m.*")
    told = statistics.roc_auc(a, "p", "y", ["name"]).join(a.groupBy("name").agg(F.avg((c("p") - c("y")) ** 2).alias("brier")), "name")
    best = told.agg(F.max("auc").alias("best"))
    return told.join(F.broadcast(best), F.lit(True)).select("name", F.round("auc", 9).alias("auc"), F.round("brier", 9).alias("brier"), (c("auc") == c("best")).alias("promoted"))


@query(f"with {_SCORED}, r as (select y, source, rank() over (partition by source order by p) + (count(*) over (partition by source, p) - 1) / 2.0 as rk from s), u as (select source, sum(y) as ones, count(*) as n, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from r group by 1) select count(*) filter (where ones > 0 and ones < n) as folds, count(*) as groups, round(avg(case when ones > 0 and ones < n then auc end), 9) as mean_auc from u")
def leave_one_group_out(spark, sf):
    """The mean AUC over groups; groups of one class are no folds."""
    a = statistics.roc_auc(scored(spark, sf), "p", "y", ["source"])
    return a.agg(F.count("auc").alias("folds"), F.count("*").alias("groups"), F.round(F.avg("auc"), 9).alias("mean_auc"))


@query("select tier, r as rank, vec_id from (select vec_id % 4 as tier, vec_id, row_number() over (partition by vec_id % 4 order by sha256('11|' || vec_id), vec_id) as r from embeddings) where r <= case when tier >= 2 then 26 else 25 end")
def tiered_sample(spark, sf):
    """102 rows over four tiers, alike but for the remainder, which the last tiers get."""
    v = read(spark, sf, "embeddings").select((c("vec_id") % 4).alias("tier"), "vec_id")
    return resampling.tiered(v, "tier", "vec_id", [0, 1, 2, 3], 102, 11).select("tier", c("place").alias("rank"), "vec_id")
