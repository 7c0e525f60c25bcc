"""Metrics, label models, sampling and anomaly scores (N, A27-A35, W08-W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labelling, statistics
from tidemark.plans.registry import query
from tidemark.sources.tables import read

#: Probabilities and outcomes: labelled documents, scored by arithmetic on their key.
_SCORED = "s as (select l.doc_id, d.source, l.quality as y, ((l.doc_id * 37 + d.n_chars) % 1001) / 1001.0 * 0.5 + l.quality * 0.3 as p from labels l join documents d on d.doc_id = l.doc_id)"


def scored(spark, sf):
    lab, docs = read(spark, sf, "labels"), read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    p = ((F.col("doc_id") * 37 + F.col("n_chars")) % 1001) / 1001.0 * 0.5 + F.col("quality") * 0.3
    return lab.join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("y"), p.alias("p"))


@query(f"with {_SCORED}, b as (select greatest(1, least(10, ceil(p * 10))) as bin, count(*) as n, avg(y) as acc, avg(p) as conf from s group by 1) select round(sum(n * abs(acc - conf)) / sum(n), 9) as ece from b")
def ece_equal_width(spark, sf):
    return statistics.calibration_error(scored(spark, sf), "p", "y", 10).select(F.round("ece", 9).alias("ece"))


@query(f"with {_SCORED}, e as (select quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) as q from s), b as (select len(list_filter(q, lambda x: x < p)) as bin, count(*) as n, avg(y) as acc, avg(p) as conf from s, e group by 1) select round(sum(n * abs(acc - conf)) / sum(n), 9) as ece from b")
def ece_quantile(spark, sf):
    s = scored(spark, sf)
    edges = s.agg(F.percentile("p", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    b = s.join(F.broadcast(edges), F.lit(True)).groupBy(F.size(F.filter("q", lambda x: x < F.col("p"))).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 9).alias("ece"))


@query(f"with {_SCORED}, w as (select avg((p - y) * (p - y)) as brier, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) as log_loss, avg(y) as base, count(*) as total from s), b as (select greatest(1, least(10, ceil(p * 10))) as bin, count(*) as n, avg(y) as acc, avg(p) as conf from s group by 1) select round(any_value(brier), 9) as brier, round(any_value(log_loss), 9) as log_loss, round(sum(n / total * (conf - acc) ** 2), 9) as reliability, round(sum(n / total * (acc - base) ** 2), 9) as resolution, round(any_value(base * (1 - base)), 9) as uncertainty from b, w")
def brier_decomposition(spark, sf):
    b = statistics.brier(scored(spark, sf), "p", "y", 10)
    return b.select(*[F.round(c, 9).alias(c) for c in b.columns])


_RANKS = "r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from s)"


@query(f"with {_SCORED}, {_RANKS} select round((sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auc from r")
def roc_auc_ranksum(spark, sf):
    return statistics.roc_auc(scored(spark, sf), "p", "y").select(F.round("auc", 9).alias("auc"))


@query(f"with {_SCORED}, r as (select *, rank() over (partition by source order by p) + (count(*) over (partition by source, p) - 1) / 2.0 as rk from s) select source, case when sum(y) > 0 and sum(y) < count(*) then round((sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) end as auc from r group by 1")
def slice_auc(spark, sf):
    return statistics.roc_auc(scored(spark, sf), "p", "y", ["source"]).select("source", F.round("auc", 9).alias("auc"))


@query(f"with {_SCORED}, c as (select p, sum(y) as pos, count(*) as n from s group by 1), t as (select *, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as k, sum(pos) over () as ones from c) select round(sum(pos / ones * tp / k), 9) as average_precision from t")
def average_precision(spark, sf):
    return statistics.average_precision(scored(spark, sf), "p", "y").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"with {_SCORED}, c as (select p, sum(y) as pos, count(*) as n from s group by 1), t as (select p, round(sum(pos) over (order by p desc) / sum(pos) over () - (sum(n) over (order by p desc) - sum(pos) over (order by p desc)) / (sum(n) over () - sum(pos) over ()), 12) as j from c) select round(greatest(0.2, least(0.9, p)), 9) as threshold, round(j, 9) as j from t order by j desc, p limit 1")
def youden_threshold(spark, sf):
    return statistics.youden(scored(spark, sf), "p", "y").select(F.round("threshold", 9).alias("threshold"), F.round("j", 9).alias("j"))


@query(f"with {_SCORED}, g as (select source, sum((p - y) ** 2) as ss, count(*) as n, row_number() over (order by source) - 1 as g from s group by 1), c as (select count(*) as groups from g), d as (select r.range as round, ('0x' || substr(sha256(concat_ws('|', '42', r.range, t.range)), 1, 8))::bigint % groups as g from range(0, 200) r, c, lateral (select unnest(range(1, groups + 1)) as range) t), v as (select round, sum(ss) / sum(n) as value from d join g using (g) group by 1) select round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high from v")
def bootstrap_ci_groups(spark, sf):
    v = statistics.group_bootstrap(scored(spark, sf), "source", "p", "y", 200, 42)
    return v.agg(F.round(F.percentile("value", 0.025), 9).alias("low"), F.round(F.percentile("value", 0.975), 9).alias("high"))


@query("select round((o - e) / (1 - e), 9) as kappa from (select sum(case when quality = toxic then 1 else 0 end) / count(*) as o, (sum(quality) / count(*)) * (sum(toxic) / count(*)) + (1 - sum(quality) / count(*)) * (1 - sum(toxic) / count(*)) as e from labels)")
def cohen_kappa(spark, sf):
    return statistics.kappa(read(spark, sf, "labels"), "quality", "toxic").select(F.round("kappa", 9).alias("kappa"))


_RATINGS = "t as (select vec_id as item, unnest([label % 3, (vec_id * 7) % 3, (vec_id * 7 + label // 5) % 3]) as category from embeddings)"


@query(f"with {_RATINGS}, c as (select item, category, count(*) as n from t group by 1, 2), p as (select avg((sq - r) / (r * (r - 1))) as p, sum(r) as total from (select item, sum(n) as r, sum(n * n) as sq from c group by 1)), e as (select sum((x / total) ** 2) as e from (select category, sum(n) as x from c group by 1), p) select round((p - e) / (1 - e), 9) as kappa from p, e")
def fleiss_kappa(spark, sf):
    v, k = read(spark, sf, "embeddings"), F.col("vec_id")
    rated = v.select(k.alias("item"), F.explode(F.array(F.col("label") % 3, (k * 7) % 3, (k * 7 + F.floor(F.col("label") / 5)) % 3)).alias("category"))
    return statistics.fleiss(rated.groupBy("item", "category").agg(F.count("*").alias("n")), "item", "category", "n").select(F.round("kappa", 9).alias("kappa"))


@query("with g as (select l_orderkey as q, (l_partkey * 10 + l_linenumber) * 100 + cast(l_quantity as bigint) as item, pow(2, l_quantity % 5) - 1 as gain, (l_partkey * 13) % 97 / 97.0 as score from lineitem), r as (select *, row_number() over (partition by q order by score desc, item) as s, row_number() over (partition by q order by gain desc, item) as b from g) select q, round(coalesce(sum(case when s <= 10 then gain / log2(s + 1) else 0 end) / nullif(sum(case when b <= 10 then gain / log2(b + 1) else 0 end), 0), 0), 6) as ndcg from r group by 1")
def ndcg_at_10(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("bigint")).alias("item"), (F.pow(F.lit(2.0), F.col("l_quantity") % 5) - 1).alias("gain"), ((F.col("l_partkey") * 13) % 97 / 97.0).alias("score"))
    return statistics.ndcg(df, "q", "item", "gain", "score", 10).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("with a as (select *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) as m, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) as h from (select l_returnflag, count(*) as n, avg(case when l_discount > 0.05 then 1.0 else 0.0 end) as p from lineitem group by 1)) select l_returnflag, round(greatest(0, m - h), 9) as low, round(least(1, m + h), 9) as high from a")
def wilson_interval(spark, sf):
    from tidemark.functions.numbers import wilson

    a = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("p"))
    low, high = wilson(F.col("p"), F.col("n"))
    return a.select("l_returnflag", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"with {_SCORED}, g as (select source, count(*) as n, avg(y) as m, sum(y * y) - count(*) * avg(y) * avg(y) as w from s group by 1), t as (select count(*) as k, sum(n) as n, avg(n) as size, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) as msb, sum(w) / (sum(n) - count(*)) as msw from g), i as (select *, greatest(0, (msb - msw) / (msb + (size - 1) * msw)) as icc from t) select round(icc, 9) as icc, round(1 + (size - 1) * icc, 9) as deff, round(n / (1 + (size - 1) * icc), 6) as n_eff from i")
def design_effect(spark, sf):
    return statistics.design_effect(scored(spark, sf), "source", "y").select(F.round("icc", 9).alias("icc"), F.round("deff", 9).alias("deff"), F.round("n_eff", 6).alias("n_eff"))


#: Six label functions over orders: 1, 0, or -1 for no opinion.
_LABELS = "m as (select o_orderkey as k, case when o_totalprice > 250000 then 1 when o_totalprice < 50000 then 0 else -1 end as f1, case o_orderpriority when '1-URGENT' then 1 when '5-LOW' then 0 else -1 end as f2, case o_orderstatus when 'F' then 1 when 'O' then 0 else -1 end as f3, case when o_orderkey % 3 = 0 then 1 when o_orderkey % 3 = 1 then 0 else -1 end as f4, case when o_custkey % 4 = 0 then 1 when o_custkey % 4 < 3 then 0 else -1 end as f5, case when o_totalprice > 200000 then 1 when o_orderkey % 2 = 0 then 0 else -1 end as f6 from orders)"
_FUNCTIONS = ["f1", "f2", "f3", "f4", "f5", "f6"]


def label_matrix(spark, sf):
    return spark.sql(f"with {_LABELS} select * from m".replace("from orders", "from {orders}"), orders=read(spark, sf, "orders"))


_COVER = " union all ".join([f"select '{f}' as name, round(avg(case when {f} <> -1 then 1.0 else 0.0 end), 9) as share from m" for f in _FUNCTIONS] + ["select 'any', round(avg(case when greatest(f1, f2, f3, f4, f5, f6) > -1 then 1.0 else 0.0 end), 9) from m", "select 'conflict', round(avg(case when greatest(f1, f2, f3, f4, f5, f6) = 1 and (f1 = 0 or f2 = 0 or f3 = 0 or f4 = 0 or f5 = 0 or f6 = 0) then 1.0 else 0.0 end), 9) from m"])


@query(f"with {_LABELS} {_COVER}")
def lf_coverage(spark, sf):
    return labelling.coverage(label_matrix(spark, sf), _FUNCTIONS).select("name", F.round("share", 9).alias("share"))


_LONG = "u as (" + " union all ".join(f"select k, '{f}' as f, {f} as v from m where {f} <> -1" for f in _FUNCTIONS) + "), c as (select f, count(*) as n from u group by 1), j as (select x.f as a, y.f as b, count(*) as n, avg(cast((2 * x.v - 1) * (2 * y.v - 1) as double)) as e from u x join u y on x.k = y.k and x.f < y.f group by 1, 2)"


@query(f"with {_LABELS}, {_LONG} select a, b, j.n, round(e, 9) as e, round(j.n / (ca.n + cb.n - j.n), 9) as jaccard from j join c ca on ca.f = a join c cb on cb.f = b")
def lf_agreement(spark, sf):
    return labelling.agreements(label_matrix(spark, sf), _FUNCTIONS).select("a", "b", "n", F.round("e", 9).alias("e"), F.round("jaccard", 9).alias("jaccard"))


_ALPHAS = "p as (select a, b, e from j where n >= 10 and e <> 0 union all select b, a, e from j where n >= 10 and e <> 0), al as (select ab.a as name, median(greatest(0.51, least(0.99, 0.5 * (1 + sqrt(abs(ab.e * ac.e / bc.e)))))) as alpha from p ab join p ac on ab.a = ac.a and ab.b < ac.b join p bc on bc.a = ab.b and bc.b = ac.b group by 1)"


@query(f"with {_LABELS}, {_LONG}, {_ALPHAS} select name, round(alpha, 9) as alpha from al")
def triplet_accuracies(spark, sf):
    a = labelling.accuracies(labelling.agreements(label_matrix(spark, sf), _FUNCTIONS))
    return a.select("name", F.round("alpha", 9).alias("alpha"))


@query(f"with {_LABELS}, {_LONG}, {_ALPHAS}, w as (select k, round(sum((2 * v - 1) * greatest(-2, least(2, ln(alpha / (1 - alpha))))), 9) as t from u join al on al.name = u.f group by 1) select m.k, case when t > 0 then 1 when t < 0 then 0 else -1 end as vote from m left join w on w.k = m.k")
def weighted_vote(spark, sf):
    m = label_matrix(spark, sf)
    return labelling.weighted_vote(m, _FUNCTIONS, labelling.accuracies(labelling.agreements(m, _FUNCTIONS))).select("k", "vote")


@query(f"with {_LABELS}, {_LONG}, w as (select k, sum(2 * v - 1) as t from u group by 1) select m.k, case when t > 0 then 1 when t < 0 then 0 else -1 end as vote from m left join w on w.k = m.k")
def majority_vote(spark, sf):
    return labelling.majority_vote(label_matrix(spark, sf), _FUNCTIONS).select("k", "vote")


_TAILS = "f as (" + " union all ".join(f"select vec_id, {i} as f, cast(embedding[{i}] as double) as x from embeddings" for i in range(1, 65)) + "), sk as (select f, (sum(pow(x - mu, 3)) / count(*)) / pow(sum(pow(x - mu, 2)) / count(*), 1.5) as skew from (select *, avg(x) over (partition by f) as mu from f) group by 1), t as (select vec_id, f.f, -ln(cume_dist() over (partition by f.f order by x)) as l, -ln(cume_dist() over (partition by f.f order by x desc)) as r from f)"


@query(f"with {_TAILS} select vec_id, round(greatest(sum(l), sum(r), sum(case when skew < 0 then l else r end)), 6) as ecod from t join sk using (f) group by 1")
def ecod_scores(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", *[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, 65)])
    return statistics.ecdf(v, "vec_id", [f"x{i}" for i in range(1, 65)]).select("vec_id", F.round("ecod", 6).alias("ecod"))


@query("select label, vec_id from (select label, vec_id, row_number() over (partition by label order by sha256('7|' || vec_id), vec_id) as r from embeddings) where r <= 25")
def stratified_sample(spark, sf):
    return statistics.stratified(read(spark, sf, "embeddings").select("label", "vec_id"), "label", "vec_id", 25, 7)


@query("with c as (select label, vec_id, row_number() over (partition by label order by sha256('7|' || vec_id), vec_id) as r, count(*) over (partition by label) as n from embeddings), t as (select unnest(range(0, 700)) as t) select label, vec_id from c join t on r + t.t * least(n, 700) <= 700 where r <= 700")
def stratified_sample_filled(spark, sf):
    return statistics.filled(read(spark, sf, "embeddings").select("label", "vec_id"), "label", "vec_id", 700, 7)


@query("select y, pred, count(*) as n from (select quality as y, case when doc_id % 3 = 0 then 1 - quality else quality end as pred from labels) group by 1, 2")
def confusion_counts(spark, sf):
    q = F.col("quality")
    return read(spark, sf, "labels").select(q.alias("y"), F.when(F.col("doc_id") % 3 == 0, 1 - q).otherwise(q).alias("pred")).groupBy("y", "pred").agg(F.count("*").alias("n"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as c1, round(corr(l_quantity, l_discount), 6) as c2, round(corr(l_extendedprice, l_discount), 6) as c3 from lineitem")
def correlations(spark, sf):
    pair = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return read(spark, sf, "lineitem").agg(pair("l_quantity", "l_extendedprice", "c1"), pair("l_quantity", "l_discount", "c2"), pair("l_extendedprice", "l_discount", "c3"))
