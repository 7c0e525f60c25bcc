"""Models and their tests (N03, N15, N16, N23, N36, N37, N40, N41); without SQL unless they are closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration, learning, rules
from tidemark.plans.evaluation import _SCORED, scored
from tidemark.plans.registry import query
from tidemark.sources.tables import read, verdicts

_FEATURES = ["version_code", "days", "bits", "rarity", "port"]


def _rows(spark, sf):
    c = F.col
    a = rules.assess(verdicts(spark, sf))
    return a.select("flow_id", "custkey", (c("risk_level").isin("High", "Critical")).cast("double").alias("y"), F.substring("tls.version", 6, 1).try_cast("double").alias("v"), F.coalesce(c("cert.days_to_expiry"), F.lit(-1)).cast("double").alias("days"), F.coalesce(c("cert.pubkey_bits"), F.lit(-1)).cast("double").alias("bits"), F.coalesce(c("tls.ja4_rarity"), F.lit(0.5)).alias("rarity"), c("port").cast("double").alias("port")).withColumn("version_code", F.coalesce("v", F.lit(-1.0))).drop("v")


@query()
def risk_model_group_folds(spark, sf):
    rows = _rows(spark, sf).withColumn("fold", learning.group_fold("custkey", 3))
    return learning.cross_predict(rows, _FEATURES, "y", "fold", 3).select("flow_id", "fold", "y", "probability")


@query()
def isolation_forest(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", *[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, 65)])
    return learning.isolation_scores(v, "vec_id", [f"x{i}" for i in range(1, 65)])


@query()
def kmeans_entropy_select(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", *[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, 65)], ((F.col("vec_id") % 101) / 100.0).alias("p"))
    return learning.select_uncertain(v, "vec_id", [f"x{i}" for i in range(1, 65)], "p", most=25)


@query(f"with {_SCORED}, a as (select s.doc_id, (select avg(case when t.p < s.p then 1.0 when t.p = s.p then 0.5 else 0.0 end) from s t where t.y = 0) as v from s where y = 1), b as (select s.doc_id, (select avg(case when t.p > s.p then 1.0 when t.p = s.p then 0.5 else 0.0 end) from s t where t.y = 1) as v from s where y = 0) select round((select avg(v) from a), 9) as auc, round((select var_samp(v) / count(*) from a) + (select var_samp(v) / count(*) from b), 12) as variance")
def delong_variance(spark, sf):
    return learning.delong(scored(spark, sf), "p", "y").select(F.round("auc", 9).alias("auc"), F.round("variance", 12).alias("variance"))


@query(f"with {_SCORED}, w as (select greatest(0.015, least(0.35, 0.9 * least(stddev_pop(p), (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / 1.34) * pow(count(*), -0.2))) as h from s), k as (select a.doc_id, a.p, sum(exp(-0.5 * ((a.p - b.p) / h) ** 2) * b.y) / sum(exp(-0.5 * ((a.p - b.p) / h) ** 2)) as sm from s a, s b, w group by 1, 2) select round(avg(abs(sm - p)), 9) as ece from k")
def ece_smooth(spark, sf):
    return calibration.smooth_error(scored(spark, sf), "p", "y").select(F.round("ece", 9).alias("ece"))


@query(f"with {_SCORED}, r as (select doc_id, p, t.r, ('0x' || substr(sha256('1|' || doc_id || '|' || t.r), 1, 8))::bigint as u from s, (select unnest(range(1, 201)) as r) t), o as (select r, p, row_number() over (partition by r order by u, doc_id) <= (select sum(y) from s) as one from r), d as (select r, avg(case when one then p end) - avg(case when not one then p end) as d from o group by 1) select (1 + count(*) filter (where d >= (select avg(case when y = 1 then p end) - avg(case when y = 0 then p end) from s))) / (1 + count(*)) as p_value from d")
def permutation_p(spark, sf):
    return learning.permutation_p(scored(spark, sf), "doc_id", "p", "y", 200)
