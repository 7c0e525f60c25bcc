"""Studies of models: calibration by isotonic fits, comparisons of two models, importance, extrapolation, nested folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration, comparison
from tidemark.plans.evaluation import _SCORED, scored
from tidemark.plans.population import _DRAW
from tidemark.plans.registry import query
from tidemark.sources.tables import read

c = F.col

#: The isotonic fit by its definition: the largest, over all earlier beginnings, of the smallest, over all later ends, mean between them.
_FIT = f"""{_SCORED}, d as (select p, sum(y) as pos, count(*) as n, row_number() over (order by p) as i from s group by 1), q as (select p, i, pos, n, sum(pos) over (order by i) as sp, sum(n) over (order by i) as sn from d),
m as (select a.i as a, b.i as b, (b.sp - a.sp + a.pos) / (b.sn - a.sn + a.n) as m from q a join q b on a.i <= b.i), l as (select a, b, min(m) over (partition by a order by b desc) as low from m), f as (select q.p, q.pos, q.n, max(l.low) as fit from q join l on l.a <= q.i and l.b = q.i group by all)"""


@query(f"with {_FIT}, t as (select sum(n) as n, sum(pos) / sum(n) as base, sum(pos * (1 - fit) ** 2 + (n - pos) * fit ** 2) / sum(n) as fitted from f), w as (select avg((p - y) ** 2) as score from s) select round(score, 9) as score, round(score - fitted, 9) as mcb, round(base * (1 - base) - fitted, 9) as dsc, round(base * (1 - base), 9) as unc from t, w")
def corp_decomposition(spark, sf):
    """Miscalibration, discrimination and uncertainty, which add up to the score."""
    found = calibration.decomposition(scored(spark, sf), "p", "y")
    return found.select(*[F.round(x, 9).alias(x) for x in found.columns])


@query(f"with {_FIT} select doc_id, round(fit, 9) as calibrated from s join f using (p)")
def isotonic_calibration(spark, sf):
    return calibration.recalibrated(scored(spark, sf), "p", "y").select("doc_id", F.round("calibrated", 9).alias("calibrated"))


def two_scores(spark, sf):
    """Labelled documents with two scores; the second knows less of the label."""
    docs = read(spark, sf, "documents").select("doc_id", (((c("doc_id") * 53 + c("n_chars")) % 997) / 997.0).alias("u"))
    return scored(spark, sf).join(docs, "doc_id").select("doc_id", "source", "y", "p", (c("u") * 0.6 + c("y") * 0.15).alias("p2"))


_TWO = f"{_SCORED}, b as (select s.*, ((s.doc_id * 53 + d.n_chars) % 997) / 997.0 * 0.6 + y * 0.15 as p2 from s join documents d using (doc_id))"
_BEATS = "avg(case when {u} > {v} then 1.0 when {u} = {v} then 0.5 else 0.0 end)"


@query(f"""with {_TWO}, x as (select i.doc_id, {_BEATS.format(u='i.p', v='j.p')} as a, {_BEATS.format(u='i.p2', v='j.p2')} as b from b i join b j on i.y = 1 and j.y = 0 group by 1), z as (select j.doc_id, {_BEATS.format(u='i.p', v='j.p')} as a, {_BEATS.format(u='i.p2', v='j.p2')} as b from b i join b j on i.y = 1 and j.y = 0 group by 1),
m as (select avg(a) as auc_a, avg(b) as auc_b, var_samp(a) / count(*) as va, var_samp(b) / count(*) as vb, covar_samp(a, b) / count(*) as v from x), n as (select var_samp(a) / count(*) as va, var_samp(b) / count(*) as vb, covar_samp(a, b) / count(*) as v from z)
select round(auc_a, 9) as auc_a, round(auc_b, 9) as auc_b, round(m.va + n.va, 12) as var_a, round(m.vb + n.vb, 12) as var_b, round(m.v + n.v, 12) as cov, round((auc_a - auc_b) / sqrt(m.va + n.va + m.vb + n.vb - 2 * (m.v + n.v)), 6) as z from m, n""")
def paired_delong(spark, sf):
    """Whether two AUCs of the same documents differ."""
    found = comparison.paired_delong(two_scores(spark, sf), "p", "p2", "y")
    digits = {"auc_a": 9, "auc_b": 9, "var_a": 12, "var_b": 12, "cov": 12, "z": 6}
    return found.select(*[F.round(k, n).alias(k) for k, n in digits.items()])


_GAINS = "g as (select l_orderkey as q, (l_partkey * 10 + l_linenumber) * 100 + cast(l_quantity as bigint) as item, pow(2, l_quantity % 5) - 1 as gain, (l_partkey * 13) % 97 / 97.0 as sa, l_quantity % 5 + (l_partkey * 7) % 31 / 10.0 as sb from lineitem)"


@query(f"""with {_GAINS}, r as (select *, row_number() over (partition by q order by sa desc, item) as ra, row_number() over (partition by q order by sb desc, item) as rb, row_number() over (partition by q order by gain desc, item) as rg from g),
n as (select q, coalesce(sum(case when ra <= 3 then gain / log2(ra + 1) else 0 end) / nullif(sum(case when rg <= 3 then gain / log2(rg + 1) else 0 end), 0), 0) as a, coalesce(sum(case when rb <= 3 then gain / log2(rb + 1) else 0 end) / nullif(sum(case when rg <= 3 then gain / log2(rg + 1) else 0 end), 0), 0) as b from r group by 1),
u as (select r, q, a - b as t, {_DRAW.format(s=17, g='q')} as u from n, (select unnest(range(1, 51)) as r)), d as (select r, case when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 else 5 end as times, t from u),
e as (select sum(times * t) / nullif(sum(times), 0) as m from d group by r), i as (select quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from e)
select round(avg(a), 6) as ndcg_a, round(avg(b), 6) as ndcg_b, round(avg(a - b), 6) as delta, round(any_value(low), 6) as low, round(any_value(high), 6) as high, case when any_value(low) > 0 then 'a' when any_value(high) < 0 then 'b' else 'tie' end as verdict from n, i""")
def ndcg_comparison(spark, sf):
    """A model's ranking of each order's lines against a rule's, with the interval of the difference over orders."""
    part = (c("l_partkey") * 7) % 31 / 10.0
    g = read(spark, sf, "lineitem").select(c("l_orderkey").alias("q"), ((c("l_partkey") * 10 + c("l_linenumber")) * 100 + c("l_quantity").cast("bigint")).alias("item"), (F.pow(F.lit(2.0), c("l_quantity") % 5) - 1).alias("gain"), ((c("l_partkey") * 13) % 97 / 97.0).alias("sa"), (c("l_quantity") % 5 + part).alias("sb"))
    found = comparison.ndcg_difference(g, "q", "item", "gain", "sa", "sb", 3, 50, 17)
    return found.select(*[F.round(x, 6).alias(x) for x in found.columns[:-1]], "verdict")


_PLACES = "f as (select c_custkey as k, c_acctbal / 1000 as a, coalesce(avg(o_totalprice), 0) / 50000 as b, coalesce(count(o_orderkey), 0) / 4.0 as n, c_custkey % 5 = 0 and c_custkey % 15 <> 0 as test, c_custkey % 75 = 5 as odd from customer left join orders on o_custkey = c_custkey group by 1, 2, 5, 6), g as (select k, test, a + case when odd then 3 else 0 end as a, b, n from f)"


def places(spark, sf):
    """Customers as points: balance, mean price and number of their orders; a few of those to be tested are put elsewhere."""
    orders = read(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("b"), F.count("*").alias("n"))
    k = c("c_custkey")
    joined = read(spark, sf, "customer").join(orders, k == c("o_custkey"), "left")
    point = F.array(c("c_acctbal") / 1000 + F.when(k % 75 == 5, 3).otherwise(0), F.coalesce(c("b"), F.lit(0.0)) / 50000, F.coalesce(c("n"), F.lit(0)) / 4.0)
    return joined.select(((k % 5 == 0) & (k % 15 != 0)).alias("test"), point.alias("x"))


@query(f"""with {_PLACES}, d as (select i.k, i.test, min(sqrt((i.a - j.a) ** 2 + (i.b - j.b) ** 2 + (i.n - j.n) ** 2)) as d from g i join g j on not j.test and i.k <> j.k group by 1, 2), l as (select quantile_cont(d, 0.95) as l from d where not test)
select round(any_value(l), 6) as "limit", count(*) as n, count(*) filter (d > l) as beyond, round((count(*) filter (d > l) - count(*) * 0.05) / sqrt(count(*) * 0.05 * 0.95), 6) as z from d, l where test""")
def extrapolation_test(spark, sf):
    """Whether tested customers lie outside of what a model would have been trained on."""
    from tidemark.operators import neighbours

    p = places(spark, sf)
    found = neighbours.extrapolation(p.where("not test"), p.where("test"))
    return found.select(F.round("limit", 6).alias("limit"), "n", "beyond", F.round("z", 6).alias("z"))


FEATURES = ["size", "marks", "wide"]


def traits(spark, sf):
    """Labelled documents with three numbers of their texts, and a fold of their source by hash."""
    from tidemark.functions.hashing import bucket

    text = F.coalesce(c("text"), F.lit(""))
    # whole runs are taken out at once, which is the same number of characters in fewer matches
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))
    docs = read(spark, sf, "documents").select("doc_id", "source", F.log1p(F.length(text)).alias("size"), (count(r"[^A-Za-z \n]") / (F.length(text) + 1)).alias("marks"), (count("[A-Z]") / (F.length(text) + 1)).alias("wide"))
    return read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "source", bucket(c("source"), 5).cast("int").alias("fold"), c("quality").alias("y"), *FEATURES)


_TRAITS = "t as (select l.doc_id, d.source, ('0x' || substr(sha256(d.source), 1, 8))::bigint % 5 as fold, l.quality as y, ln(1 + length(coalesce(text, ''))) as size, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^A-Za-z \\n]', '', 'g'))) / (length(coalesce(text, '')) + 1) as marks, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g'))) / (length(coalesce(text, '')) + 1) as wide from labels l join documents d on d.doc_id = l.doc_id)"


def _moments(keys: str, rows: str) -> str:
    """SQL of the means and variances by class of rows, and of the rows together."""
    per = ", ".join(f"avg({f}) filter (y = {k}) as {f}_m{k}, var_pop({f}) filter (y = {k}) as {f}_v{k}" for f in FEATURES for k in (0, 1))
    return f"select {keys}count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1, {per}, {', '.join(f'var_pop({f}) as {f}_v' for f in FEATURES)} from {rows}"


def _odds(shrink: str) -> str:
    """SQL of a row's score by a model `m`."""
    var = lambda f, k: f"greatest((1 - {shrink}) * m.{f}_v{k} + {shrink} * m.{f}_v, 1e-9 * m.{f}_v)"
    part = lambda f, k: f"((x.{f} - m.{f}_m{k}) ** 2 / (2 * {var(f, k)}) + ln({var(f, k)}) / 2)"
    return "round(ln(m.n1 / m.n0) + " + " + ".join(f"{part(f, 0)} - {part(f, 1)}" for f in FEATURES) + ", 9)"


def _auc(keys: str, rows: str) -> str:
    """SQL of the AUC by keys of rows (keys, y, p)."""
    over = f"partition by {keys}" if keys else ""
    ranked = f"select *, rank() over ({over} order by p) + (count(*) over ({'partition by ' + keys + ', p' if keys else 'partition by p'}) - 1) / 2.0 as rk from {rows}"
    return f"select {keys + ', ' if keys else ''}case when sum(y) > 0 and sum(y) < count(*) then (sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) end as auc, count(*) as n from ({ranked}) {'group by ' + keys if keys else ''}"


@query(f"""with {_TRAITS}, g as (select unnest([0.0, 0.3, 0.9]) as shrink), f as (select distinct fold from t), o as (select a.fold as outer_, b.fold as inner_ from f a join f b on a.fold <> b.fold),
tr as (select outer_, inner_, t.* from o join t on t.fold not in (outer_, inner_)), mi as ({_moments('outer_, inner_, ', 'tr group by 1, 2')}), si as (select m.outer_, m.inner_, shrink, x.y, {_odds('shrink')} as p from mi m join t x on x.fold = m.inner_, g),
ai as ({_auc('outer_, inner_, shrink', 'si')}), b as (select outer_, shrink, round(avg(auc), 12) as inner_auc from ai group by 1, 2), h as (select *, row_number() over (partition by outer_ order by inner_auc desc, shrink) as r from b),
tt as (select a.fold as outer_, t.* from f a join t on t.fold <> a.fold), mo as ({_moments('outer_, ', 'tt group by 1')}), so as (select m.outer_, x.y, {_odds('h.shrink')} as p from mo m join t x on x.fold = m.outer_ join h on h.outer_ = m.outer_ and h.r = 1), ao as ({_auc('outer_', 'so')})
select h.outer_ as fold, shrink, round(inner_auc, 6) as inner_auc, round(auc, 6) as auc from h left join ao using (outer_) where r = 1""")
def nested_folds(spark, sf):
    """Each fold's best shrinkage by inner folds, and its AUC on the fold itself."""
    from tidemark.operators import folds

    found = folds.nested(traits(spark, sf), "fold", FEATURES, "y", 5, [0.0, 0.3, 0.9])
    return found.select(c("outer").alias("fold"), "shrink", F.round("inner_auc", 6).alias("inner_auc"), F.round("auc", 6).alias("auc"))


@query(f"""with {_TRAITS}, s as (select distinct source as held from t), tt as (select held, t.* from s join t on t.source <> held), m as ({_moments('held, ', 'tt group by 1')}), sc as (select m.held, x.y, {_odds('0.1')} as p from m join t x on x.source = m.held), a as ({_auc('held', 'sc')})
select held as source, n, round(auc, 6) as auc from a""")
def fitted_leave_one_group_out(spark, sf):
    """The AUC on each source of a model that has not seen it."""
    from tidemark.operators import folds

    return folds.leave_one_group_out(traits(spark, sf), "source", FEATURES, "y", 0.1).select("source", "n", F.round("auc", 6).alias("auc"))


def _moved(feature: str, seed: int) -> str:
    """SQL of the test rows with a feature's column permuted as the operator does."""
    rank = lambda s: f"row_number() over (order by ('0x' || substr(sha256('{s}|' || doc_id), 1, 8))::bigint) as place"
    kept_ = ", ".join(f"e.{f}" if f != feature else "v.value as " + f for f in FEATURES)
    return f"select '{feature}' as feature, {seed} as r, e.y, {kept_} from (select *, {rank(seed)} from e) e join (select {feature} as value, {rank(seed + 1)} from e) v using (place)"


@query(f"""with {_TRAITS}, tr as (select * from t where fold <> 0), e as (select * from t where fold = 0), m as ({_moments('', 'tr')}), b as (select x.y, {_odds('0.1')} as p from e x, m), base as ({_auc('', 'b')}),
u as ({' union all '.join(_moved(f, 100 + 2 * (k * 2 + r)) for k, f in enumerate(FEATURES) for r in range(2))}), sc as (select feature, r, x.y, {_odds('0.1')} as p from u x, m), a as ({_auc('feature, r', 'sc')})
select feature, round(any_value(base.auc), 6) as auc, round(avg(a.auc), 6) as permuted_auc, round(any_value(base.auc) - avg(a.auc), 6) as importance from a, base group by 1""")
def permutation_importance(spark, sf):
    """What each number of the texts adds, on sources that the model has not seen."""
    from tidemark.operators import folds

    t = traits(spark, sf)
    found = folds.permutation_importance(t.where("fold <> 0"), t.where("fold = 0"), "doc_id", FEATURES, "y", 2, 100, 0.1)
    return found.select("feature", *[F.round(x, 6).alias(x) for x in ("auc", "permuted_auc", "importance")])


@query()
def conditional_importance(spark, sf):
    """The same with columns that keep what the others tell of them, by a forest."""
    from tidemark.operators import folds

    t = traits(spark, sf)
    return folds.conditional_importance(t.where("fold <> 0"), t.where("fold = 0"), "doc_id", FEATURES, "y", 2, 100, 0.1)


@query()
def stratified_group_folds(spark, sf):
    """Sources dealt to five folds that are alike in rows and in labels."""
    from tidemark.operators import folds

    return folds.stratified_groups(traits(spark, sf), "source", "y", 5)


def _mixed(seed: int, r: int) -> str:
    """SQL of all rows with labels permuted as the operator does."""
    rank = lambda s: f"row_number() over (order by ('0x' || substr(sha256('{s}|' || doc_id), 1, 8))::bigint) as place"
    return f"select {r} as r, e.fold, v.y, {', '.join('e.' + f for f in FEATURES)} from (select *, {rank(seed)} from t) e join (select y, {rank(seed + 1)} from t) v using (place)"


@query(f"""with {_TRAITS}, u as ({' union all '.join(_mixed(300 + 2 * r, r) for r in range(4))}), tr as (select * from u where fold <> 0), m as ({_moments('r, ', 'tr group by 1')}), sc as (select x.r, x.y, {_odds('0.1')} as p from u x join m on m.r = x.r where x.fold = 0), a as ({_auc('r', 'sc')})
select r as round, round(auc, 6) as auc from a""")
def shuffled_target(spark, sf):
    """A model of labels that mean nothing should do no better than chance."""
    from tidemark.operators import folds

    return folds.shuffled_target(traits(spark, sf), c("fold") == 0, "doc_id", FEATURES, "y", 4, 300, 0.1).select("round", F.round("auc", 6).alias("auc"))


@query("""with e as (select vec_id, label % 3 as y, exp(((vec_id * 7) % 11) / 5.0) as a, exp(((vec_id * 3) % 13) / 6.0 + (label % 3 = 1)::int) as b, exp((label % 3 = 2)::int * 1.5) as c from embeddings), l as (select unnest([0, 1, 2]) as label, unnest([a, b, c]) / (a + b + c) as p, y from e),
r as (select label, p, (label = y)::int as y, greatest(1, least(10, ceil(p * 10))) as bin from l), b as (select label, bin, count(*) as n, avg(y) as a, avg(p) as c, sum((p - y) ** 2) as s from r group by 1, 2), k as (select label, sum(n) as n, sum(n * abs(a - c)) / sum(n) as ece, sum(s) / sum(n) as brier from b group by 1)
select label, n, round(ece, 9) as ece, round(brier, 9) as brier from k union all select null, sum(n), round(avg(ece), 9), round(avg(brier), 9) from k""")
def class_calibration(spark, sf):
    """Each of three classes against the rest, and their means."""
    from tidemark.operators import statistics

    y, k = c("label") % 3, c("vec_id")
    raw = F.array(F.exp((k * 7) % 11 / 5.0), F.exp((k * 3) % 13 / 6.0 + (y == 1).cast("int")), F.exp((y == 2).cast("int") * 1.5))
    rows = read(spark, sf, "embeddings").select(y.alias("own"), raw.alias("raw")).select("own", F.posexplode(F.transform("raw", lambda x: x / (F.col("raw")[0] + F.col("raw")[1] + F.col("raw")[2]))).alias("label", "p"))
    found = statistics.class_calibration(rows.select("label", "p", (c("own") == c("label")).cast("int").alias("y")), "label", "p", "y", 10)
    return found.select("label", "n", F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))
