"""Further queries of the surface: lookups, parsing, summaries, samplers, validators (X, A, J, N, O, S, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, numbers
from tidemark.operators import labelling, neighbours, rules, statistics, store
from tidemark.operators import relational as rel
from tidemark.plans.evaluation import _FUNCTIONS, _LABELS, _LONG, _SCORED, label_matrix, scored
from tidemark.plans.registry import query
from tidemark.plans.security import _CHECKS, flows_cte
from tidemark.sources.tables import FLOWS, read, verdicts


@query("select page_id, coalesce(try_cast(nullif(regexp_extract(url, ':([0-9]+)', 1), '') as integer), case when url like 'https:%' then 443 else 80 end) as port from pages")
def url_port_extract(spark, sf):
    port = F.regexp_extract("url", ":([0-9]+)", 1).try_cast("int")
    return read(spark, sf, "pages").select("page_id", F.coalesce(port, F.when(F.col("url").startswith("https:"), 443).otherwise(80)).alias("port"))


@query("select doc_id, substr(text, 3, 5) as part, least(length(text), 7) - 2 as size from documents where length(text) > 2")
def byte_range_slice(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").where(F.length(t) > 2).select("doc_id", F.substring(t, 3, 5).alias("part"), (F.least(F.length(t), F.lit(7)) - 2).cast("bigint").alias("size"))


@query("""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n, doc_id % 6 as k, doc_id % 97 as a from documents),
r as (select *, case k when 0 then a when 1 then 2 * a when 2 then greatest(n - a, 0) when 3 then 0 when 4 then 5000000 end as f, case k when 0 then least(a + 20, n - 1) when 3 then 0 else n - 1 end as l, not (k = 2 and a = 0) and k <> 5 as ok from d)
select doc_id, case when ok and f <= l then f end as first, case when ok and f <= l then l end as last, case when ok and f <= l then substr(h, 2 * f + 1, 2 * (l - f + 1)) end as part from r""")
def http_ranges(spark, sf):
    """What range headers ask of a text's bytes, clamped to what is there."""
    a = F.col("doc_id") % 97
    body = F.coalesce("text", F.lit("")).cast("binary")
    forms = ["bytes=%d-%d", "bytes=%d-", "bytes=-%d", "bytes=0-0", "bytes=5000000-", "bytes=0-1,3-4"]
    values = [F.format_string(forms[0], a, a + 20), F.format_string(forms[1], 2 * a), F.format_string(forms[2], a), *map(F.lit, forms[3:])]
    rows = read(spark, sf, "documents").select("doc_id", body.alias("body"), F.element_at(F.array(*values), (F.col("doc_id") % 6 + 1).cast("int")).alias("header"))
    asked = rows.withColumn("span", store.byte_range(F.col("header"), F.octet_length("body").cast("bigint")))
    return asked.select("doc_id", "span.first", "span.last", F.hex(store.sliced(F.col("body"), F.col("span"))).alias("part"))


@query("select p_partkey, regexp_replace(p_brand, '#[0-9]+$', '') as base, sha256(concat_ws('|', p_brand, p_type, p_size)) as key from part")
def composite_keys(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "#[0-9]+$", "").alias("base"), hashing.composite(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("key"))


@query("with p as (select vec_id, (vec_id % 101) / 100.0 as p from embeddings), q as (select vec_id, greatest(1e-6, least(1 - 1e-6, p)) as q, p from p) select vec_id, round(greatest(0.01, least(0.99, 1 / (1 + exp(-(ln(q / (1 - q)) + ln(0.3 / 0.7) - ln(0.87 / 0.13)))))), 9) as corrected, round(greatest(p, 1 - p) * 100, 6) as confidence, round(0.5 * tanh((p * 10 - 5) / 3) + 0.3 * tanh(p) + 0.2 * tanh(2 * (p - 0.5)), 9) as hybrid from q")
def score_transforms(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", ((F.col("vec_id") % 101) / 100.0).alias("p"))
    p = F.col("p")
    return v.select("vec_id", F.round(numbers.prior_corrected(p, 0.87, 0.3), 9).alias("corrected"), F.round(F.greatest(p, 1 - p) * 100, 6).alias("confidence"), F.round(numbers.hybrid_anomaly(p * 10, p, p), 9).alias("hybrid"))


@query(f"{flows_cte()}, j as (select l.risk_level, l.posture_score, l.risk_score, f.app_protocol, f.starttls_mode, f.version, f.strength from levels l join flows f using (k)) select 'risk_level' as dimension, risk_level as value, count(*) as n from j group by 2 union all select 'app_protocol', app_protocol, count(*) from j group by 2 union all select 'starttls_mode', starttls_mode, count(*) from j group by 2 union all select 'version', version, count(*) from j group by 2")
def fleet_summary(spark, sf):
    a = rules.assess(verdicts(spark, sf)).select("risk_level", "app_protocol", "starttls_mode", F.col("tls.version").alias("version"))
    names = ["risk_level", "app_protocol", "starttls_mode", "version"]
    long = a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query(f"with flows as ({FLOWS}), g as (select unnest(['smtp', 'secure', 'legacy', 'all']) as grp) select g.grp, case when version = 'TLS1.3' then 'new' when version = 'TLS1.2' then 'current' else 'old' end as bucket, count(*) as n from flows join g on (g.grp = 'smtp' and app_protocol = 'smtp') or (g.grp = 'secure' and port in (465, 993, 995)) or (g.grp = 'legacy' and port in (25, 143)) or g.grp = 'all' group by 1, 2")
def adoption_clusters(spark, sf):
    c = F.col
    member = F.array(F.when(c("app_protocol") == "smtp", "smtp"), F.when(c("port").isin(465, 993, 995), "secure"), F.when(c("port").isin(25, 143), "legacy"), F.lit("all"))
    bucket = F.when(c("tls.version") == "TLS1.3", "new").when(c("tls.version") == "TLS1.2", "current").otherwise("old")
    return verdicts(spark, sf).select(F.explode(F.filter(member, lambda x: x.isNotNull())).alias("grp"), bucket.alias("bucket")).groupBy("grp", "bucket").agg(F.count("*").alias("n"))


@query(f"{flows_cte()} select check_name, custkey, min(flow_id) as flow_id, count(*) as repeats from findings where severity in ('Critical', 'High') group by 1, 2")
def vulnerabilities_deduplicated(spark, sf):
    found = rules.exploded(rules.assess(verdicts(spark, sf)), rules.serious, "custkey", "flow_id")
    return found.groupBy(F.col("f.check").alias("check_name"), "custkey").agg(F.min("flow_id").alias("flow_id"), F.count("*").alias("repeats"))


@query(f"with flows as ({FLOWS}) select flow_id, case when starttls_mode = 'stripped' then 'stripped' when starttls_mode = 'upgrade' and handshake then 'upgraded' when starttls_mode = 'implicit' then 'implicit' when not advertised then 'never offered' else 'not used' end as verdict from flows")
def upgrade_verdicts(spark, sf):
    c = F.col
    v = F.when(c("starttls_mode") == "stripped", "stripped").when((c("starttls_mode") == "upgrade") & c("tls.handshake_success"), "upgraded").when(c("starttls_mode") == "implicit", "implicit").when(~c("starttls_advertised"), "never offered").otherwise("not used")
    return verdicts(spark, sf).select("flow_id", v.alias("verdict"))


@query("select a.vec_id, round(min(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i] - b.embedding[i], 2))))), 5) as distance from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id group by 1")
def nearest_distance(spark, sf):
    """Of every twentieth vector the nearest other one, among all; pivots and shells leave out what can't be nearer."""
    v = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    asked = v.where("vec_id % 20 = 0")
    return asked.join(neighbours.apart(v, asked), "x").select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"with {_SCORED}, b as (select greatest(1, least(10, ceil(p * 10))) as bin, count(*) as n, avg(y) as acc, avg(p) as conf from s group by 1), e as (select sum(n * abs(acc - conf)) / sum(n) as ece, sum(n) as n from b) select round(greatest(0, ece - least(0.15 * sqrt(10) * pow(n, -1.0 / 3), 0.8 * ece)), 9) as ece from e")
def ece_debiased(spark, sf):
    s = scored(spark, sf)
    e = statistics.calibration_error(s, "p", "y", 10).join(F.broadcast(s.agg(F.count("*").alias("n"))), F.lit(True))
    return e.select(F.round(F.greatest(F.lit(0.0), F.col("ece") - F.least(0.15 * F.sqrt(F.lit(10.0)) * F.pow("n", F.lit(-1.0 / 3)), 0.8 * F.col("ece"))), 9).alias("ece"))


_TRAINED = "m0 as (select *, cast(floor((row_number() over (order by k) - 1) * 5 / count(*) over ()) as integer) as fold from m), u as (" + " union all ".join(f"select k, fold, '{f}' as f, {f} as v from m0 where {f} <> -1" for f in _FUNCTIONS) + "), j as (select t.out, x.f as a, y.f as b, count(*) as n, avg(cast((2 * x.v - 1) * (2 * y.v - 1) as double)) as e from (select unnest(range(5)) as out) t join u x on x.fold <> t.out join u y on x.k = y.k and x.f < y.f group by 1, 2, 3), p as (select out, a, b, e from j where n >= 10 and e <> 0 union all select out, b, a, e from j where n >= 10 and e <> 0), al as (select ab.out, ab.a as name, median(greatest(0.51, least(0.99, 0.5 * (1 + sqrt(abs(ab.e * ac.e / bc.e)))))) as alpha from p ab join p ac on ab.out = ac.out and ab.a = ac.a and ab.b < ac.b join p bc on bc.out = ab.out and bc.a = ab.b and bc.b = ac.b group by 1, 2)"


@query(f"with {_LABELS}, {_TRAINED}, w as (select u.k, round(sum((2 * v - 1) * greatest(-2, least(2, ln(coalesce(alpha, 0.6) / (1 - coalesce(alpha, 0.6)))))), 9) as t from u left join al on al.out = u.fold and al.name = u.f group by 1) select m0.k, m0.fold, case when t > 0 then 1 when t < 0 then 0 else -1 end as vote from m0 left join w on w.k = m0.k")
def vote_cross_fit(spark, sf):
    """Contiguous folds by key; each fold is voted on with accuracies from the others."""
    m = statistics.running(label_matrix(spark, sf).withColumn("one", F.lit(1)), "k", ["one"], [])
    folded = m.withColumn("fold", F.floor((F.col("upto_one") - 1) * 5 / F.col("all_one")).cast("int"))
    return labelling.cross_fit(folded, _FUNCTIONS, "fold", 5).select("k", "fold", "vote")


@query("select c_custkey, lexical, row_number() over (order by lexical, c_custkey) as place from (select c_custkey, lpad(substr(c_name, 10), 3, '0') as lexical from customer)")
def lexical_suffix_order(spark, sf):
    key = F.lpad(F.substring("c_name", 10, 100), 3, "0")
    return rel.placed(read(spark, sf, "customer").select("c_custkey", key.alias("lexical")), [F.col("lexical"), F.col("c_custkey")])


@query("select vec_id, row_number() over (order by sha256(cast(vec_id as varchar)), vec_id) as place from embeddings")
def hashed_order(spark, sf):
    order = F.sha2(F.col("vec_id").cast("string"), 256)
    return rel.placed(read(spark, sf, "embeddings").select("vec_id"), [order, F.col("vec_id")])


@query("with w as (select n_nationkey as i, 1 + n_nationkey % 7 as weight from nation), c as (select i, sum(weight) over (order by i) - weight as low, sum(weight) over (order by i) as high, sum(weight) over () as total from w), d as (select range as draw, ('0x' || substr(sha256('5|' || range), 1, 8))::bigint / 4294967296.0 as u from range(0, 500)) select draw, i from d join c on u * total >= low and u * total < high")
def weighted_draws(spark, sf):
    w = read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (1 + F.col("n_nationkey") % 7).alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("i"))
    c = w.select("i", (upto - F.col("weight")).alias("low"), upto.alias("high"), F.sum("weight").over(Window.partitionBy()).alias("total"))
    d = spark.range(500).select(F.col("id").alias("draw"), hashing.uniform(F.lit(5), F.col("id")).alias("u"))
    return d.join(F.broadcast(c), (F.col("u") * F.col("total") >= F.col("low")) & (F.col("u") * F.col("total") < F.col("high"))).select("draw", "i")


_NAMES = ", ".join(f"('{name}')" for name, *_ in _CHECKS)


@query(f"{flows_cte()}, names(check_name) as (values {_NAMES}) select c.check_name, l.flow_id, coalesce(f.severity, 'none') as severity from levels l cross join names c left join findings f on f.k = l.k and f.check_name = c.check_name")
def check_matrix(spark, sf):
    """Every flow by every check of the registry, a fixed list, silent ones too."""
    by_name = F.map_from_entries(F.transform("findings", lambda f: F.struct(f["check"], f["severity"])))
    told = rules.assess(verdicts(spark, sf)).select("flow_id", by_name.alias("by_name"))
    names = F.array(*[F.lit(k.name) for k in rules.registry()])
    return told.select("flow_id", "by_name", F.explode(names).alias("check_name")).select("check_name", "flow_id", F.coalesce(F.try_element_at("by_name", F.col("check_name")), F.lit("none")).alias("severity"))
