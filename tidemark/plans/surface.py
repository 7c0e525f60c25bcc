"""The query surface over flows: predicates, sort orders, projections, lookups, aggregates with defaults (F, O, P, J, A, X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, names
from tidemark.functions.tls import lookup
from tidemark.operators import relational as rel
from tidemark.operators import rules
from tidemark.plans.registry import query
from tidemark.plans.security import flows_cte
from tidemark.sources.tables import FLOWS, flow_attributes, read, verdicts

c = F.col

#: Names of environments and families as captures carry them, from the key; some are jitter variants or locked.
_NAMED = f"named as (select f.*, case when k % 23 = 0 then 'locked-' || k when k % 11 = 0 then 'jitter-0' || (k % 6) || '-' || k else 'family-' || k end as name, case when k % 3 = 0 then null else 'env-' || port || case when k % 5 = 0 then '-jitter' else '' end || case when k % 7 = 0 then '-buf' || (k % 300) else '' end || '-' || starttls_mode end as env, k % 11 = 0 as jitter_flag from ({FLOWS}) f)"


def named(spark, sf) -> DataFrame:
    k = c("k").cast("string")
    name = F.when(c("k") % 23 == 0, F.concat(F.lit("locked-"), k)).when(c("k") % 11 == 0, F.concat(F.lit("jitter-0"), (c("k") % 6).cast("string"), F.lit("-"), k)).otherwise(F.concat(F.lit("family-"), k))
    env = F.when(c("k") % 3 != 0, F.concat(F.lit("env-"), c("port").cast("string"), F.when(c("k") % 5 == 0, "-jitter").otherwise(""), F.when(c("k") % 7 == 0, F.concat(F.lit("-buf"), (c("k") % 300).cast("string"))).otherwise(""), F.lit("-"), c("starttls_mode")))
    return flow_attributes(spark, sf).withColumns({"name": name, "env": env, "jitter_flag": c("k") % 11 == 0})


@query(f"{flows_cte()}, {_NAMED} select n.flow_id, l.risk_level = 'Critical' as at_level, regexp_matches(n.name, '^family-[0-9]+$') and not contains(n.name, 'jitter') as is_family, n.jitter_flag or contains(n.name, 'jitter') or coalesce(contains(n.env, 'jitter'), false) as is_jitter, not contains(n.name, 'jitter-04') and not contains(n.name, 'jitter-05') as trains, exists (select 1 from findings f where f.k = n.k) or n.pre_len is not null or n.version <> 'unknown' or n.starttls_mode in ('upgrade', 'implicit') or coalesce(n.leaf, false) or n.ja4_rarity is not null as ran, n.env is not null and ('0x' || substr(sha256(n.env), 1, 8))::bigint % 3 = 0 as in_d1 from named n join levels l using (k)")
def flow_predicates(spark, sf):
    """One pass over flows, a column for each predicate."""
    a = rules.assess(verdicts(spark, sf)).select("k", "risk_level", (F.size("findings") > 0).alias("found"))
    n = named(spark, sf).join(a, "k")
    jitter = c("jitter_flag") | c("name").contains("jitter") | F.coalesce(c("env").contains("jitter"), F.lit(False))
    ran = c("found") | c("pre_len").isNotNull() | (c("version") != "unknown") | c("starttls_mode").isin("upgrade", "implicit") | F.coalesce(c("leaf"), F.lit(False)) | c("ja4_rarity").isNotNull()
    return n.select("flow_id", (c("risk_level") == "Critical").alias("at_level"), (c("name").rlike("^family-[0-9]+$") & ~c("name").contains("jitter")).alias("is_family"), jitter.alias("is_jitter"), (~c("name").contains("jitter-04") & ~c("name").contains("jitter-05")).alias("trains"), ran.alias("ran"), F.coalesce(hashing.bucket(c("env"), 3) == 0, F.lit(False)).alias("in_d1"))


@query(f"{flows_cte()}, {_NAMED} select n.flow_id from named n join levels l using (k) where (contains(lower(n.name), 'mily-1') or contains(lower(coalesce(n.env, '')), 'mily-1') or contains(lower(n.app_protocol), 'mily-1') or contains(lower(n.version), 'mily-1') or contains(lower(n.cipher_suite), 'mily-1')) and l.risk_level = 'Critical' and n.version = 'TLS1.2'")
def faceted_filter(spark, sf):
    """a search over five columns and facets; 'All' is no facet."""
    n = named(spark, sf).join(rules.assess(verdicts(spark, sf)).select("k", "risk_level"), "k")
    keep = rel.all_of(rel.contains_any(["name", "env", "app_protocol", "version", "cipher_suite"], "MILY-1"), rel.equals("risk_level", "Critical"), rel.equals("version", "TLS1.2"), rel.equals("starttls_mode", "All"))
    return n.where(keep).select("flow_id")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P')")
def status_filter(spark, sf):
    """statuses beside the known ones are ignored."""
    return read(spark, sf, "orders").where(rel.one_of("o_orderstatus", ["F", "P", "bogus"], ["F", "O", "P"])).select("o_orderkey")


_LEVEL_OR = "coalesce(case when k % 13 = 0 then null else risk_level end, 'Low')"


@query(f"{flows_cte()} select {_LEVEL_OR} as risk_level, count(*) as n, round(avg(coalesce(case when k % 7 = 0 then null else posture_score end, 85)), 1) as avg_posture from levels group by 1")
def levels_with_defaults(spark, sf):
    """A missing level counts as Low, a missing posture as 85."""
    a = rules.assess(verdicts(spark, sf)).select(F.when(c("k") % 13 != 0, c("risk_level")).alias("level"), F.when(c("k") % 7 != 0, c("posture_score")).alias("posture"))
    return a.groupBy(F.coalesce("level", F.lit("Low")).alias("risk_level")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("posture", F.lit(85))), 1).alias("avg_posture"))


@query(f"with f as ({FLOWS}) select app_protocol, coalesce(nullif(version, 'unknown'), 'TLS1.2') as version, coalesce(nullif(cipher_suite, 'none'), 'unknown') as cipher, count(*) as n from f group by 1, 2, 3")
def protocols_with_defaults(spark, sf):
    """A05."""
    f = flow_attributes(spark, sf)
    return f.groupBy("app_protocol", F.coalesce(F.nullif(c("version"), F.lit("unknown")), F.lit("TLS1.2")).alias("version"), F.coalesce(F.nullif(c("cipher_suite"), F.lit("none")), F.lit("unknown")).alias("cipher")).agg(F.count("*").alias("n"))


@query(f"{flows_cte()} select 'known' as asked, count(*) as cnt, avg(posture_score) as avg_posture from levels where flow_id = 'family-7' union all select 'unknown', count(*), avg(posture_score) from levels where flow_id = 'nobody'")
def metrics_of_a_flow(spark, sf):
    """Of an unknown flow the count is 0 and the mean null."""
    a = rules.assess(verdicts(spark, sf))
    of = lambda asked, key: a.where(c("flow_id") == key).agg(F.lit(asked).alias("asked"), F.count("*").alias("cnt"), F.avg("posture_score").alias("avg_posture"))
    return of("known", "family-7").union(of("unknown", "nobody"))


_TABLES = ["customer", "events", "lineitem", "orders", "part", "supplier"]


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _TABLES))
def table_row_counts(spark, sf):
    """A07, K12."""
    return reduce(DataFrame.union, [read(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES])


_LINE = "case event_type when 'view' then '220 mx.example ready' when 'click' then '* OK imap ready' when 'purchase' then '+OK pop ready' when 'error' then 'a1 STARTTLS' else 'noise' end"


@query(f"with l as (select user_id, event_id, {_LINE} as line from events), b as (select user_id, event_id, line, case when contains(line, '220') then '220' when contains(line, '* OK') then '* OK' when contains(line, '+OK') then '+OK' end as banner from l) select user_id, case when bool_or(banner = '220') then '220' else arg_min(banner, event_id) filter (where banner is not null) end as banner, bool_or(contains(line, 'STARTTLS') or contains(line, 'STLS')) as upgrade_seen from b group by 1")
def banners(spark, sf):
    """The greeting of each flow, of which 220 goes before others, and whether an upgrade keyword is seen."""
    line = lookup({"view": "220 mx.example ready", "click": "* OK imap ready", "purchase": "+OK pop ready", "error": "a1 STARTTLS"}, c("event_type"))
    lines = read(spark, sf, "events").select("user_id", "event_id", F.coalesce(line, F.lit("noise")).alias("line"))
    b = lines.withColumn("banner", names.banner(c("line")))
    first = F.min_by(c("banner"), F.when(c("banner").isNotNull(), c("event_id")))
    return b.groupBy("user_id").agg(F.when(F.bool_or(c("banner") == "220"), "220").otherwise(first).alias("banner"), F.bool_or(names.upgrade_keyword(c("line"))).alias("upgrade_seen"))


@query(f"{flows_cte()} select case when k % 4 = 0 then case risk_level when 'Low' then 'allow' when 'Medium' then 'flag' when 'High' then 'quarantine' else 'block' end else 'flag' end as action, count(*) as n from levels group by 1")
def policy_distribution(spark, sf):
    """The policy's action, or what the level says where there is none."""
    a = rules.assess(verdicts(spark, sf)).withColumn("given", F.when(c("k") % 4 != 0, "flag"))
    derived = lookup({"Low": "allow", "Medium": "flag", "High": "quarantine", "Critical": "block"}, c("risk_level"))
    return a.groupBy(F.coalesce("given", derived).alias("action")).agg(F.count("*").alias("n"))


@query(f"with f as ({FLOWS}) select port, count(*) as n, round(avg(coalesce(case when k % 3 = 0 then null else cast(k % 50 as double) / 50 end, case when port in (465, 993, 995) then 1.0 else 0.897 end)), 6) as coverage from f group by 1")
def coverage_by_port(spark, sf):
    """A25."""
    f = flow_attributes(spark, sf).withColumn("coverage", F.when(c("k") % 3 != 0, (c("k") % 50).cast("double") / 50))
    usual = F.when(c("port").isin(465, 993, 995), 1.0).otherwise(0.897)
    return f.groupBy("port").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("coverage", usual)), 6).alias("coverage"))


@query("with g as (select o_custkey, count(*) as n from orders group by 1) select count(*) as groups, min(n) as smallest, max(n) as largest, round(max(n) * 1.0 / min(n), 6) as ratio from g")
def group_size_ratio(spark, sf):
    """A29."""
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


_ANOMALOUS = "case when k % 10 = 0 then false else coalesce(ja4_rarity, 0) > 0.6 end"


@query(f"{flows_cte()} select l.risk_level, count(*) as n, round(avg(case when ({_ANOMALOUS}) = (l.risk_level in ('High', 'Critical')) then 1.0 else 0.0 end), 9) as accuracy, round(avg(case when {_ANOMALOUS} then 1.0 else 0.0 end), 9) as anomaly_rate from levels l join flows using (k) group by 1")
def accuracy_by_level(spark, sf):
    """A34."""
    a = rules.assess(verdicts(spark, sf)).select("risk_level", (F.coalesce("tls.ja4_rarity", F.lit(0.0)) > 0.6).alias("odd"))
    right = c("odd") == c("risk_level").isin("High", "Critical")
    return a.groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 9).alias("accuracy"), F.round(F.avg(c("odd").cast("double")), 9).alias("anomaly_rate"))


_RARITY = "fp as (select k, flow_id, version || '/' || cipher_suite as print from f), freq as (select print, count(*) * 1.0 / (select count(*) from fp) as share from fp group by 1 having count(*) * 25 >= (select count(*) from fp))"


@query(f"with f as ({FLOWS}), {_RARITY} select fp.flow_id, fp.print, case when share is not null then round(greatest(0, least(1, 1 - share)), 9) end as rarity from fp left join freq using (print)")
def fingerprint_rarity(spark, sf):
    """The table of frequent prints has 25 rows at most, so it may be broadcast; a print that it lacks has no rarity."""
    fp = flow_attributes(spark, sf).select("flow_id", F.concat_ws("/", "version", "cipher_suite").alias("print"))
    counts = fp.groupBy("print").agg(F.count("*").alias("n"))
    share = counts.join(F.broadcast(fp.agg(F.count("*").alias("all"))), F.lit(True)).where("n * 25 >= all").select("print", (c("n") / c("all")).alias("share"))
    return names.with_rarity(fp, share)


@query(f"with {_NAMED}, manifest as (select distinct env, port as manifest_port from named where env is not null and k % 2 = 1), fixture as (select distinct on (env) env, 'fx-' || min(k) as fixture_id from named where env is not null and k % 5 = 0 group by env), u as (select n.*, m.manifest_port, x.fixture_id from named n left join manifest m on m.env = n.env left join fixture x on x.env = n.env) select flow_id, coalesce(manifest_port, port) as port, coalesce(fixture_id, case when manifest_port is not null then 'canonical-' || lpad(cast(('0x' || substr(sha256(env), 1, 8))::bigint % 132 as varchar), 3, '0') end) as cluster from u")
def environment_lookup(spark, sf):
    """The manifest's entry, then the fixture; a cluster by hash where only the manifest has it, else none."""
    n = named(spark, sf)
    manifest = n.where("env is not null and k % 2 = 1").select("env", c("port").alias("manifest_port")).distinct()
    fixture = n.where("env is not null and k % 5 = 0").groupBy("env").agg(F.concat(F.lit("fx-"), F.min("k").cast("string")).alias("fixture_id"))
    # flows without an environment meet nothing, so they don't meet in one task either
    met = n.where("env is not null").join(manifest, "env", "left").join(fixture, "env", "left")
    u = met.unionByName(n.where("env is null"), allowMissingColumns=True)
    hashed = F.when(c("manifest_port").isNotNull(), F.format_string("canonical-%03d", hashing.bucket(c("env"), 132)))
    return u.select("flow_id", F.coalesce("manifest_port", "port").alias("port"), F.coalesce("fixture_id", hashed).alias("cluster"))


_SPECS = {
    "family_key": ("starts_with(name, 'locked') desc, case when starts_with(name, 'jitter') then 1 else 0 end, case when regexp_matches(name, '^family-[0-9]+$') then cast(substr(name, 8) as bigint) else 999999999 end, name", lambda: [c("name").startswith("locked").desc(), F.when(c("name").startswith("jitter"), 1).otherwise(0), F.when(c("name").rlike("^family-[0-9]+$"), F.substring("name", 8, 18).cast("bigint")).otherwise(999999999), c("name")]),
    "history_all": ("seen_at desc, flow_id", lambda: [c("seen_at").desc(), c("flow_id")]),
    "reports": ("ja4_rarity desc nulls first, k", lambda: [c("ja4_rarity").desc_nulls_first(), c("k")]),
    "registry": ("days desc nulls last, k", lambda: [c("days").desc_nulls_last(), c("k")]),
    "client": ("coalesce(pre_len, 80), k desc", lambda: [F.coalesce("pre_len", F.lit(80)), c("k").desc()]),
    "severity": ("case version when 'TLS1.0' then 0 when 'TLS1.1' then 1 when 'TLS1.2' then 2 when 'TLS1.3' then 3 else 4 end, k", lambda: [F.coalesce(lookup({"TLS1.0": 0, "TLS1.1": 1, "TLS1.2": 2, "TLS1.3": 3}, c("version")), F.lit(4)), c("k")]),
    "upgrade": ("(starttls_mode = 'stripped') desc, (not advertised) desc, flow_id", lambda: [(c("starttls_mode") == "stripped").desc(), (~c("advertised")).desc(), c("flow_id")]),
}


@query(f"with {_NAMED} " + " union all ".join(f"select '{n}' as spec, k, row_number() over (order by {sql}) as place from named" for n, (sql, _) in _SPECS.items()))
def sort_orders(spark, sf):
    """Every flow's place in each order."""
    n = named(spark, sf)
    return reduce(DataFrame.union, [rel.placed(n.select("k", "name", "seen_at", "flow_id", "ja4_rarity", "days", "pre_len", "version", "starttls_mode", "advertised"), order()).select(F.lit(name).alias("spec"), "k", "place") for name, (_, order) in _SPECS.items()])


@query("select c_custkey from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as r, count(*) over () as n from customer) where r > (ceil(n / 40.0) - 1) * 40")
def last_page(spark, sf):
    """A page beyond the last one is the last."""
    return rel.clamped_page(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), c("c_custkey")], 10**6, 40).select("c_custkey")


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber) as newest, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as oldest from lineitem")
def history_orders(spark, sf):
    """Both directions, as the two stores disagree; nulls come last in both.

    Lines alike in order, number and date are told apart by no order of the SQL: the one that is newer of them is the older one too,
    whatever shuffles and spills make of their order.
    """
    by = lambda *o: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*o))
    line = c("l_linenumber").asc_nulls_last()
    newest = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", by(c("l_shipdate").desc_nulls_last(), line).alias("newest"))
    return newest.select("l_orderkey", "l_linenumber", "newest", by(c("l_shipdate").asc_nulls_last(), line, c("newest")).alias("oldest"))


@query(f"{flows_cte()} select flow_id, strftime(f.seen_at, '%Y-%m-%dT%H:%M:%S') as seen, case when l.k % 4 = 0 then 'derived:' || l.risk_level else 'given' end as policy, '{{\"flow_id\":\"' || flow_id || '\",\"severity\":\"' || l.risk_level || '\"}}' as exported, case when l.k % 50 = 1 then 'Baseline' else 'Family ' || l.k end as shown from levels l join (select k, seen_at from flows) f using (k)")
def documents_projected(spark, sf):
    """An unknown key dropped, ISO times, a policy only where there is none, the export's columns, display names."""
    a = rules.assess(verdicts(spark, sf))
    doc = F.struct(c("flow_id"), c("risk_level").alias("severity"), c("k").alias("family_id")).dropFields("family_id")
    policy = F.coalesce(F.when(c("k") % 4 != 0, "given"), F.concat(F.lit("derived:"), c("risk_level")))
    shown = F.coalesce(F.when(c("k") % 50 == 1, "Baseline"), F.regexp_replace("flow_id", "^family-", "Family "))
    return a.select("flow_id", F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss").alias("seen"), policy.alias("policy"), F.to_json(doc).alias("exported"), shown.alias("shown"))


@query(f"with {_NAMED} select flow_id, case when env is not null and k % 2 = 1 then case port when 25 then 'smtp' when 587 then 'smtp' when 465 then 'smtp' when 993 then 'imap' when 143 then 'imap' else 'pop3' end when contains(coalesce(env, name), '99') then 'imap' else 'smtp' end as protocol, case when k % 6 = 0 then 'form' when contains(coalesce(env, ''), 'implicit') then 'implicit' when contains(coalesce(env, ''), 'stripped') then 'stripped' when advertised and handshake then 'upgrade' when handshake then 'implicit' else 'none' end as mode, try_cast(nullif(regexp_extract(coalesce(env, ''), 'buf([0-9]+)', 1), '') as integer) as buffer, case when k % 4 = 0 then 'query' when k % 4 = 1 then 'header' when regexp_matches(name, '^[a-z]+') then regexp_extract(name, '^[a-z]+') else 'synthetic' end as source from named")
def name_inference(spark, sf):
    """Protocol, mode, buffer size and source, each from the first place that tells it."""
    n = named(spark, sf)
    protocol = F.coalesce(F.when(c("env").isNotNull() & (c("k") % 2 == 1), F.coalesce(names.protocol_of_port(c("port")), F.lit("pop3"))), F.when(F.coalesce("env", "name").contains("99"), "imap"), F.lit("smtp"))
    env = F.coalesce("env", F.lit(""))
    mode = F.coalesce(F.when(c("k") % 6 == 0, "form"), names.mode_in(env), F.when(c("advertised") & c("handshake"), "upgrade"), F.when(c("handshake"), "implicit"), F.lit("none"))
    source = F.coalesce(F.when(c("k") % 4 == 0, "query"), F.when(c("k") % 4 == 1, "header"), F.nullif(F.regexp_extract("name", "^[a-z]+", 0), F.lit("")), F.lit("synthetic"))
    return n.select("flow_id", protocol.alias("protocol"), mode.alias("mode"), names.buffer_size(env).alias("buffer"), source.alias("source"))


_DEDUCE = "greatest(5, 100 - (case when deprecated then 30 else 0 end + case strength when 'weak' then 25 when 'medium' then 10 else 0 end + case when not fs then 15 else 0 end + case when coalesce(expired, false) then 30 else 0 end + case when coalesce(san_match, true) then 0 else 15 end + case when coalesce(self_signed, false) then 10 else 0 end + case when starttls_mode = 'stripped' then 25 else 0 end))"


@query(f"with f as ({FLOWS}), p as (select flow_id, {_DEDUCE} as posture from f) select flow_id, posture, case when posture < 40 then 'Critical' when posture < 60 then 'High' when posture < 80 then 'Medium' else 'Low' end as severity, round(1 - posture / 100.0, 6) as probability from p")
def posture_calculator(spark, sf):
    """A posture from deductions where no assessment is there, within 5 and 100."""
    f = flow_attributes(spark, sf)
    posture = names.posture(f)
    return f.select("flow_id", posture.alias("posture")).withColumns({"severity": F.when(c("posture") < 40, "Critical").when(c("posture") < 60, "High").when(c("posture") < 80, "Medium").otherwise("Low"), "probability": F.round(1 - c("posture") / 100.0, 6)})


@query(f"{flows_cte()} select l.flow_id, max(case when f.check_name = 'Weak sigalg (SHA1/MD5)' or f.check_name like '%RFC9155%' then f.severity end) as sigalg, max(case when f.check_name = 'Hostname mismatch' then f.severity end) as hostname, max(case when f.check_name = '3DES SWEET32' then f.severity end) as sweet32 from levels l join findings f using (k) group by 1")
def check_severities(spark, sf):
    """A check's severity in a flow by its id, its label or its specification."""
    a = rules.assess(verdicts(spark, sf))
    return a.select("flow_id", rules.severity_for("RFC9155").alias("sigalg"), rules.severity_for("Hostname mismatch").alias("hostname"), rules.severity_for("CVE-2016-2183").alias("sweet32"))


@query("with p as (select user_id as flow, event_id as pkt_no, cast(json_extract_string(props, '$.k') as bigint) * 10 + event_id % 7 as seq, 1 + event_id % 50 as len, repeat(chr(cast(97 + event_id % 26 as integer)), cast(1 + event_id % 50 as integer)) as payload from events), r as (select *, coalesce(max(seq + len) over (partition by flow order by seq, pkt_no rows between unbounded preceding and 1 preceding), seq) as reached from p), n as (select *, greatest(0, seq + len - greatest(seq, reached)) as new from r) select flow, coalesce(sum(new), 0)::bigint as bytes, sha256(coalesce(string_agg(right(payload, new), '' order by seq, pkt_no), '')) as digest from n group by 1")
def payload_concat(spark, sf):
    """The new bytes of each flow's segments in order."""
    from tidemark.operators import reassembly

    e = read(spark, sf, "events").select(c("user_id").alias("flow"), c("event_id").alias("pkt_no"), (F.get_json_object("props", "$.k").cast("bigint") * 10 + c("event_id") % 7).alias("seq"), (1 + c("event_id") % 50).alias("len"))
    walked = reassembly.walk(e.withColumn("payload", F.repeat(F.chr(97 + c("pkt_no") % 26), c("len").cast("int"))))
    return reassembly.payloads(walked, "payload").select("flow", c("bytes"), F.sha2("content", 256).alias("digest"))


@query("select vec_id, round(case when s < 0.3 then s / 0.3 * 40 when s < 0.7 then 40 + (s - 0.3) / 0.4 * 40 else 80 + (s - 0.7) / 0.3 * 20 end, 6) as y, row_number() over (order by vec_id) as x from (select vec_id, (vec_id % 101) / 100.0 as s from embeddings)")
def scatter_points(spark, sf):
    """Numbers in order, and a score stretched piece by piece."""
    s = (c("vec_id") % 101) / 100.0
    v = rel.placed(read(spark, sf, "embeddings").select("vec_id"), [c("vec_id")])
    y = F.when(s < 0.3, s / 0.3 * 40).when(s < 0.7, 40 + (s - 0.3) / 0.4 * 40).otherwise(80 + (s - 0.7) / 0.3 * 20)
    return v.select("vec_id", F.round(y, 6).alias("y"), c("place").alias("x"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then case when s_suppkey % 2 = 0 then 'Medium' else 'High' end when s_suppkey % 3 = 1 then null else 'High' end as name_check, s_suppkey % 4 = 0 as has_srv from supplier")
def certificate_names(spark, sf):
    """A name is held against all alternative names, wildcards included; without any the common name counts."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("mx"), c("s_suppkey").cast("string"), F.lit(".mail.example")).alias("host"))
    srv = F.when(c("s_suppkey") % 4 == 0, F.array(F.lit("_smtp._tcp.mail.example"))).otherwise(F.array().cast("array<string>"))
    sans = F.when(c("s_suppkey") % 3 == 0, F.array().cast("array<string>")).when(c("s_suppkey") % 3 == 1, F.array(F.lit("other.example"), F.lit("*.mail.example"))).otherwise(F.array(F.lit("*.example")))
    cn = F.when(c("s_suppkey") % 2 == 0, c("host")).otherwise("else.example")
    return s.select("s_suppkey", names.name_severity(sans, cn, c("host")).alias("name_check"), names.has_srv(F.concat(sans, srv)).alias("has_srv"))


@query(f"with f as ({FLOWS}) select flow_id, sha256(version || '|' || cipher_suite) as jarm, ('0x' || substr(sha256(sha256(version || '|' || cipher_suite) || '|' || app_protocol), 1, 8))::bigint % 132 as bucket, case when k % 1000 < 10 then 'top' || lpad(cast(k as varchar), 4, '0') || '.example' when k % 1000 < 100 then 'mid' || k || '.example' else 'tail' || k || '.example' end as domain, cast(version as varchar) || '/' || strength || '/' || kex as category, case version when 'TLS1.0' then 2 when 'TLS1.1' then 2 when 'TLS1.2' then 1 else 0 end as level_class, case strength when 'strong' then 0.20 when 'medium' then 0.45 when 'weak' then 0.70 else 0.88 end as fixed_probability from f")
def derived_columns(spark, sf):
    """Nested hash buckets, domains by tier, string categories, classes and their fixed probabilities."""
    f = flow_attributes(spark, sf)
    jarm = F.sha2(F.concat_ws("|", "version", "cipher_suite"), 256)
    tier = c("k") % 1000
    domain = F.when(tier < 10, F.concat(F.lit("top"), F.lpad(c("k").cast("string"), 4, "0"), F.lit(".example"))).when(tier < 100, F.format_string("mid%d.example", "k")).otherwise(F.format_string("tail%d.example", "k"))
    return f.select("flow_id", jarm.alias("jarm"), hashing.bucket(F.concat_ws("|", jarm, "app_protocol"), 132).alias("bucket"), domain.alias("domain"), F.concat_ws("/", "version", "strength", "kex").alias("category"), F.coalesce(lookup({"TLS1.0": 2, "TLS1.1": 2, "TLS1.2": 1}, c("version")), F.lit(0)).alias("level_class"), F.coalesce(lookup({"strong": 0.20, "medium": 0.45, "weak": 0.70}, c("strength")), F.lit(0.88)).alias("fixed_probability"))
