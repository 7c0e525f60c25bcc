"""Verdicts: handshake classes, findings, scores, policy, history, dashboards (R, A, X, W05, J19, J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing, numbers, tls
from tidemark.operators import rules
from tidemark.plans.registry import query
from tidemark.schema import PROBABILITY_FROM_YOUDEN
from tidemark.sources.tables import FLOWS, read, verdicts

#: The checks as SQL over flat attributes: (name, severity or an expression of it, condition).
_CHECKS = [
    ("TLS version deprecated", "'Critical'", "version in ('TLS1.0', 'TLS1.1')"),
    ("TLS version outdated", "'Medium'", "version = 'TLS1.2'"),
    ("Weak cipher (RC4/NULL/EXPORT/DES)", "'Critical'", "cipher_suite in ('RC4-SHA', 'DES-CBC-SHA')"),
    ("3DES SWEET32", "'High'", "cipher_suite = 'DES-CBC3-SHA'"),
    ("CBC without AEAD", "case when version in ('TLS1.0', 'TLS1.1') then 'High' else 'Medium' end", "not is_aead and version in ('TLS1.0', 'TLS1.1', 'TLS1.2') and cipher_suite <> 'none' and cipher_suite not like 'UNKNOWN-%'"),
    ("KEX unrecognized", "'Info'", "kex = 'unknown' or cipher_suite like 'UNKNOWN-%'"),
    ("Weak KEX (no FS)", "'High'", "kex <> 'unknown' and cipher_suite not like 'UNKNOWN-%' and (kex = 'RSA' or (not fs and version <> 'TLS1.3'))"),
    ("Weak pubkey (<1024)", "'Critical'", "algo = 'RSA' and bits < 1024"),
    ("Weak pubkey (<2048 / <P-256)", "'High'", "(algo = 'RSA' and bits >= 1024 and bits < 2048) or (algo = 'EC' and bits < 256)"),
    ("Weak sigalg (SHA1/MD5)", "'High'", "sigalg_weak or sigalg like 'sha1%'"),
    ("Certificate expired", "'Critical'", "expired"),
    ("Certificate not yet valid", "'High'", "expired = false and try_cast(not_before as timestamptz) > timestamptz '2025-01-01 00:00:00+00'"),
    ("Chain incomplete/self-signed", "'High'", "chain_valid = false or self_signed = true"),
    ("Hostname mismatch", "'High'", "san_match = false"),
    ("No forward secrecy", "case when version = 'TLS1.3' then 'Medium' else 'High' end", "not fs and kex <> 'unknown'"),
    ("STARTTLS not offered", "'High'", "starttls_mode in ('none', 'stripped') and not handshake"),
    ("STARTTLS stripping suspected", "case when escalated then 'Critical' else 'High' end", "starttls_mode = 'stripped' or (advertised and starttls_mode = 'none' and not handshake)"),
    ("Pre-TLS injection possible", "case when pre_len > 0 and injection then 'High' else 'Info' end", "pre_len <> 0"),
    ("Implicit TLS absent", "'Info'", "starttls_mode <> 'implicit' and app_protocol in ('imap', 'pop3')"),
    ("MX/MTA-STS/DANE", "'Info'", "true"),
    ("0-RTT / ECH", "case when not ech and early_offered and psk_offered and coalesce(ticket_age > 0, false) then 'Medium' else 'Info' end", "true"),
    ("Certificate expiry <30d", "'Medium'", "days < 30 and not expired"),
    ("KeyUsage missing", "case when leaf and chain_valid = false then 'High' else 'Info' end", "true"),
    ("ExtendedKeyUsage not serverAuth", "case when leaf and san_match = false then 'High' else 'Info' end", "true"),
    ("pathLen violation", "case when coalesce(chain_valid = false and chain_length > 3, false) then 'High' else 'Info' end", "(chain_valid = false and chain_length > 3) or (not leaf and not opaque)"),
]
_WEIGHT = "case severity when 'Critical' then 25 when 'High' then 15 when 'Medium' then 7 when 'Low' then 3 else 1 end"
_LEVEL = "case when {s} >= 40 then 'Critical' when {s} >= 25 then 'High' when {s} >= 10 then 'Medium' else 'Low' end"
_ROWS = " union all ".join(f"select k, flow_id, port, app_protocol, custkey, {i} as nr, '{n}' as check_name, {s} as severity from h where coalesce({c}, false)" for i, (n, s, c) in enumerate(_CHECKS))


def flows_cte(escalate: bool = False) -> str:
    up = "case when starttls_mode = 'upgrade' and handshake then 1 else 0 end"
    over = f"coalesce(sum({up}) over (partition by custkey, app_protocol order by seen_at, k rows between 10 preceding and 1 preceding), 0) >= 2" if escalate else "false"
    return f"with flows as ({FLOWS}), h as (select *, {over} as escalated from flows), findings as ({_ROWS}), scored as (select k, any_value(flow_id) flow_id, any_value(port) port, any_value(app_protocol) app_protocol, any_value(custkey) custkey, cast(least(100, sum({_WEIGHT})) as integer) risk_score from findings group by k), levels as (select *, {_LEVEL.format(s='risk_score')} as risk_level, 100 - risk_score as posture_score from scored)"


@query(f"{flows_cte()} select check_name, severity, count(*) as n from findings group by 1, 2")
def findings_by_check(spark, sf):
    found = rules.assess(verdicts(spark, sf)).select(F.explode("findings").alias("f"))
    return found.groupBy(F.col("f.check").alias("check_name"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(f"{flows_cte()} select flow_id, risk_score, risk_level, posture_score from levels")
def risk_score_by_flow(spark, sf):
    return rules.assess(verdicts(spark, sf)).select("flow_id", "risk_score", "risk_level", "posture_score")


@query(f"{flows_cte(True)} select flow_id, severity from findings where check_name = 'STARTTLS stripping suspected'")
def history_escalation(spark, sf):
    assessed = rules.assess(verdicts(spark, sf), history=True)
    return rules.exploded(assessed, lambda f: f["check"] == "STARTTLS stripping suspected", "flow_id").select("flow_id", F.col("f.severity").alias("severity"))


@query(f"{flows_cte()} select risk_level, count(*) as n, round(avg(posture_score), 6) as avg_posture from levels group by 1")
def risk_level_distribution(spark, sf):
    return rules.assess(verdicts(spark, sf)).groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg("posture_score"), 6).alias("avg_posture"))


_DECIDED = """, strong as (select *, strength = 'strong' and not deprecated and fs and leaf and coalesce(chain_valid, false) and coalesce(san_match, false) and not coalesce(expired, true) and not coalesce(sigalg_weak, false) and not coalesce(bits < 2048, false) and not opaque as secure from flows),
worst as (select k, bool_or(severity in ('High', 'Critical')) as worst, bool_or(check_name = 'STARTTLS stripping suspected' and severity = 'High') as low from findings group by k),
tops as (select k, check_name as top from (select k, check_name, row_number() over (partition by k order by case severity when 'Critical' then 4 when 'High' then 3 when 'Medium' then 2 when 'Low' then 1 else 0 end desc, nr) as r from findings) t where r = 1),
pol as (select l.flow_id, l.risk_score, l.risk_level, s.secure, s.secure or (s.opaque and not w.worst) as lenient, w.low and not s.secure as low_conf, t.top from levels l join strong s using (k) join worst w using (k) join tops t using (k)),
pol2 as (select *, case when lenient then least(risk_score, 6) else risk_score end as policy_score, case when lenient then 'Low' when low_conf and risk_level = 'Critical' then 'High' else risk_level end as policy_level from pol),
decided as (select *, case policy_level when 'Low' then 'allow' when 'Medium' then 'flag' when 'High' then case when low_conf then 'flag' else 'quarantine' end else 'block' end as action from pol2)"""


@query(f"{flows_cte()}{_DECIDED} select flow_id, action, case action when 'allow' then 'deliver' when 'flag' then 'deliver_banner' when 'quarantine' then 'quarantine' else 'hold_incident' end as wire_action, case when action in ('flag', 'quarantine') then 'yellow' when action = 'block' then 'red' end as banner, policy_level || ' risk_score ' || policy_score || ' top ' || case when secure then 'Posture Info' else top end || case when low_conf then ' low conf' else '' end as disposition from decided")
def policy_disposition(spark, sf):
    return rules.decide(rules.assess(verdicts(spark, sf))).select("flow_id", "action", "wire_action", "banner", "disposition")


@query(f"{flows_cte()}, r as (select *, row_number() over (partition by k order by case severity when 'Critical' then 4 when 'High' then 3 when 'Medium' then 2 when 'Low' then 1 else 0 end desc, nr) as rn from findings) select flow_id, check_name, severity from r where rn = 1")
def top_finding_per_flow(spark, sf):
    top = rules.top_finding(F.col("findings"))
    return rules.assess(verdicts(spark, sf)).select("flow_id", top["check"].alias("check_name"), top["severity"].alias("severity"))


@query(f"{flows_cte()} select check_name, count(*) filter (where port = 25) as p25, count(*) filter (where port = 587) as p587, count(*) filter (where port = 993) as p993 from findings where severity in ('Critical', 'High') group by 1")
def severity_matrix_pivot(spark, sf):
    found = rules.exploded(rules.assess(verdicts(spark, sf)), rules.serious, "port")
    wide = found.groupBy(F.col("f.check").alias("check_name")).pivot("port", [25, 587, 993]).count()
    return wide.select("check_name", *[F.coalesce(F.col(str(p)), F.lit(0)).alias(f"p{p}") for p in (25, 587, 993)])


@query(f"{flows_cte()} select check_name, port, severity, count(*) as n from findings group by cube(check_name, port, severity)")
def findings_cube(spark, sf):
    found = rules.assess(verdicts(spark, sf)).select("port", F.explode("findings").alias("f")).select(F.col("f.check").alias("check_name"), "port", F.col("f.severity").alias("severity"))
    # the cube is over counts, some hundred rows, not over findings
    counts = found.groupBy("check_name", "port", "severity").agg(F.count("*").alias("n"))
    return counts.cube("check_name", "port", "severity").agg(F.sum("n").alias("n"))


@query(f"with flows as ({FLOWS}) select port, starttls_mode, count(*) filter (where starttls_mode = 'upgrade' and handshake) as upgraded, count(*) filter (where not advertised) as never_offered, count(*) as total from flows group by rollup(port, starttls_mode)")
def upgrade_failures_rollup(spark, sf):
    v = verdicts(spark, sf)
    ok = (F.col("starttls_mode") == "upgrade") & F.col("tls.handshake_success")
    return v.rollup("port", "starttls_mode").agg(F.count_if(ok).alias("upgraded"), F.count_if(~F.col("starttls_advertised")).alias("never_offered"), F.count("*").alias("total"))


@query(f"with flows as ({FLOWS}) select app_protocol, version, cipher_suite, count(*) as n from flows group by 1, 2, 3")
def protocol_statistics(spark, sf):
    return verdicts(spark, sf).groupBy("app_protocol", F.col("tls.version").alias("version"), F.col("tls.cipher_suite").alias("cipher_suite")).agg(F.count("*").alias("n"))


@query(f"{flows_cte()}{_DECIDED}, j as (select d.*, f.version, f.starttls_mode, f.strength, f.chain_valid, f.expired, f.handshake from decided d join flows f using (flow_id)) select count(*) as flows, count(*) filter (where risk_level = 'Critical') as critical, count(*) filter (where risk_level = 'High') as high, round(100.0 * count(*) filter (where version = 'TLS1.3') / count(*), 6) as tls13_percent, round(100.0 * count(*) filter (where action = 'allow') / count(*), 6) as allow_percent, round(100.0 * count(*) filter (where action = 'block') / count(*), 6) as block_percent, count(*) filter (where starttls_mode = 'stripped') as stripped, count(*) filter (where version in ('TLS1.0', 'TLS1.1')) as legacy, count(*) filter (where strength = 'weak') as weak, count(*) filter (where coalesce(expired, false) or chain_valid = false) as cert_defect from j")
def kpi_one_pass(spark, sf):
    d, c = rules.decide(rules.assess(verdicts(spark, sf))), F.col
    share = lambda x: F.round(100.0 * F.count_if(x) / F.count("*"), 6)
    return d.agg(
        F.count("*").alias("flows"), F.count_if(c("risk_level") == "Critical").alias("critical"), F.count_if(c("risk_level") == "High").alias("high"), share(c("tls.version") == "TLS1.3").alias("tls13_percent"),
        share(c("action") == "allow").alias("allow_percent"), share(c("action") == "block").alias("block_percent"), F.count_if(c("starttls_mode") == "stripped").alias("stripped"), F.count_if(c("tls.version").isin("TLS1.0", "TLS1.1")).alias("legacy"),
        F.count_if(c("tls.cipher_strength") == "weak").alias("weak"), F.count_if(rules.yes(c("cert.is_expired")) | rules.no(c("cert.chain_valid"))).alias("cert_defect"),
    )


@query(f"{flows_cte()}, dims as (select unnest([25, 110, 143, 465, 587, 993, 995]) as port) select d.port, count(l.k) as flows, cast(round(coalesce(avg(l.posture_score), 85)) as integer) as posture from dims d left join levels l on l.port = d.port group by 1")
def port_posture_matrix(spark, sf):
    ports = spark.createDataFrame([(p,) for p in (25, 110, 143, 465, 587, 993, 995)], "port int")
    found = rules.assess(verdicts(spark, sf)).groupBy("port").agg(F.count("*").alias("flows"), F.avg("posture_score").alias("mean"))
    return ports.join(found, "port", "left").select("port", F.coalesce("flows", F.lit(0)).alias("flows"), F.round(F.coalesce("mean", F.lit(85.0))).cast("int").alias("posture"))


@query(f"{flows_cte()} select case when posture_score >= 90 then 'a' when posture_score >= 75 then 'b' when posture_score >= 50 then 'c' when posture_score >= 25 then 'd' else 'e' end as bin, count(*) as n from levels group by 1")
def posture_histogram(spark, sf):
    p = F.col("posture_score")
    bin_ = F.when(p >= 90, "a").when(p >= 75, "b").when(p >= 50, "c").when(p >= 25, "d").otherwise("e")
    return rules.assess(verdicts(spark, sf)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"with flows as ({FLOWS}) select case when not coalesce(leaf, false) or expired then 'invalid' when days > 60 then 'healthy' when days >= 30 then 'soon' else 'urgent' end as health, count(*) as n from flows group by 1")
def certificate_health(spark, sf):
    c = F.col
    health = F.when(~rules.yes(c("cert.leaf_present")) | rules.yes(c("cert.is_expired")), "invalid").when(c("cert.days_to_expiry") > 60, "healthy").when(c("cert.days_to_expiry") >= 30, "soon").otherwise("urgent")
    return verdicts(spark, sf).groupBy(health.alias("health")).agg(F.count("*").alias("n"))


@query(f"{flows_cte()} select risk_level, count(distinct (f.version, f.cipher_suite, f.kex)) as tuples from levels l join flows f using (k) group by 1")
def distinct_tuples_per_level(spark, sf):
    a = rules.assess(verdicts(spark, sf))
    return a.groupBy("risk_level").agg(F.count_distinct("tls.version", "tls.cipher_suite", "tls.kex").alias("tuples"))


@query(f"{flows_cte()}{_DECIDED} select count(*) filter (where l.posture_score >= 70 and l.risk_level <> 'Critical' and d.starttls_mode <> 'stripped' and d.strength <> 'weak' and not d.deprecated) as accepted, count(*) as total, count(*) filter (where d.starttls_mode = 'stripped') as stripped, count(*) filter (where d.strength = 'weak') as weak, count(*) filter (where d.deprecated) as deprecated from levels l join flows d using (k)")
def acceptance_rate(spark, sf):
    a, c = rules.assess(verdicts(spark, sf)), F.col
    stripped, weak, old = c("starttls_mode") == "stripped", c("tls.cipher_strength") == "weak", c("tls.is_deprecated")
    ok = (c("posture_score") >= 70) & (c("risk_level") != "Critical") & ~stripped & ~weak & ~old
    return a.agg(F.count_if(ok).alias("accepted"), F.count("*").alias("total"), F.count_if(stripped).alias("stripped"), F.count_if(weak).alias("weak"), F.count_if(old).alias("deprecated"))


@query(f"{flows_cte()} select c.c_custkey, c.c_name, count(l.k) as flows, coalesce(max(l.risk_score), 0) as worst from customer c left join levels l on l.custkey = c.c_custkey group by 1, 2")
def customer_left_flows(spark, sf):
    worst = rules.assess(verdicts(spark, sf)).groupBy("custkey").agg(F.count("*").alias("flows"), F.max("risk_score").alias("worst"))
    joined = read(spark, sf, "customer").select("c_custkey", "c_name").join(worst, F.col("c_custkey") == F.col("custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("worst", F.lit(0)).alias("worst"))


_CODES = "select o_orderkey as k, case o_orderkey % 8 when 0 then 5 when 1 then 10 when 2 then 47 when 3 then 4865 when 4 then 49199 when 5 then 52392 when 6 then 6682 else null end as code from orders"


@query(f"with c as ({_CODES}), n as (select k, case when code is null then 'none' when code = 5 then 'RC4-SHA' when code = 10 then 'DES-CBC3-SHA' when code = 47 then 'AES128-SHA' when code = 4865 then 'TLS_AES_128_GCM_SHA256' when code = 49199 then 'ECDHE-RSA-AES128-GCM-SHA256' when code = 52392 then 'ECDHE-RSA-CHACHA20-POLY1305' else 'UNKNOWN-1a1a' end as suite from c) select k, suite, case when suite in ('none', 'UNKNOWN-1a1a') then 'unknown' when suite like '%ECDHE%' or suite like 'TLS%' then 'ECDHE' else 'RSA' end as kex, suite like '%GCM%' or suite like '%POLY%' as aead, case when suite = 'none' then 'unknown' when suite like '%RC4%' or suite like '%DES%' then 'weak' when suite like '%GCM%' or suite like '%POLY%' then 'strong' else 'medium' end as strength from n")
def cipher_classes(spark, sf):
    codes = spark.sql(_CODES.replace("from orders", "from {orders}"), orders=read(spark, sf, "orders").select("o_orderkey"))
    named = codes.select("k", tls.cipher_name(F.col("code")).alias("suite"))
    return named.select("k", "suite", tls.key_exchange(F.col("suite"), F.lit(False)).alias("kex"), tls.is_aead(F.col("suite")).alias("aead"), tls.strength(F.col("suite")).alias("strength"))


_LISTS = "select o_orderkey as k, [4865 + o_orderkey % 3, 2570, 49199 + o_orderkey % 5] as ciphers from orders"


@query("select o_orderkey as k, 't13d0202h2_' || substr(sha256(printf('%04x,%04x', 4865 + o_orderkey % 3, 49199 + o_orderkey % 5)), 1, 12) || '_' || substr(sha256(printf('0403,%04x,001d', 2048 + o_orderkey % 4)), 1, 12) as ja4 from orders")
def handshake_fingerprint(spark, sf):
    k = F.col("o_orderkey")
    ints = lambda *xs: F.array(*[x.cast("int") if hasattr(x, "cast") else F.lit(x) for x in xs])
    made = tls.fingerprint(F.lit(0x0304), ints(4865 + k % 3, 2570, 49199 + k % 5), ints(0, 0x1A1A, 16), ints(0x1D), ints(2048 + k % 4, 0x0403))
    return read(spark, sf, "orders").select(k.alias("k"), made.alias("ja4"))


@query("select doc_id, substr(sha256(text), 1, 8) as content_id, ('0x' || substr(sha256(text), 1, 8))::bigint % 10 as bucket, list_reduce(list_prepend(0::bigint, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(text), 8 * i + 1, 8))::bigint)), lambda a, x: (a * 4294967296 + x) % 132) as cluster from documents")
def hash_buckets(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", hashing.content_id(t).alias("content_id"), hashing.bucket(t, 10).alias("bucket"), hashing.modulo(t, 132).alias("cluster"))


@query("select page_id, regexp_extract(url, '://([^/:?#]+)', 1) as host, regexp_matches(regexp_extract(url, '://([^/:?#]+)', 1), '^[^.]+\\.example\\.com$') as matches from pages")
def host_wildcard_match(spark, sf):
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    return read(spark, sf, "pages").select("page_id", host.alias("host"), tls.host_matches(F.lit("*.EXAMPLE.com."), host).alias("matches"))


@query("select l_orderkey, l_linenumber, cast(floor(date_diff('second', timestamp '1995-06-17 00:00:00', l_shipdate) / 86400.0) as bigint) as days, l_shipdate < timestamp '1995-06-17 00:00:00' as expired from lineitem")
def days_to_expiry(spark, sf):
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.lit("1995-06-17 00:00:00").cast("timestamp"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(seconds / 86400).alias("days"), (seconds < 0).alias("expired"))


@query("with p as (select vec_id, (vec_id % 101) / 100.0 as p from embeddings) select vec_id, case when p >= 0.85 then 'Critical' when p >= 0.6 then 'High' when p >= 0.4 then 'Medium' else 'Low' end as level, case when p >= 0.85 then 'Critical' when p >= 0.7 then 'High' when p >= 0.45 then 'Medium' else 'Low' end as youden, round(-greatest(1e-9, least(1 - 1e-9, p)) * ln(greatest(1e-9, least(1 - 1e-9, p))) - (1 - greatest(1e-9, least(1 - 1e-9, p))) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))), 6) as entropy from p")
def probability_levels(spark, sf):
    p = F.col("p")
    return read(spark, sf, "embeddings").select("vec_id", ((F.col("vec_id") % 101) / 100.0).alias("p")).select("vec_id", numbers.probability_level(p).alias("level"), numbers.probability_level(p, PROBABILITY_FROM_YOUDEN).alias("youden"), F.round(numbers.entropy(p), 6).alias("entropy"))


@query(f"with flows as ({FLOWS}) select flow_id, case version when 'TLS1.0' then 0 when 'TLS1.1' then 1 when 'TLS1.2' then 2 when 'TLS1.3' then 3 else 4 end as version_code, case kex when 'ECDHE' then 0 when 'RSA' then 1 when 'DHE' then 2 else 3 end as kex_code, cast(coalesce(days, -1) as double) as days, cast(coalesce(bits, -1) as double) as bits, coalesce(ja4_rarity, 0.5) as rarity, case when days is null then 1 else 0 end as miss_days, case when ja4_rarity is null then 1 else 0 end as miss_rarity from flows")
def feature_vector(spark, sf):
    c = F.col
    return verdicts(spark, sf).select(
        "flow_id", numbers.category_code("version", c("tls.version")).alias("version_code"), numbers.category_code("kex", c("tls.kex")).alias("kex_code"), F.coalesce(c("cert.days_to_expiry").cast("double"), F.lit(-1.0)).alias("days"), F.coalesce(c("cert.pubkey_bits").cast("double"), F.lit(-1.0)).alias("bits"),
        F.coalesce(c("tls.ja4_rarity"), F.lit(0.5)).alias("rarity"), c("cert.days_to_expiry").isNull().cast("int").alias("miss_days"), c("tls.ja4_rarity").isNull().cast("int").alias("miss_rarity"),
    )


_VECTOR = """case version when 'TLS1.0' then 0 when 'TLS1.1' then 1 when 'TLS1.2' then 2 when 'TLS1.3' then 3 else 4 end{c}|case strength when 'strong' then 0 when 'medium' then 1 when 'weak' then 2 else 3 end{c}|case kex when 'ECDHE' then 0 when 'RSA' then 1 when 'DHE' then 2 else 3 end{c}|case starttls_mode when 'upgrade' then 0 when 'implicit' then 1 when 'none' then 2 else 3 end{c}
|case port when 25 then 0 when 587 then 1 when 993 then 2 when 465 then 3 when 995 then 4 else 5 end{c}|case when opaque then 1 when not leaf then 2 else 0 end{c}|deprecated::int|is_aead::int|fs::int|handshake::int|0|coalesce(ja4_rarity, 0.5)|coalesce(chain_valid::int, -1)|coalesce(san_match::int, -1)|{days}|coalesce(chain_length, -1)|{bits}
|coalesce(sigalg_weak::int, -1)|coalesce(expired::int, -1)|coalesce(self_signed::int, -1)|coalesce((bits < 2048)::int, -1)|(chain_valid is null)::int|(san_match is null)::int|(days is null)::int|(bits is null)::int|(sigalg is null)::int|(chain_length is null)::int|(ja4_rarity is null)::int"""


def _vector_sql(scaled: bool) -> str:
    days, bits = ("case when days is null then -1 else greatest(0, least(3650, days)) / 3650.0 end", "coalesce(bits / 4096.0, -1)") if scaled else ("coalesce(days, -1)", "coalesce(bits, -1)")
    return ", ".join(f"round(({x})::double, 9)" for x in _VECTOR.format(c=" / 32.0" if scaled else "", days=days, bits=bits).replace("\n", "").split("|"))


@query(f"with flows as ({FLOWS}), v as (select flow_id, [{_vector_sql(False)}] as raw, [{_vector_sql(True)}] as scaled from flows) select flow_id, array_to_string(list_transform(raw, lambda x: printf('%.6f', x)), ',') as raw, array_to_string(list_transform(scaled, lambda x: printf('%.6f', x)), ',') as scaled, array_to_string(list_transform([raw[1], raw[2], raw[3], raw[13], raw[15], raw[9], raw[4], raw[24]], lambda x: printf('%.6f', x)), ',') as top from v")
def feature_vectors(spark, sf):
    """All 28 numbers with the seven indicators, raw and scaled, and the eight that models take."""
    from tidemark.functions import vectors

    v = verdicts(spark, sf)
    told = lambda names, scaled: F.array_join(F.transform(vectors.vector(v, names, scaled), lambda x: F.format_string("%.6f", F.round(x, 9))), ",")
    return v.select("flow_id", told(vectors.ALL_28, False).alias("raw"), told(vectors.ALL_28, True).alias("scaled"), told(vectors.TOP_8, False).alias("top"))
