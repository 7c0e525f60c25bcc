"""Manifests, taxonomies, splits and policy records: written to the shared folder from tables, read back and validated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import validation
from tidemark.plans.registry import query
from tidemark.sources import text
from tidemark.sources.shared import shared_dir
from tidemark.sources.tables import read

c = F.col
ENTRY = "struct<tls:string,cipher:string,kex:string,cert:string,starttls:string,port:string,environment_id:string,flag:string,is_jitter_augmentation:boolean>"
#: What a part's entry says, by its key; both engines evaluate the text.
_ENTRY = """'family-' || p_partkey as family, case p_partkey % 7 when 0 then 'TLS1.0' when 1 then 'TLS1.1' when 2 then 'TLS1.2' when 3 then 'TLS1.3' when 4 then '1.3' when 5 then 'none' else 'SSL3' end as tls,
case p_partkey % 9 when 0 then 'RC4-SHA' when 1 then 'TLS_AES_128_GCM_SHA256' when 2 then 'ECDHE-RSA-AES128-GCM-SHA256' when 3 then 'UNKNOWN-1a1a' when 4 then '0x1A1A' when 5 then 'none' when 6 then 'TLS_CHACHA20_POLY1305_SHA256' when 7 then 'DES-CBC3-SHA' else 'AES128-SHA' end as cipher,
case p_partkey % 5 when 0 then 'RSA' when 1 then 'DHE' when 2 then 'odd' else 'ECDHE' end as kex, 'c' || p_size % 50 as cert, case p_partkey % 4 when 0 then 'upgrade' when 1 then 'implicit' when 2 then 'cleartext' else 'later' end as starttls, '' || (25 + p_partkey % 3) as port,
case when p_partkey % 13 = 0 then 'env-jitter-' else 'env-' end || p_partkey as environment_id, case when p_partkey % 11 = 0 then 'jitter' end as flag, p_partkey % 17 = 0 as is_jitter_augmentation"""


def in_files(rows: DataFrame, name: str) -> DataFrame:
    """Rows of text, written to the shared folder and read again: (text)."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return rows.sparkSession.read.text(path).select(c("value").alias("text"))


def manifest(spark, sf) -> DataFrame:
    """Manifest documents of parts, one for 50 of them, as JSON maps, read back."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", *_columns())
    entry = F.struct(*[k for k in rows.columns if k not in ("p_partkey", "family")])
    docs = rows.groupBy(F.floor(c("p_partkey") / 50)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("family", entry)))).alias("value")).select("value")
    return text.manifest(in_files(docs, "manifest"), ENTRY).select("family", "entry.*")


def _columns() -> list[str]:
    """The expressions of _ENTRY, cut at commas outside brackets."""
    out, depth, begin = [], 0, 0
    for k, x in enumerate(_ENTRY):
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append(_ENTRY[begin:k])
            begin = k + 1
    return [*out, _ENTRY[begin:]]


_SUITES = "case cipher when 'RC4-SHA' then 5 when 'TLS_AES_128_GCM_SHA256' then 4865 when 'ECDHE-RSA-AES128-GCM-SHA256' then 49199 when 'TLS_CHACHA20_POLY1305_SHA256' then 4867 when 'DES-CBC3-SHA' then 10 when 'AES128-SHA' then 47 end"
_COHERENT = f"""select family, 'reserved suite' as rule, cipher as detail from {{t}} where cipher in ('UNKNOWN-1a1a', '0x1A1A') union all select family, 'exchange', kex from {{t}} where kex = 'odd'
union all select family, 'version and suite', tls || ' ' || cipher from {{t}} where {_SUITES} is not null and tls in ('TLS1.0', 'TLS1.1', 'TLS1.2', 'TLS1.3') and (tls = 'TLS1.3') <> (cipher like 'TLS!_%' escape '!')"""
_REPEATED = "select family, 'repeated' as rule, first as detail from (select *, min(family) over (partition by tls, cipher, kex, cert, starttls, port) as first from {t}) where family > first"


@query(f"""with e as (select {_ENTRY} from part), t as (select * from e where flag is null and not is_jitter_augmentation and environment_id not like '%jitter%'), n as (select * replace (case when tls = '1.3' then 'TLS1.3' else tls end as tls) from t)
select family as entity, rule, detail from ({_COHERENT.format(t='t')} union all select family, 'version', tls from t where tls = 'SSL3' union all select family, 'not normalised', tls from t where tls = '1.3'
union all select family, 'exchange of TLS 1.3', tls || ' ' || cipher || ' ' || kex from t where (tls = 'TLS1.3' or cipher like 'TLS!_%' escape '!') and kex <> 'ECDHE' union all {_REPEATED.format(t='n')}
union all select 'families', 'count', count(*) || ', not 100' from t having count(*) <> 100 union all select 'tuples', 'count', count(*) || ', not 100' from (select distinct tls, cipher, kex, cert, starttls, port from n) having count(*) <> 100)""")
def manifest_violations(spark, sf):
    """F22."""
    return validation.manifest(manifest(spark, sf), 100)


@query(f"""with t as (select * replace (case when p_partkey % 31 = 0 then 'x' || family else family end as family), case when p_partkey % 23 = 0 then '0xZZ' when p_partkey % 19 = 0 then '0x0001' when cipher = 'none' and p_partkey % 2 = 0 then '0x0000' when cipher = 'none' or {_SUITES} is null or p_partkey % 29 = 0 then '—' else '0x' || lpad(to_hex({_SUITES}), 4, '0') end as iana from (select p_partkey, {_ENTRY} from part)),
k as (select *, {_SUITES} as code from t) select family as entity, rule, detail from ({_COHERENT.format(t='t')} union all select family, 'version', tls from t where tls in ('SSL3', '1.3') union all select family, 'name', family from t where family like 'x%' union all select family, 'suite', cipher from k where code is null and cipher <> 'none'
union all select family, 'mode', starttls from t where starttls = 'later' union all select family, 'code of none', iana from t where cipher = 'none' and iana <> '—' union all select family, 'code missing', cipher from k where code is not null and iana = '—' union all select family, 'code unreadable', iana from k where code is not null and iana = '0xZZ'
union all select family, 'code of another', iana from k where code is not null and iana = '0x0001' union all {_REPEATED.format(t='t')})""")
def taxonomy_violations(spark, sf):
    """A pipe table in a text file, line by line."""
    from tidemark.schema import CIPHER_NAMES

    rows = read(spark, sf, "part").selectExpr("p_partkey", *_columns())
    code = F.try_element_at(F.create_map(*[F.lit(x) for k, v in CIPHER_NAMES.items() for x in (v, k)]), c("cipher"))
    k = c("p_partkey")
    iana = F.when(k % 23 == 0, "0xZZ").when(k % 19 == 0, "0x0001").when((c("cipher") == "none") & (k % 2 == 0), "0x0000").when(code.isNull() | (k % 29 == 0), "—").otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(code), 4, "0")))
    family = F.when(k % 31 == 0, F.concat(F.lit("x"), "family")).otherwise(c("family"))
    cells = ["family", "tls", "cipher", "iana", "kex", "cert", "starttls", "port"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[family if n == "family" else iana if n == "iana" else c(n) for n in cells]), F.lit(" |"))
    # a table of 50 rows is a file's part of text, with its header and rule
    header = F.array(F.lit("# Families"), F.lit("| Family | TLS | Cipher | IANA | KEX | Cert | STARTTLS | Port |"), F.lit("|" + "---|" * 8))
    tables = rows.groupBy(F.floor(k / 50)).agg(F.array_join(F.concat(header, F.collect_list(line), F.array(F.lit(""), F.lit("end"))), "\n").alias("value")).select("value")
    path = f"{shared_dir(spark)}/taxonomy-{uuid.uuid4().hex}"
    tables.write.option("lineSep", "\n\f\n").text(path)
    text_ = spark.read.option("lineSep", "\n\f\n").text(path)
    lines = text_.select(F.xxhash64("value").alias("file"), F.posexplode(F.split("value", "\n")).alias("nr", "line"))
    found = text.pipe_table(lines, "Family", 8).select(*[c("cells")[i].alias(n) for i, n in enumerate(cells)])
    return validation.taxonomy(found)


@query("""with m as (select 'all' as s, 'env-' || c_custkey as env, c_custkey as k from customer where c_custkey % 50 <> 49 union all select case c_custkey % 5 when 0 then 'train' when 1 then 'val' when 2 then 'locked' else 'spare' end, case when c_custkey % 40 = 3 then 'env-jitter-' else 'env-' end || c_custkey, c_custkey from customer
union all select 'val', 'env-' || c_custkey, c_custkey from customer where c_custkey % 35 = 0 union all select 'locked', 'env-' || c_custkey, c_custkey from customer where c_custkey % 45 = 2),
d as (select s, env, any_value(k) as k, count(*) as n from m group by 1, 2), p as (select *, k // 3 as print from d), a as (select * from (values ('train', 'val'), ('train', 'locked'), ('val', 'locked')) as t(a, b))
select entity, rule, detail from (select s as entity, 'size' as rule, count(*) || ', not ' || case s when 'train' then 30 when 'val' then 40 else 20 end as detail from m where s in ('train', 'val', 'extra') group by 1 having count(*) <> case s when 'train' then 30 when 'val' then 40 else 20 end
union all select 'extra', 'size', '0, not 20' union all select s, 'repeated', env from d where n > 1 union all select s, 'variant', env from d where env like '%jitter%' union all select s, 'unknown', env from d where s <> 'all' and env not in (select env from d where s = 'all')
union all select a.a || ' and ' || a.b, 'shared environment', x.env from a join d x on x.s = a.a join d y on y.s = a.b and x.env = y.env union all select distinct a.a || ' and ' || a.b, 'shared fingerprint', '' || x.print from a join p x on x.s = a.a join p y on y.s = a.b and x.print = y.print)""")
def split_set_violations(spark, sf):
    """sets of customers' environments; some stand in two, some in one twice, some are variants with another's fingerprint."""
    k = c("c_custkey")
    customers = read(spark, sf, "customer").select("c_custkey")
    plain = F.concat(F.lit("env-"), k)
    jitter = F.when(k % 40 == 3, F.concat(F.lit("env-jitter-"), k)).otherwise(plain)
    name = F.when(k % 5 == 0, "train").when(k % 5 == 1, "val").when(k % 5 == 2, "locked").otherwise("spare")
    of = lambda where, set_name, env: customers.where(where).select(set_name.alias("set_name"), env.alias("env"), k.alias("k"))
    rows = of("c_custkey % 50 <> 49", F.lit("all"), plain).unionByName(of("true", name, jitter)).unionByName(of("c_custkey % 35 = 0", F.lit("val"), plain)).unionByName(of("c_custkey % 45 = 2", F.lit("locked"), plain))
    docs = in_files(rows.groupBy("set_name", F.floor(c("k") / 100)).agg(F.to_json(F.struct("set_name", F.collect_list(F.struct("env", "k")).alias("members"))).alias("value")).select("value"), "splits")
    members = docs.select(F.from_json("text", "set_name string, members array<struct<env:string,k:bigint>>").alias("d")).select("d.set_name", F.explode("d.members").alias("m")).select("set_name", "m.*")
    prints = members.select("env", F.floor(c("k") / 3).alias("print")).distinct()
    return validation.splits(members.select("set_name", "env"), prints, {"train": 30, "val": 40, "extra": 20}, "all", [("train", "val"), ("train", "locked"), ("val", "locked")])


@query("""with h as (select s_suppkey as k, 'mx' || s_suppkey || '.n' || s_nationkey || '.example' as host from supplier), m as (select k, host, case when k % 4 = 0 then ['enforce', 'testing', 'none'][k % 3 + 1] when k % 9 = 1 then 'enforce' else 'none' end as mode, k % 6 = 0 and k % 12 <> 0 as dane from h)
select k as s_suppkey, mode, dane, 'MTA-STS ' || mode || ', DANE ' || case when dane then 'present' else 'absent' end as evidence from m""")
def policy_records(spark, sf):
    """What policy documents and records say of suppliers' mail hosts; some can't be read, some records don't hold."""
    k = c("s_suppkey")
    host = F.concat(F.lit("mx"), k, F.lit(".n"), "s_nationkey", F.lit(".example"))
    rows = read(spark, sf, "supplier").select(k, host.alias("host"))
    mode = F.element_at(F.array(*map(F.lit, ("enforce", "testing", "none"))), (k % 3 + 1).cast("int"))
    document = F.to_json(F.struct(F.lit("STSv1").alias("version"), mode.alias("mode"), F.array("host").alias("mx"), F.lit(86400).alias("max_age")))
    other = F.to_json(F.struct(F.lit("STSv1").alias("version"), F.lit("enforce").alias("mode"), F.array("host", F.lit("other.example")).alias("mx"), F.lit(60).alias("max_age")))
    texts = rows.select(F.when(k % 4 == 0, document).when(k % 9 == 1, other).when(k % 4 == 1, F.concat(F.lit("{broken "), "host")).otherwise(F.replace(document, F.lit("STSv1"), F.lit("STSv2"))).alias("value"))
    record = F.struct(F.lit(3).alias("usage"), F.lit(1).alias("selector"), F.lit(1).alias("matching_type"), F.when(k % 12 == 0, "beef").otherwise(F.sha2("host", 256)).alias("cert_data"))
    records = rows.where("s_suppkey % 6 = 0").select(F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("_25._tcp."), "host"), F.lit("meta")), F.array(record, record))).alias("value"))
    found = validation.policy_evidence(rows, validation.policies(in_files(texts, "policies")), validation.associations(in_files(records, "records")))
    return found.select("s_suppkey", "mode", "dane", "evidence")


@query("""with d as (select d.source as name, l.quality as q, l.doc_id as k from labels l join documents d on d.doc_id = l.doc_id), a as (select name, 1 as g, count(*) filter (q = 0) as n0, count(*) filter (q = 1) as n1 from d group by 1 union all
select name, 2, count(*) filter (q = 0 and k % 3 <> 0), count(*) filter (q = 1 and k % 3 <> 0) from d where name like '%1%' group by 1 union all select name, 2, count(*) filter (q = 0), count(*) filter (q = 1) from d where name not like '%1%' group by 1),
t as (select name, g, sha256('{"n0":' || n0 || ',"n1":' || n1 || '}' || chr(10)) as digest, length('{"n0":' || n0 || ',"n1":' || n1 || '}') + 1 as size from a), f as (select name, digest, any_value(size) as size, min(g) as g from t group by 1, 2)
select name, digest, size, row_number() over (partition by name order by g) as version from f""")
def model_registry(spark, sf):
    """Artifacts of two trainings are scanned one after the other; what the second left as it was is no new version."""
    from tidemark.sources import artifacts

    docs = read(spark, sf, "documents").select("doc_id", c("source").alias("name"))
    rows = read(spark, sf, "labels").join(docs, "doc_id")
    known = artifacts.empty(spark)
    for where in ("true", "name not like '%1%' or doc_id % 3 <> 0"):
        count = lambda q, where=where: F.count_if((c("quality") == q) & F.expr(where))
        made = rows.groupBy("name").agg(F.to_json(F.struct(count(0).alias("n0"), count(1).alias("n1"))).alias("value"))
        path = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
        made.write.partitionBy("name").text(path)
        known = artifacts.register(known, artifacts.scan(spark, path))
    return known.select("name", "digest", "size", "version")


def written(rows: DataFrame, name: str) -> str:
    """The folder with a file for each row (file, body), written by tasks."""
    import pyarrow as pa

    from tidemark.sources.shared import filesystem

    folder = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def put(batches):
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = filesystem(f"{folder}/{file}")
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    rows.select("file", "body").mapInArrow(put, "file string").write.format("noop").mode("overwrite").save()
    return folder


@query("""with f as (select s_suppkey as k, 'family-' || s_suppkey || case when s_suppkey % 7 = 0 then '-jitter' else '' end as stem, [x for x in [case when s_suppkey % 2 = 0 then 'base' end, case when s_suppkey % 3 = 0 then 'coherent' end, case when s_suppkey % 5 = 1 then 'locked' end] if x is not null] as folders from supplier)
select stem, folders[1] as folder, row_number() over (order by k, stem) as place from f where len(folders) > 0 and stem not like '%jitter%'""")
def captures_discovered(spark, sf):
    """S12."""
    k = c("s_suppkey")
    stem = F.concat(F.lit("family-"), k, F.when(k % 7 == 0, "-jitter").otherwise(""))
    held = F.array_compact(F.array(F.when(k % 2 == 0, "base"), F.when(k % 3 == 0, "coherent"), F.when(k % 5 == 1, "locked"), F.when(k % 4 == 1, "other")))
    files = read(spark, sf, "supplier").select(stem.alias("stem"), F.explode(held).alias("folder")).select(F.concat("folder", F.lit("/"), "stem", F.lit(".pcap")).alias("file"), F.lit("x").alias("body"))
    return text.discovered(spark, written(files, "discovered"), ["base", "coherent", "locked"]).select("stem", "folder", "place")


@query("""select s_suppkey as k, i as nr, s_suppkey * 10 + i as v from supplier, lateral (select unnest(range(0, case when s_suppkey % 4 = 3 then 0 when s_suppkey % 4 = 0 then 1 when s_suppkey % 4 = 1 then least(1, s_suppkey % 9) else least(5, s_suppkey % 9) end)) as i)""")
def fixtures_ingested(spark, sf):
    """Objects, lists of which the first counts, lists of which five do, and files that are no JSON."""
    k = c("s_suppkey")
    item = lambda i: F.to_json(F.struct(k.alias("k"), (k * 10 + i).alias("v")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(8)), 1, (k % 9).cast("int")), item), ", "), F.lit("]"))
    body = F.when(k % 4 == 0, item(F.lit(0))).when(k % 4 == 3, "{broken").otherwise(listed)
    name = F.concat(F.element_at(F.array(*map(F.lit, ("family-", "adversarial/a-", "prior/p-", "family-bad-"))), (k % 4 + 1).cast("int")), k, F.lit(".json"))
    found = text.ingested(spark, written(read(spark, sf, "supplier").select(name.alias("file"), body.alias("body")), "fixtures"), {"/adversarial/": 1, "/family-": 1})
    return found.select(F.get_json_object("doc", "$.k").cast("bigint").alias("k"), "nr", F.get_json_object("doc", "$.v").cast("bigint").alias("v"))
