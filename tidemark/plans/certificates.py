"""Certificates of suppliers: issued, written as PEM, read again, and chained to an anchor.

What is issued follows from a supplier's key; what the queries return comes from the bytes alone.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.plans import authority as ca
from tidemark.plans.registry import query
from tidemark.sources import captures, certificates
from tidemark.sources.shared import shared_dir
from tidemark.sources.tables import read

NOW = "2026-01-15T00:00:00Z"
START, END = datetime.datetime(2025, 1, 1), datetime.datetime(2026, 6, 1)


@lru_cache
def keys() -> dict:
    return {"root": ca.RsaKey("root"), "rsa": ca.RsaKey("between"), "ec": ca.EcKey("between"), "low": ca.EcKey("low"), "stranger": ca.EcKey("stranger"), "leaf": ca.EcKey("leaf")}


@lru_cache
def authorities() -> dict[str, bytes]:
    """The anchor and what stands between it and leaves."""
    k, years = keys(), (datetime.datetime(2020, 1, 1), datetime.datetime(2040, 1, 1))
    of = lambda subject, issuer, own, signer, **more: ca.issue(subject, issuer, k[own].spki, k[signer], *years, **{"ca": True} | more)
    return {
        "root": of("root", "root", "root", "root"), "rsa": of("rsa", "root", "rsa", "root", path_len=0), "ec": of("ec", "root", "ec", "root"), "plain": of("plain", "root", "ec", "root", ca=False),
        "low": of("low", "rsa", "low", "rsa"),  # below one that allows none below it
    }


def bundle(k: int, nation: int, own: dict, all_: dict[str, bytes]) -> list[bytes]:
    """What the supplier presents, the leaf first; ten cases by its key, as the queries' SQL has them."""
    case = k % 10
    issuer = {3: "ec", 9: "plain"}.get(case, "low" if k % 13 == 0 and case < 3 else "rsa")
    signer = {"ec": "ec", "plain": "ec", "low": "low"}.get(issuer, "rsa")
    spki = own["leaf"].spki if case == 3 else ca.rsa_key(ca.draw(f"leaf {k}", 1024 if k % 17 == 0 else 2048) | 1)
    host = "other.example" if case == 8 else f"*.n{nation}.example" if k % 3 == 0 else f"mail.n{nation}.example"
    begin, end = START + datetime.timedelta(k % 200), datetime.datetime(2025, 12, 1) if case == 4 else END + datetime.timedelta(k % 300)
    if case == 6:
        issuer, signer, spki = f"s{k}", "leaf", own["leaf"].spki
    leaf = ca.issue(f"s{k}", issuer, spki, own["stranger" if case == 7 else signer], begin, end, k + 1, sans=None if k % 19 == 0 else [host, f"_smtp.n{nation}.example"], staple=k % 7 == 0)
    if k % 11 == 0:
        leaf = leaf[: len(leaf) // 2]
    return [leaf] if case in (5, 6) else [leaf, *([all_["low"], all_["rsa"]] if issuer == "low" else [all_[issuer]])]


def presented(spark, sf: str) -> DataFrame:
    """(bundle, nr, der, host) of all suppliers, read from PEM text in the shared folder."""
    own, all_ = keys(), authorities()  # found once, on the driver, and sent along

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([f"# {k} {n}\n" + "\n".join(map(ca.pem, bundle(k, n, own, all_))) for k, n in rows], pa.string())], ["value"])

    path = f"{shared_dir(spark)}/certificates-{uuid.uuid4().hex}"
    parts = spark.sparkContext.defaultParallelism
    read(spark, sf, "supplier").select("s_suppkey", "s_nationkey").repartition(parts).mapInArrow(write, "value string").write.option("lineSep", "\n\n").text(path)
    text = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_extract("value", "^# ([0-9]+ [0-9]+)", 1).alias("name"), F.col("value").alias("text"))
    found = captures.certificates(text).select(F.split("name", " ").alias("told"), "nr", "der")
    return found.select(F.col("told")[0].cast("bigint").alias("bundle"), "nr", "der", F.format_string("mail.n%s.example", F.col("told")[1]).alias("host"))


CASES = """with s as (select s_suppkey as k, s_nationkey as n, s_suppkey % 10 as c, s_suppkey % 11 = 0 as cut, s_suppkey % 13 = 0 and s_suppkey % 10 < 3 as low from supplier),
t as (select *, k % 19 = 0 as bare, c = 6 as own, timestamp '2025-01-01' + to_days((k % 200)::int) as b, case when c = 4 then timestamp '2025-12-01' else timestamp '2026-06-01' + to_days((k % 300)::int) end as e, case when c in (5, 6) then 1 when low then 3 else 2 end as presented,
  case when c in (3, 6) then 'EC' else 'RSA' end as algo, case when c in (3, 6) then 256 when k % 17 = 0 then 1024 else 2048 end as bits from s),
v as (select *, not cut and not bare and c <> 8 as san, c in (0, 1, 2, 3) and not low and not cut and not bare and b <= timestamp '2026-01-15' and bits <> 1024 as valid from t) """


@query(CASES + """select k as s_suppkey, not cut as leaf_present, case when valid then 3 else presented end as chain_length, valid as chain_valid, san as san_match, not cut and bare as used_cn, case when not cut then k % 7 = 0 end as ocsp_must_staple,
case when not cut then e < timestamp '2026-01-15' end as is_expired, case when not cut then own end as is_self_signed, case when not cut then date_diff('day', timestamp '2026-01-15', e)::int end as days_to_expiry, case when not cut then algo end as pubkey_algo, case when not cut then bits end as pubkey_bits,
case when not cut then 'sha256' end as sigalg from v""")  # fmt: skip
def certificate_chains(spark, sf):
    rows = presented(spark, sf)
    store = spark.createDataFrame([(authorities()["root"],)], "der binary")
    found = chains.validate(rows, store, F.col("host"), NOW)
    return found.select(F.col("bundle").alias("s_suppkey"), "leaf_present", "chain_length", "chain_valid", "san_match", "used_cn", "ocsp_must_staple", "is_expired", "is_self_signed", "days_to_expiry", "pubkey_algo", "pubkey_bits", "sigalg")


@query(CASES + """select k as s_suppkey, 's' || k as cn, case when not bare then (case when c = 8 then 'other.example' when k % 3 = 0 then '*.n' || n || '.example' else 'mail.n' || n || '.example' end) || ',_smtp.n' || n || '.example' end as sans,
strftime(b, '%Y-%m-%d') as not_before, strftime(e, '%Y-%m-%d') as not_after, case when c in (3, 6, 7, 9) or low then '1.2.840.10045.4.3.2' else '1.2.840.113549.1.1.11' end as sig_oid from v where not cut""")  # fmt: skip
def certificate_fields(spark, sf):
    rows = certificates.parse(presented(spark, sf).where("nr = 0"), "bundle").where("malformed is null")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select(F.col("bundle").alias("s_suppkey"), "cn", F.array_join("sans", ",").alias("sans"), day("not_before"), day("not_after"), "sig_oid")


@query("""select s_suppkey, case when s_suppkey % 5 = 4 then 'opaque' when s_suppkey % 5 = 3 then 'unknown' else ['good', 'revoked', 'unknown'][s_suppkey % 5 + 1] end as ocsp_stapled_status,
case when s_suppkey % 5 < 3 then strftime(timestamp '2026-01-01' + to_days((s_suppkey % 20)::int), '%Y-%m-%d') end as this_update, case when s_suppkey % 5 < 3 and s_suppkey % 2 = 0 then strftime(timestamp '2026-02-01' + to_days((s_suppkey % 20)::int), '%Y-%m-%d') end as next_update from supplier""")
def stapled_responses(spark, sf):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                days = datetime.timedelta(k % 20)
                begin, end = datetime.datetime(2026, 1, 1) + days, datetime.datetime(2026, 2, 1) + days if k % 2 == 0 else None
                out.append(b"220 ready\r\n" + (ca.status_message(ca.answer(k % 5, begin, end)) if k % 5 < 3 else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["s_suppkey", "payload"])

    sent = read(spark, sf, "supplier").select("s_suppkey").mapInArrow(write, "s_suppkey bigint, payload binary").withColumn("opaque", F.col("s_suppkey") % 5 == 4)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return certificates.staples(sent, "s_suppkey", "opaque").select("s_suppkey", "ocsp_stapled_status", day("this_update"), day("next_update"))
