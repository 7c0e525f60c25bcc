"""Driver tables, and flow verdicts and packets derived from them.

The derivations are arithmetic on keys, so they are the same in any engine; the SQL text is therefore shared with the
queries that results are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A flow for each order: attributes follow from the key, cert details are null where no leaf was seen.
FLOW_ATTRIBUTES = """
select o_orderkey as k, 'family-' || cast(o_orderkey as string) as flow_id, o_custkey as custkey, o_orderdate as seen_at,
 case o_orderkey % 3 when 0 then 'smtp' when 1 then 'imap' else 'pop3' end as app_protocol,
 case (o_orderkey * 13) % 7 when 3 then 'implicit' when 4 then 'implicit' when 5 then 'none' when 6 then 'stripped' else 'upgrade' end as starttls_mode,
 case (o_orderkey * 31) % 9 when 0 then 'TLS1.0' when 1 then 'TLS1.1' when 2 then 'TLS1.2' when 3 then 'TLS1.2' when 4 then 'TLS1.2' when 8 then 'unknown' else 'TLS1.3' end as version,
 case (o_orderkey * 17) % 11 when 0 then 'RC4-SHA' when 1 then 'DES-CBC3-SHA' when 2 then 'AES128-SHA' when 3 then 'DES-CBC-SHA' when 4 then 'UNKNOWN-1a1a' when 5 then 'none'
  when 6 then 'TLS_AES_128_GCM_SHA256' when 7 then 'ECDHE-RSA-CHACHA20-POLY1305' else 'ECDHE-RSA-AES128-GCM-SHA256' end as cipher_suite,
 case (o_orderkey * 19) % 5 when 0 then 'RSA' when 1 then 'DHE' when 2 then 'unknown' else 'ECDHE' end as kex,
 case when o_orderkey % 9 = 0 then null when o_orderkey % 5 = 0 then 40 + o_orderkey % 100 else 0 end as pre_len,
 o_orderkey % 2 = 0 as injection, o_orderkey % 4 <> 1 as advertised,
 case o_orderkey % 6 when 0 then 25 when 1 then 587 when 2 then 993 when 3 then 465 when 4 then 995 else 143 end as port,
 o_orderkey % 12 = 0 as early_offered, o_orderkey % 24 = 0 as early_accepted, o_orderkey % 8 = 0 as psk_offered,
 case when o_orderkey % 7 = 0 then null else o_orderkey % 5 end as ticket_age, o_orderkey % 29 = 0 as ech,
 case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 100 as double) / 100 end as ja4_rarity,
 (o_orderkey * 31) % 9 not in (5, 6, 7) and o_orderkey % 10 < 8 as leaf,
 (o_orderkey * 31) % 9 in (5, 6, 7) as opaque
from orders"""

FLOWS = f"""
select a.*, version in ('TLS1.0', 'TLS1.1') as deprecated, version <> 'unknown' as handshake,
 cipher_suite like '%GCM%' or cipher_suite like '%POLY1305%' as is_aead,
 case when cipher_suite = 'none' then 'unknown' when cipher_suite like '%RC4%' or cipher_suite like '%DES%' then 'weak'
  when cipher_suite like '%GCM%' or cipher_suite like '%POLY1305%' then 'strong' else 'medium' end as strength,
 kex in ('ECDHE', 'DHE') or version = 'TLS1.3' as fs,
 case when leaf then (k * 37) % 400 - 20 end as days, case when leaf then (k * 37) % 400 < 20 end as expired,
 case when leaf then case when k % 17 = 0 then '2031-01-05T00:00:00Z' when k % 19 = 0 then 'unknown' else '2019-06-01T00:00:00Z' end end as not_before,
 case when leaf then k % 13 = 0 end as self_signed, case when leaf then k % 6 <> 0 end as chain_valid, case when leaf then 1 + k % 5 end as chain_length,
 case when leaf then k % 8 <> 0 end as san_match, case when leaf then case when k % 3 = 1 then 'EC' else 'RSA' end end as algo,
 case when leaf then case when k % 3 = 1 then case when k % 2 = 0 then 256 else 224 end when k % 7 = 0 then 512 when k % 7 = 1 then 1024 else 2048 end end as bits,
 case when leaf then case when k % 11 = 0 then 'sha1WithRSAEncryption' else 'sha256WithRSAEncryption' end end as sigalg,
 case when leaf then k % 11 = 0 end as sigalg_weak
from ({FLOW_ATTRIBUTES}) a"""


def flow_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat attributes of all flows."""
    return spark.sql(FLOWS.replace("from orders", "from {orders}"), orders=read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow verdicts as typed nested rows, with port, customer and time beside the document's fields."""
    a = flow_attributes(spark, sf_dir)
    tls = F.struct(
        F.col("version"), F.col("deprecated").alias("is_deprecated"), F.col("cipher_suite"), F.col("strength").alias("cipher_strength"), F.col("is_aead"), F.col("kex"), F.col("fs").alias("fs_flag"),
        F.col("ja4_rarity"), F.col("early_offered").alias("early_data_offered"), F.col("early_accepted").alias("early_data_accepted"), F.col("psk_offered"), F.col("ticket_age"), F.col("ech").alias("ech_outer_present"), F.col("handshake").alias("handshake_success"),
    )
    cert = F.struct(
        F.col("leaf").alias("leaf_present"), F.col("opaque").alias("is_tls13_opaque"), F.col("not_before"), F.col("days").alias("days_to_expiry"), F.col("expired").alias("is_expired"), F.col("self_signed").alias("is_self_signed"),
        F.col("chain_valid"), F.col("chain_length"), F.col("san_match"), F.col("algo").alias("pubkey_algo"), F.col("bits").alias("pubkey_bits"), F.col("sigalg"), F.col("sigalg_weak"), (F.col("bits") < 2048).alias("keysize_weak"),
    )
    return a.select("k", "flow_id", "custkey", "seen_at", "port", "app_protocol", "starttls_mode", F.col("advertised").alias("starttls_advertised"), F.col("pre_len").alias("pre_tls_buffer_len"), F.col("injection").alias("pre_tls_buffer_injection_possible"), tls.alias("tls"), cert.alias("cert"))


#: TCP segments for each event: a user's events are a flow.
SEGMENTS = """
select user_id as flow, event_id as pkt_no, cast(get_k as bigint) * 10 + event_id % 7 as seq, 1 + event_id % 50 as len
from (select user_id, event_id, {k} as get_k from events) e"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS.replace("{k}", "get_json_object(props, '$.k')").replace("from events", "from {events}"), events=read(spark, sf_dir, "events").select("user_id", "event_id", "props"))


SEGMENTS_SQL = SEGMENTS.replace("{k}", "json_extract_string(props, '$.k')")
