"""Packets, transcripts and stores (W, X14-X17, J16, K, A08-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reassembly, store, transcript
from tidemark.plans.registry import query
from tidemark.sources.tables import SEGMENTS_SQL, read, segments

_WALK = f"""with s as ({SEGMENTS_SQL}), r as (select *, coalesce(max(seq + len) over (partition by flow order by {{order}} rows between unbounded preceding and 1 preceding), seq) as reached from s),
w as (select *, greatest(0, seq + len - greatest(seq, reached)) as new_bytes, greatest(0, seq - reached) as gap, seq < reached as overlap from r),
c as (select flow, count(*) as packets, cast(sum(len) as bigint) as total_bytes, cast(sum(new_bytes) as bigint) as reassembled, cast(sum(gap) as bigint) as gap_bytes, bool_or(overlap) as has_overlap, bool_or(gap > 0) as has_gap, round(sum(new_bytes) / sum(len), 4) as coverage from w group by flow)"""


@query(_WALK.format(order="seq, pkt_no") + " select * from c")
def reassembly_coverage(spark, sf):
    return reassembly.coverage(reassembly.walk(segments(spark, sf)))


@query(_WALK.format(order="pkt_no") + " select * from c")
def reassembly_arrival_order(spark, sf):
    return reassembly.coverage(reassembly.walk(segments(spark, sf), by_arrival=True))


@query(_WALK.format(order="seq, pkt_no") + " select flow, pkt_no, new_bytes, gap, overlap from w")
def reassembly_segments(spark, sf):
    return reassembly.walk(segments(spark, sf)).select("flow", "pkt_no", "new_bytes", "gap", "overlap")


@query(_WALK.format(order="seq, pkt_no") + " select flow, total_bytes from c order by total_bytes desc, flow limit 1")
def primary_flow(spark, sf):
    return reassembly.primary(reassembly.coverage(reassembly.walk(segments(spark, sf))))


@query("with p as (select conv_id, turn, length(text) as n from conversations), o as (select *, coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start from p), q as (select conv_id, sum(n) as total from p group by 1), pts as (select conv_id, unnest([0, cast(total // 2 as bigint), cast(total as bigint)]) as \"offset\" from q), pd as (select distinct * from pts) select pd.conv_id, pd.\"offset\", coalesce((select min(turn) from o where o.conv_id = pd.conv_id and o.start <= pd.\"offset\" and pd.\"offset\" < o.start + o.n), (select arg_max(turn, start) from o where o.conv_id = pd.conv_id)) as packet from pd")
def byte_offset_owner(spark, sf):
    c = read(spark, sf, "conversations")
    ranges = reassembly.offsets(c.select("conv_id", "turn", F.length("text").cast("bigint").alias("n")), "conv_id", "turn", F.col("n")).select("conv_id", "start", "end", F.col("turn").alias("packet"))
    totals = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"))
    points = totals.select("conv_id", F.explode(F.array(F.lit(0).cast("bigint"), F.floor(F.col("total") / 2), F.col("total"))).alias("offset")).distinct()
    return reassembly.owners(points, ranges, "conv_id").select("conv_id", "offset", "packet")


#: Lines of conversations as a transcript; the user's side asks with "what", the other agrees with "the" or begins with "of".
_PATTERNS = {"command": [r"(?i)(^|\s)(the|la|der)(\s|$)"], "go": [r"(?i)(^|\s)(of|en|die)(\s|$)"], "advertised": [r"(?i)^(in|on)\s"]}
_LINES = "l as (select conv_id as conv, turn as packet_no, case when role = 'user' then 'client_to_server' else 'server_to_client' end as direction, unnest(string_split(text, chr(10))) as line from conversations), n as (select * from l where trim(line) <> '')"


@query(f"with {_LINES} select conv, packet_no, direction, count(*) as lines from n group by 1, 2, 3")
def transcript_lines(spark, sf):
    return _transcript(spark, sf).groupBy("conv", "packet_no", "direction").agg(F.count("*").alias("lines"))


def _transcript(spark, sf):
    c = read(spark, sf, "conversations")
    side = F.when(F.col("role") == "user", "client_to_server").otherwise("server_to_client")
    return transcript.lines(c.select(F.col("conv_id").alias("conv"), F.col("turn").alias("packet_no"), side.alias("direction"), "text"))


@query(f"""with {_LINES}, m as (select conv, packet_no, direction = 'server_to_client' and regexp_matches(line, '(?i)^(in|on)\\s') as adv, direction <> 'server_to_client' and regexp_matches(line, '(?i)(^|\\s)(the|la|der)(\\s|$)') as cmd,
 direction = 'server_to_client' and regexp_matches(line, '(?i)(^|\\s)(of|en|die)(\\s|$)') as go, regexp_matches(line, '(?i)begin') as begins from n),
 a as (select conv, bool_or(adv) as advertised, min(packet_no) filter (where cmd) as command_at, min(packet_no) filter (where go and begins) as begin_at from m group by 1),
 g as (select m.conv, min(m.packet_no) as after_at from m join a on a.conv = m.conv where m.go and m.packet_no >= a.command_at group by 1)
 select a.conv, advertised, command_at, least(after_at, begin_at) as go_ahead_at from a left join g on g.conv = a.conv""")
def transcript_state_machine(spark, sf):
    return transcript.upgrade(_transcript(spark, sf), **_PATTERNS)


@query("select event_id, user_id, event_type, cast(row_number() over (partition by user_id, event_type order by ts, event_id) as integer) as version from events")
def history_versions(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return store.history(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def latest_state(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return store.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")




@query("with c as (select user_id, event_type, max(event_id) as stamp, arg_max(cast(floor(value / 100) as bigint), event_id) as state from events where event_id % 3 <> 0 group by 1, 2), u as (select user_id, event_type, max(event_id) as stamp, arg_max(cast(floor(value / 100) as bigint), event_id) as state from events where event_id % 3 = 0 group by 1, 2) select coalesce(c.user_id, u.user_id) as user_id, coalesce(c.event_type, u.event_type) as event_type, case when u.user_id is not null then u.state else c.state end as state, case when c.user_id is not null and (u.user_id is null or c.state is not distinct from u.state) then c.stamp else u.stamp end as stamp, case when c.user_id is null then 'inserted' when u.user_id is null or c.state is not distinct from u.state then 'unchanged' else 'updated' end as outcome from c full join u on c.user_id = u.user_id and c.event_type = u.event_type")
def upsert_changed_only(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("stamp"), F.floor(F.col("value") / 100).alias("state"))
    one = lambda df: store.latest(df, ["user_id", "event_type"], ["stamp"]).select("user_id", "event_type", "state", "stamp")
    return store.upsert(one(e.where("stamp % 3 <> 0")), one(e.where("stamp % 3 = 0")), ["user_id", "event_type"], ["state"], "stamp")


@query("select o_orderkey, case when c_custkey is null or c_custkey % 2 = 1 then null else o_custkey end as custkey from orders left join customer on c_custkey = o_custkey")
def unknown_key_to_null(spark, sf):
    even = read(spark, sf, "customer").where("c_custkey % 2 = 0")
    return store.known_or_null(read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey")), "custkey", even, "c_custkey")


@query("select source_tag, count(*) as n from (select case when lower(trim(x)) in ('synthetic', 'live', 'lab', 'model') then lower(trim(x)) else 'synthetic' end as source_tag from (select case event_id % 4 when 0 then ' Live ' when 1 then 'LAB' when 2 then event_type else null end as x from events)) group by 1")
def source_normalised(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, " Live ").when(k == 1, "LAB").when(k == 2, F.col("event_type"))
    return read(spark, sf, "events").select(store.source_of(raw).alias("source_tag")).groupBy("source_tag").agg(F.count("*").alias("n"))
