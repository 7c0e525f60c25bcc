"""Streams that run over all events and end, held against batch SQL (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.streaming import board, flows


@query("select user_id, event_type, count(*) as version, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def stream_latest_state(spark, sf):
    return flows.drain(flows.state_of(flows.events(spark, sf)), "complete")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_tumbling(spark, sf):
    rows = flows.drain(flows.tumbling(flows.events(spark, sf)), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("select strftime(d, '%Y-%m-%d') as day, count(*) as n from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as d from events) group by 1")
def stream_sliding(spark, sf):
    rows = flows.drain(flows.sliding(flows.events(spark, sf)), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as nr from g) select user_id, n, count(*) as sessions from (select user_id, nr, count(*) as n from s group by 1, 2) group by 1, 2")
def stream_sessions(spark, sf):
    rows = flows.drain(flows.sessions(flows.events(spark, sf)), "complete")
    return rows.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("select event_type, count(*) as n from events group by 1")
def stream_deduplicated(spark, sf):
    return flows.drain(flows.once(flows.events(spark, sf)), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_type, count(*) + count(*) filter (event_id % 7 = 0) as n from events group by 1")
def stream_redelivered(spark, sf):
    """All events come twice, a seventh of them changed the second time; what is the same is dropped, what differs is not."""
    path = f"{flows.folder(spark)}/in"
    rows = spark.read.parquet(f"{sf}/events.parquet")
    changed = rows.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    rows.coalesce(1).write.parquet(path)
    changed.coalesce(1).write.mode("append").parquet(path)
    given = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    return flows.drain(flows.once(given), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select user_id, event_id, ups >= 2 as escalated from (select user_id, event_id, event_type, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding), 0) as ups from events) where event_type = 'error'")
def stream_escalation(spark, sf):
    return flows.drain(flows.escalations(flows.events(spark, sf)), "append")


@query("""with r as (select event_id, value, row_number() over (order by ts desc, event_id desc) as nr from events), n as (select string_agg(event_id, ',' order by nr) as newest from r where nr <= 25), m as (select round(avg(value), 6) as mean_ms from r where nr <= 20),
c as (select count(*) filter (event_type <> 'error') as allowed, count(*) filter (event_type = 'error') as blocked from events) select newest, mean_ms, allowed, blocked, round(allowed * 100.0 / (allowed + blocked))::int as allowed_percent from n, m, c""")
def stream_board(spark, sf):
    """The board after all events, which come in four deliveries; refreshes are half a second apart."""
    path = f"{flows.folder(spark)}/in"
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(4, "event_id").write.parquet(path)
    given = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    told = board.follow(board.tellings(given, F.col("event_type") == "error", F.col("value"), 500), 500, "100 milliseconds")
    return board.overview(told).select(F.array_join("newest", ",").alias("newest"), F.round("mean_ms", 6).alias("mean_ms"), "allowed", "blocked", "allowed_percent")
