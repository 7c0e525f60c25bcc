"""The live board as state with timers.

A shard of the board keeps the newest NEWEST events, the last RECENT processing times and running counters, so its state
is bounded whatever arrives.  Changes are told at once if the last telling is an interval or more ago; otherwise a timer
is set for when it will be, and all that arrives till then is told with it.  Newest and recent are by event time and number, so
batches that are delivered otherwise, or again after a failure, give the same board.  `overview` merges the shards' last tellings.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.flows import folder

NEWEST, RECENT, SHARDS, INTERVAL = 25, 20, 16, 5000
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "at bigint, event_id bigint, ms double"  # at in microseconds
TOLD = f"shard int, told_at bigint, newest array<struct<at: bigint, event_id: bigint>>, recent array<struct<{EVENT.replace(' ', ': ').replace(',:', ',')}>>, allowed bigint, blocked bigint"


class Board(StatefulProcessor):
    """State of a shard: the events that may still be shown, the counters, and when it told last and is to tell next."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.counts = handle.getValueState("counts", "allowed bigint, blocked bigint")
        self.telling = handle.getValueState("telling", "last bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        allowed, blocked = self.counts.get() if self.counts.exists() else (0, 0)
        held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        for r in rows:
            allowed, blocked = allowed + (not r.blocked), blocked + bool(r.blocked)
            held.append((r.at, r.event_id, r.ms))
            if len(held) > 8 * NEWEST:
                held = sorted(held, reverse=True)[:NEWEST]
        held = sorted(held, reverse=True)[:NEWEST]  # RECENT is less
        self.events.put(held)
        self.counts.update((allowed, blocked))
        last, due = self.telling.get() if self.telling.exists() else (0, 0)
        now = timerValues.getCurrentProcessingTimeInMs()
        if due:
            return iter([])
        if now - last >= self.interval:
            return self.tell(key, now)
        self.handle.registerTimer(last + self.interval)
        self.telling.update((last, last + self.interval))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.tell(key, timerValues.getCurrentProcessingTimeInMs())

    def tell(self, key, now: int) -> Iterator[Row]:
        self.telling.update((now, 0))
        held = [tuple(e) for e in self.events.get()]
        allowed, blocked = self.counts.get()
        yield Row(shard=key[0], told_at=now, newest=[e[:2] for e in held], recent=held[:RECENT], allowed=allowed, blocked=blocked)

    def close(self) -> None:
        pass


def tellings(stream: DataFrame, blocked: Column, ms: Column, interval: int = INTERVAL, shards: int = SHARDS) -> DataFrame:
    """What the shards tell of a stream (event_id, user_id, at): at most once an interval (milliseconds) each."""
    rows = stream.select(F.pmod("user_id", F.lit(shards)).cast("int").alias("shard"), F.unix_micros("at").alias("at"), "event_id", F.coalesce(blocked, F.lit(False)).alias("blocked"), ms.cast("double").alias("ms"))
    return rows.groupBy("shard").transformWithState(Board(interval), TOLD, "update", "processingTime")


def follow(told: DataFrame, interval: int = INTERVAL, every: str = "5 seconds", most: float = 600.0) -> DataFrame:
    """Runs tellings by a trigger until nothing arrives and all timers have run out; the rows told.

    A live board is started by `writeStream` likewise and not stopped.  A batch that runs again replaces its rows.
    """
    spark, out = told.sparkSession, folder(told.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # list state and timers need it; a query keeps the settings that it was started with
    try:
        query = told.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(processingTime=every).foreachBatch(put).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    began = ended = time.time()
    seen, over = -1, False
    while query.isActive and not over and time.time() - began < most:
        time.sleep(0.05)
        for p in query.recentProgress:
            if p.batchId > seen:
                seen = p.batchId
                if p.numInputRows:
                    ended = time.time()
                # a batch without rows that began so late found all timers due
                over = not p.numInputRows and datetime.fromisoformat(p.timestamp).timestamp() > ended + interval / 1000
    query.stop()
    if query.exception():
        raise query.exception()
    return spark.read.schema(told.schema).parquet(f"{out}/rows").drop("batch")


def overview(told: DataFrame) -> DataFrame:
    """One row: newest (event ids), mean_ms of the most recent RECENT, allowed, blocked and allowed_percent, over the last telling of each shard.

    At most NEWEST events a shard meet.  Without tellings counters are 0 and the rest is null.
    """
    last = told.groupBy("shard").agg(F.max_by(F.struct("newest", "recent", "allowed", "blocked"), "told_at").alias("x")).select("shard", "x.*")
    events = last.select(F.explode("recent").alias("e"))
    recent = events.orderBy(F.desc("e.at"), F.desc("e.event_id")).limit(RECENT).agg(F.avg("e.ms").alias("mean_ms"))
    ids = F.transform(F.reverse(F.array_sort(F.collect_list("e"))), lambda e: e["event_id"])
    newest = last.select(F.explode("newest").alias("e")).orderBy(F.desc("e.at"), F.desc("e.event_id")).limit(NEWEST).agg(ids.alias("newest"))
    counts = last.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("allowed"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    share = F.round(F.try_divide(F.col("allowed") * 100, F.col("allowed") + F.col("blocked"))).cast("int")
    return newest.join(F.broadcast(recent), F.lit(True)).join(F.broadcast(counts), F.lit(True)).select("newest", "mean_ms", "allowed", "blocked", share.alias("allowed_percent"))
