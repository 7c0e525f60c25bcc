"""The live board: the same rows however events are delivered, refreshes that are not too often, and bounded state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import board, flows

SCHEMA = "event_id bigint, user_id bigint, at timestamp, bad boolean, ms double"


def run(spark, deliveries, interval):
    path = f"{flows.folder(spark)}/in"
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    told = board.follow(board.tellings(given, F.col("bad"), F.col("ms"), interval, shards=3), interval, "50 milliseconds", 120)
    return told.collect(), board.overview(told).first()


def test_board(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = [(i, rng.randrange(40), start + timedelta(seconds=rng.randrange(300)), rng.random() < 0.3, round(rng.random() * 20, 2)) for i in range(400)]
    order = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    mixed = rows[:]
    rng.shuffle(mixed)
    for deliveries, interval in (([rows], 300), ([mixed[k::4] for k in range(4)], 2500)):
        told, o = run(spark, deliveries, interval)
        assert o.newest == [r[0] for r in order[:25]] and abs(o.mean_ms - sum(r[4] for r in order[:20]) / 20) < 1e-9
        assert o.blocked == sum(r[3] for r in rows) and o.allowed + o.blocked == 400 and o.allowed_percent == round(100 * o.allowed / 400)
        for shard in range(3):
            mine = sorted(t.told_at for t in told if t.shard == shard)
            assert mine and all(b - a >= interval for a, b in zip(mine, mine[1:]))
        assert all(len(t.newest) <= 25 and len(t.recent) <= 20 for t in told)


def test_board_without_events(spark):
    told, o = run(spark, [[]], 200)
    assert not told and o.allowed == o.blocked == 0 and o.mean_ms is None and o.allowed_percent is None
