"""Streams over the event log: versions, latest state, debounced aggregates, windows, escalation.

Each function takes a streaming frame and gives a streaming frame or starts a query; `drain` runs one over what is there and
ends, which is how tests and batch-like jobs use them.  Checkpoints are in the shared folder.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, with `at` as an event time."""
    path = f"{sf_dir}/events.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    # a file stream watches a folder; a table that is one file is watched for in the folder that holds it
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        read, path = read.option("pathGlobFilter", "events.parquet"), sf_dir
    return read.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all that is available and gives the sink's rows.

    Each batch is written as a table of its own, so a batch that runs again replaces what it had left.
    """
    spark, out = stream.sparkSession, folder(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", T.LongType())).parquet(f"{out}/rows")
    if mode == "complete":  # the last batch holds all
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")
    return rows.drop("batch")


def state_of(stream: DataFrame) -> DataFrame:
    """Per key the number of versions and the last state, kept up to date."""
    return stream.groupBy("user_id", "event_type").agg(F.count("*").alias("version"), F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "3650 days") -> DataFrame:
    """Counts by event time, an extension."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(stream: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "3650 days") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.window("at", width, step)).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "3650 days") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def once(stream: DataFrame, late: str = "3650 days") -> DataFrame:
    """What is delivered again by the same key and content is dropped."""
    return stream.withColumn("content", F.sha2(F.concat_ws("|", "event_type", "value", "props"), 256)).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id", "content"]).drop("content")


ESCALATED = "user_id bigint, event_id bigint, escalated boolean"


def escalations(stream: DataFrame, keep: int = 10, least: int = 2) -> DataFrame:
    """Each error of a user with whether `least` of the last `keep` events before it were purchases; a bounded list a key."""

    def step(key: tuple, batches, state: GroupState):
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        found = []
        for r in rows.itertuples():
            if r.event_type == "error":
                found.append((key[0], r.event_id, sum(recent[-keep:]) >= least))
            recent.append(int(r.event_type == "purchase"))
        state.update((recent[-keep:],))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "escalated"])

    return stream.select("user_id", "event_id", "event_type", "at").groupBy("user_id").applyInPandasWithState(step, ESCALATED, "recent array<int>", "append", GroupStateTimeout.NoTimeout)


def refresh(stream: DataFrame, summary, keys: list[str], sums: list[str]) -> DataFrame:
    """An aggregate table kept by a stream of changes; a batch's changes make one refresh.

    Each batch is added to the table of the batch before it and written under its own number, so a batch that runs again replaces
    what it had left.
    """
    spark, out = stream.sparkSession, folder(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        rows = summary(batch)
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{out}/view={number - 1}")).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
        rows.write.mode("overwrite").parquet(f"{out}/view={number}")

    query = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/view={query.lastProgress.batchId}" if query.lastProgress else f"{out}/view=0")
