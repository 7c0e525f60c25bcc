"""Model artifacts as files, and the registry of their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest, size, trained_at) of the artifacts at a path: files below folders name=..., by their bytes' SHA-256 and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", "/name=([^/]+)/", 1).alias("name"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), F.col("modificationTime").alias("trained_at"))
    return named.where("name <> ''")


def register(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry (name, digest, size, trained_at, version) with what was found: an artifact whose bytes are known stays as it is, a
    new one gets the version after the name's highest, by time, then digest.  Equal files of a name are one artifact, the earliest."""
    first = found.groupBy("name", "digest").agg(F.min_by(F.struct("size", "trained_at"), "trained_at").alias("x")).select("name", "digest", "x.*")
    new = first.join(registry.select("name", "digest"), ["name", "digest"], "left_anti")
    return registry.unionByName(store.history(new, ["name"], ["trained_at", "digest"], registry))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string, digest string, size bigint, trained_at timestamp, version int")
