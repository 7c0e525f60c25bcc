"""The folder that driver and executors share, and stores by URI."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, as a URI.  The one that the cluster names in spark.checkpoint.dir is taken; only where none is named
    and all runs on this machine (tests) one below the temporary folder is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage, written once to the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(store, place in it) of a URI as Spark writes it: a store that tasks read ranges from, and write whole files to."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition(":")
    if sep and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(uri if sep and len(scheme) > 1 else f"file://{uri}")
