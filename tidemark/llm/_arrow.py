"""Arrow plumbing that the operators share.

Text reaches Python as Arrow buffers and is worked on as whole arrays of bytes; no operator builds a Python string
for each word.  Batches are cut by bytes, so memory does not follow the number of rows in a batch.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are turned into arrays at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18
#: Rows that Spark puts into one Arrow batch before it reaches Python.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, sees that there is a checkpoint folder and that workers can import this package.

    A folder that the cluster names in spark.checkpoint.dir is kept.  Only where none is named and all runs on this machine
    (tests) one below the temporary folder is set; a cluster without one is an error, as executors can't see local folders.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    root = Path(__file__).resolve().parents[2]
    seen = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in seen and not getattr(context, "_tidemark_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"tidemark-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "tidemark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(archive))
        context._tidemark_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder, as a URI, that the driver and all executors share."""
    prepare(spark)
    return spark.sparkContext.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage, in the shared checkpoint folder; it survives the loss of executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Frees the disk of frames that nothing refers to any longer.  Spark deletes shuffle files and checkpoints when the driver collects
    its garbage, which a driver that mostly waits for large stages doesn't do by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets from 0) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; every row is in exactly one."""
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of bounded slices of a text column."""
    data, at = utf8(column)
    for low, high in slices(at):
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]


def groups(batches: Iterator[pa.RecordBatch], *key: int) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (the columns at `key`, without nulls), over batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in key]
        differ = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[0].as_py() != x[0] for k, x in zip(key, keys)):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(low, high - low))
            if high < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
