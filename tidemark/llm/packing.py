"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A piece of r tokens is of class j = capacity // r, the reciprocal class (capacity / (j + 1), capacity / j], and a
sequence of class j takes exactly j pieces, whatever their sizes are.  So a worker needs no more than the open sequence of
each class, and workers fill sequences independently of each other.

Documents may be cut.  Whole capacities are cut off first.  What remains is kept in one piece where j of its kind fill
a sequence but for `slack`, or where it is short; else a piece of the next class's full size is cut off and the rest is
treated likewise.

What workers leave in open sequences, a bounded amount for each of them, is packed again by class over TEAM workers, what those
leave over TEAM such teams, and so on; the last
open sequence of each class, a bounded amount altogether, is laid end to end and cut where a sequence is full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm._arrow import keep, prepare

#: Part of a sequence that a class may leave empty before a piece is cut, and the length below which none is cut.
SLACK, SHORT = 1 / 128, 64
#: Workers, or teams of them, whose open sequences are packed again together, and the number of the last level's sequences.
TEAM, LAST = 256, 15


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    found = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        per = capacity // rest
        if rest < SHORT or per * rest >= capacity * (1 - SLACK):
            found.append(rest)
            break
        found.append(capacity // (per + 1))
        rest -= found[-1]
    return found


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "kind", "ids"]


class Filler:
    """Open sequences of one worker.  Rows are lists in the order of FIELDS; ids stay with a row until it is placed."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, defaultdict(list)

    def add(self, row: list) -> list[list]:
        """The rows of a sequence that this one fills."""
        waiting = self.open[row[7]]
        waiting.append(row)
        if len(waiting) < row[7]:
            return []
        self.open[row[7]] = []
        at = 0
        for r in waiting:
            r[5], r[6], r[8] = self.next, at, None
            at += r[2]
        self.next += 1
        return waiting

    def rest(self) -> list[list]:
        return [r for rows in self.open.values() for r in rows]


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, kind int, ids binary"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """Packs all documents: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, capacity.

    A document is its ids and the id `end`.  Null and empty texts are that one id.  Every row is a document of its own,
    so repeated rows and equal or null doc_ids are all packed.  Other columns are ignored; an empty frame packs nothing.
    Sequences count from offset 0 without gaps; all but the last are full but for the slack of their class.
    """
    prepare(docs.sparkSession)
    schema = _schema(docs)
    stop = bpe.Codec.pack([end])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.codec(tokenizer, library=True)
        filler = Filler(capacity, TaskContext.get().partitionId() << 32)

        def batch(rows: list[list], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 9
            kinds = [like, *[pa.int64()] * 6, pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FIELDS)

        like = None
        for given in batches:
            like, done = given.schema.field(0).type, []
            for doc, text in zip(given.column(0).to_pylist(), given.column(1)):
                ids = coder.encode(text.as_py() or "") + stop
                tokens, at = len(ids) // 4, 0
                for size in cuts(tokens, capacity):
                    part = ids[4 * at : 4 * (at + size)]
                    done += filler.add([doc, at, size, zlib.crc32(part), tokens, None, None, capacity // size, part if size < capacity else None])
                    at += size
            yield batch(done, like)
        if like is not None:
            yield batch(filler.rest(), like)

    placed = keep(docs.select("doc_id", "text").mapInArrow(work, schema))

    def rows_of(table: pa.Table) -> list[list]:
        """Rows in an order that does not follow their arrival; ids stay whole numbers beside nulls."""
        rows = [list(r) for r in zip(*[table.column(f).to_pylist() for f in FIELDS])]
        return sorted(rows, key=lambda r: (r[7], r[1], r[3], r[4], r[0] is None, r[0] or 0))

    def table_of(rows: list[list], table: pa.Table) -> pa.Table:
        kinds = table.select(FIELDS).schema
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    def again(level: int):
        def fill(table: pa.Table) -> pa.Table:
            team, kind = table.column("team")[0].as_py(), table.column("kind")[0].as_py()
            filler, done = Filler(capacity, level << 58 | team << 40 | kind << 29), []
            for row in rows_of(table):
                done += filler.add(row)
            return table_of(done + filler.rest(), table)

        return fill

    parts = [placed.where("sequence_id is not null")]
    left, teams, level = placed.where("sequence_id is null"), placed.rdd.getNumPartitions(), 0
    while not level or teams > 1:
        teams, level = -(-teams // TEAM), level + 1
        left = left.withColumn("team", F.pmod(F.xxhash64("ids_crc32", "start"), F.lit(teams)))
        filled = keep(left.groupBy("team", "kind").applyInArrow(again(level), schema))
        parts.append(filled.where("sequence_id is not null"))
        left = filled.where("sequence_id is null")

    def lay(table: pa.Table) -> pa.Table:
        done, sequence, used = [], LAST << 58, 0
        for doc, start, length, _, tokens, _, _, kind, ids in rows_of(table):
            while length:
                size = min(length, capacity - used)
                done.append([doc, start, size, zlib.crc32(ids[: 4 * size]), tokens, sequence, used, kind, None])
                start, length, ids, used = start + size, length - size, ids[4 * size :], used + size
                if used == capacity:
                    sequence, used = sequence + 1, 0
        return table_of(done, table)

    parts.append(left.withColumn("team", F.lit(0)).groupBy("team").applyInArrow(lay, schema))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.lit(capacity).alias("capacity"))
