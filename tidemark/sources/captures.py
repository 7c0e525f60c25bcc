"""Captures: packets of pcap and pcapng files, zip members, hellos, pre-TLS buffers, certificates' PEM.

Files come through Spark's binaryFile source, so any store that Spark reads will do; bytes are parsed in Arrow batches.  Files
of more than WHOLE bytes are never one row: an index cuts them into ranges that tasks read for themselves (`packets_at`).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import blocks
from tidemark.sources.shared import filesystem

#: Bytes beyond which a file, or a zip's member, is no longer one row's content.
WHOLE = 100 * 1024 * 1024
PACKET = "capture string, pkt_no int, at double, src string, sport int, dst string, dport int, seq bigint, payload binary"
SERVER_HELLO = "legacy int, cipher int, extensions array<int>, selected int"
HELLO = "legacy int, ciphers array<int>, extensions array<int>, groups array<int>, signatures array<int>, supported array<int>, ticket_age bigint"


def files(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(name, content, large, malformed) of files, with the members of zip files in their place.

    Spark's source leaves out empty files.  What is larger than `whole` has its row too, without content and with `large`; `packets_at` reads it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = raw.where(F.col("length") <= whole).select("path", "content")
    far = raw.where(F.col("length") > whole).select(F.col("path").alias("name"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("large"))

    def members(name: str, body: bytes) -> Iterator[tuple[str, bytes | None]]:
        if not zipfile.is_zipfile(io.BytesIO(body)):
            yield name, body
            return
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield f"{name}!{m.filename}", z.read(m) if m.file_size <= whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[1] is None for r in rows], pa.bool_())], ["name", "content", "large"])
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                # what a zip file holds may be many times its size
                rows, size = [], 0
                for row in members(name.as_py(), body.as_py()):
                    rows.append(row)
                    size += len(row[1] or b"")
                    if size >= BATCH:
                        yield told(rows)
                        rows, size = [], 0
                if rows:
                    yield told(rows)

    read = small.mapInArrow(run, "name string, content binary, large boolean")
    return read.unionByName(far).withColumn("malformed", ~F.col("large") & malformed(F.col("name"), F.col("content")))


def malformed(name: Column, content: Column) -> Column:
    """The wrong ending, too few bytes, or no known magic; zip files are as good as what is in them."""
    magic = F.hex(F.substring(content, 1, 4))
    capture = magic.isin("D4C3B2A1", "A1B2C3D4", "0A0D0D0A", "4D3CB2A1", "A1B23C4D") & F.lower(name).rlike(r"\.(pcap|pcapng|cap)$")
    return (F.octet_length(content) < 10) | ~(capture | F.lower(name).rlike(r"\.zip$") & (magic == "504B0304"))


def tcp_of(link: int, frame: bytes) -> tuple | None:
    """(src, sport, dst, dport, seq, payload) of a frame with a TCP payload."""
    start = {1: 14, 101: 0, 113: 16, 228: 0, 229: 0}.get(link)
    if start is None or len(frame) < start + 20:
        return None
    if link == 1 and frame[12:14] == b"\x81\x00":
        start += 4
    ip = frame[start:]
    if len(ip) < 20:
        return None
    if ip[0] >> 4 == 4 and ip[9] == 6:
        tcp, whole = ip[(ip[0] & 15) * 4 :], struct.unpack(">H", ip[2:4])[0] - (ip[0] & 15) * 4
        src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
    elif ip[0] >> 4 == 6 and len(ip) >= 40 and ip[6] == 6:
        tcp, whole, src, dst = ip[40:], struct.unpack(">H", ip[4:6])[0], "0.0.0.0", "0.0.0.0"
    else:
        return None
    if len(tcp) < 20:
        return None
    sport, dport, seq = struct.unpack(">HHI", tcp[:8])
    payload = tcp[(tcp[12] >> 4) * 4 : whole]
    return (src, sport, dst, dport, seq, payload) if payload else None


def parse_packets(f: io.BufferedIOBase | None, state: blocks.State | None = None, stop: int | None = None) -> Iterator[tuple]:
    """(number, time, src, sport, dst, dport, seq, payload) of TCP packets with a payload, of a file or of a range with its state."""
    state = state or blocks.begin(f)
    if state is not None:
        for _, at, link, frame in blocks.walk(f, state, stop):
            if told := tcp_of(link, frame):
                yield state.number, at, *told


PACKET_KINDS = (pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
PACKET_NAMES = [f.split()[0] for f in PACKET.split(", ")]
#: Bytes of payloads that a batch of packets holds.
BATCH = 4 << 20


def _batches(name: str, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for p in found:
        rows.append((name, *p))
        size += len(p[-1])
        if size >= BATCH or len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), PACKET_KINDS)], PACKET_NAMES)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), PACKET_KINDS)], PACKET_NAMES)


def packets(captures: DataFrame) -> DataFrame:
    """The packets of (name, content); a null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _batches(name, parse_packets(io.BytesIO(body.as_py() or b"")))

    return captures.select("name", "content").mapInArrow(run, PACKET)


def packets_at(spark: SparkSession, path: str, whole: int = WHOLE, split: int = blocks.SPLIT) -> DataFrame:
    """The packets of all files at a path, however large a file is.

    Files up to `whole` bytes are rows.  A larger one is indexed by one task, which reads its headers, and parsed in ranges of `split` bytes
    by many; members of a large zip file can't be read from the middle, so one task streams them.
    """
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > whole).select("path")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    zipped = f.read(4) == b"PK\3\4"
                    f.seek(0)
                    rows = [(name, -1, None, None)] if zipped else [(name, *r) for r in blocks.ranges(f, split)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["name", "start", "stop", "state"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["name"]) as f:
                    if r["state"] is None:
                        with zipfile.ZipFile(f) as z:
                            for m in z.infolist():
                                if not m.is_dir() and m.file_size > r["start"]:
                                    with z.open(m) as member:
                                        yield from _batches(f"{r['name']}!{m.filename}", parse_packets(member))
                        continue
                    f.seek(r["start"])
                    yield from _batches(r["name"], parse_packets(f, blocks.State.of(r["state"]), r["stop"]))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                body = io.BytesIO(body.as_py())
                if zipfile.is_zipfile(body) and any(m.file_size > whole for m in zipfile.ZipFile(body).infolist() if not m.is_dir()):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()])], ["name"])

    # a row to a task, as a row is a file or a range of one
    ranges = large.repartition(F.col("path")).mapInArrow(index, "name string, start bigint, stop bigint, state string").repartition(F.col("name"), F.col("start"))
    small = files(spark, path, whole)
    # members of a small zip that are large themselves are streamed from it; its directory tells, so nothing is unpacked for that
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = raw.where((F.col("length") <= whole) & (F.hex(F.substring("content", 1, 4)) == "504B0304")).select("path", "content").mapInArrow(holding, "name string")
    streamed = inner.select("name", F.lit(whole).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast("string").alias("state"))
    return packets(small.where("not large and not malformed")).unionByName(ranges.unionByName(streamed).mapInArrow(parse, PACKET))


def opened(path: str) -> io.BufferedReader:
    """A file of the store, buffered; ranges of it are read without the rest."""
    store, place = filesystem(path)
    return io.BufferedReader(store.open_input_file(place), 1 << 20)


class Reader:
    """Reads big-endian fields; past the end it gives nothing more."""

    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def take(self, n: int) -> bytes:
        found = self.body[self.at : self.at + n]
        self.at += n
        return found

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n))

    def block(self, n: int) -> Reader:
        return Reader(self.take(self.number(n)))

    def numbers(self, n: int) -> list[int]:
        return [int.from_bytes(self.body[i : i + n]) for i in range(self.at, len(self.body) - n + 1, n)]

    def more(self) -> bool:
        return self.at < len(self.body)


def parse_hello(payload: bytes) -> dict | None:
    """The client hello of a TLS record, or None."""
    start = payload.find(b"\x16\x03")
    if start < 0 or payload[start + 5 : start + 6] != b"\x01":
        return None
    r = Reader(payload[start + 9 :])
    found = {"legacy": r.number(2), "ciphers": [], "extensions": [], "groups": [], "signatures": [], "supported": [], "ticket_age": None}
    r.take(32)
    r.block(1)
    found["ciphers"] = r.block(2).numbers(2)
    r.block(1)
    e = r.block(2)
    while e.more() and e.at + 4 <= len(e.body):
        kind, body = e.number(2), e.block(2)
        found["extensions"].append(kind)
        if kind == 0x000A:
            found["groups"] = body.block(2).numbers(2)
        elif kind == 0x000D:
            found["signatures"] = body.block(2).numbers(2)
        elif kind == 0x002B:
            found["supported"] = body.block(1).numbers(2)
        elif kind == 0x0029 and len(body.body) >= 6:
            body.take(2)
            body.block(2)
            age = body.take(4)
            found["ticket_age"] = int.from_bytes(age) if len(age) == 4 else None
    return found


def parse_server_hello(payload: bytes) -> dict | None:
    """The server hello of a TLS record, or None; `selected` is the version of its supported-versions extension."""
    start = payload.find(b"\x16\x03")
    if start < 0 or payload[start + 5 : start + 6] != b"\x02":
        return None
    r = Reader(payload[start + 9 : start + 9 + int.from_bytes(payload[start + 6 : start + 9])])
    found = {"legacy": r.number(2), "extensions": [], "selected": None}
    r.take(32)
    r.block(1)
    found["cipher"] = r.number(2) if r.at + 2 <= len(r.body) else None
    r.take(1)
    e = r.block(2)
    while e.more() and e.at + 4 <= len(e.body):
        kind, body = e.number(2), e.block(2)
        found["extensions"].append(kind)
        if kind == 0x002B and len(body.body) == 2:
            found["selected"] = body.number(2)
    return found


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}


def _first(packets_: DataFrame, parse, fields: str, by: list[str]) -> DataFrame:
    """The first packet of each group, by number, that parses, with its fields."""
    told = [f.split() for f in fields.split(", ")]
    keys = [*by, "pkt_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, h) for k, p in enumerate(batch.column(len(keys)).to_pylist()) if (h := parse(p))]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], *[pa.array([h[n] for _, h in found], ARROW[t]) for n, t in told]], [*keys, *[n for n, _ in told]])

    kinds = ", ".join(f"{k} {packets_.schema[k].dataType.simpleString()}" for k in keys)
    some = packets_.where(F.hex("payload").contains("1603")).select(*keys, "payload").mapInArrow(run, f"{kinds}, {fields}")
    return some.groupBy(*by).agg(F.min_by(F.struct("pkt_no", *[n for n, _ in told]), "pkt_no").alias("h")).select(*by, "h.*")


def hellos(packets_: DataFrame, *by: str) -> DataFrame:
    """The first client hello of each capture, or of each group by other columns of packets."""
    return _first(packets_, parse_hello, HELLO, [*by] or ["capture"])


def server_hellos(packets_: DataFrame, *by: str) -> DataFrame:
    """The first server hello likewise."""
    return _first(packets_, parse_server_hello, SERVER_HELLO, [*by] or ["capture"])


def pre_tls_buffer(hex_: Column) -> Column:
    """Bytes between the last server greeting's line end and the first handshake record, from hex text.

    Positions are even, so a match across bytes doesn't count.
    """
    even = lambda h, mark: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 3, F.lit(1)), F.lit(2)), lambda i: F.when(h.substr(i, F.lit(len(mark))) == mark, (i - 1) / 2)), lambda x: x.isNotNull())
    tls = F.try_element_at(even(hex_, "1603"), F.lit(1))
    before = hex_.substr(F.lit(1), (tls * 2).cast("int"))
    marks = F.array_max(F.concat(*[even(before, m) for m in ("323230", "2A204F4B", "2B4F4B")]))
    ends = F.filter(even(before, "0D0A"), lambda x: x >= marks)
    eol = F.coalesce(F.try_element_at(ends, F.lit(1)) + 2, marks)
    return F.when(tls.isNull() | marks.isNull(), 0).otherwise(F.greatest(F.lit(0), tls - eol)).cast("int")


def certificates(text: DataFrame) -> DataFrame:
    """(name, nr, der) of the certificates of PEM texts (name, text)."""
    found = F.regexp_extract_all("text", F.lit("-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\\s]+)-----END CERTIFICATE-----"), F.lit(1))
    return text.select("name", F.posexplode(found).alias("nr", "body")).select("name", "nr", F.unbase64(F.regexp_replace("body", "\\s", "")).alias("der"))
