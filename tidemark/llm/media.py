"""Content-addressed media payloads in tar shards.

A worker writes the payloads of its rows to a tar file in the shared folder, one member per content, named by the digest
of the payload; rows carry digest, shard, offset and length.  The stored form is a PNG of 8-bit grey samples, 64 in a
row, which is lossless.  Metadata columns come from reading the first bytes of a member, and payloads are read
back from the ranges that rows name.  A shard is written under another name and then renamed, and what it holds depends on
its rows alone, so a task that runs again leaves the same shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm._arrow import keep, shared_dir
from tidemark.sources.shared import filesystem

#: Samples in a row of an image; bytes of a shard beyond which the next one begins; level of compression.
WIDTH, SHARD_BYTES, LEVEL = 64, 1 << 30, 3
#: Bytes that hold a PNG's signature and its first chunk's header and data.
HEAD = 26
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def to_png(data: bytes) -> bytes:
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits of a sample) from a PNG's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> np.ndarray:
    """The samples of an image that to_png made, as rows."""
    width, height, _ = png_header(image[:HEAD])
    at, body = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if zlib.crc32(image[at + 4 : at + 8 + size]) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG's chunk is broken")
        if image[at + 4 : at + 8] == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:]


class ShardWriter:
    """Tar shards of one task; contents are written once."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder)
        self.task, self.number, self.out, self.seen = TaskContext.get().partitionId(), 0, None, {}

    def add(self, digest: str, make) -> tuple[str, int, int]:
        """(shard, offset, length) of the content."""
        if digest in self.seen:
            return self.seen[digest]
        if self.out is not None and self.at > SHARD_BYTES:
            self.close()
        if self.out is None:
            # of this attempt alone: rows name the shards of the attempt that they come from, and no file is replaced
            self.name, self.at = f"part-{self.task:06d}-{self.number:04d}-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.number += 1
        body = make()
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(body)
        self.out.write(member.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(body + bytes(-len(body) % 512))
        self.seen[digest] = self.name, self.at + 512, len(body)
        self.at += 512 + len(body) + -len(body) % 512
        return self.seen[digest]

    def close(self) -> None:
        if self.out is None:
            return
        self.out.write(bytes(1024))
        self.out.close()
        self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes texts as media below `folder` (a URI): doc_id, n_bytes, digest, shard, offset, length.

    Null is the empty text, whose payload is WIDTH zeros.  Equal texts of one task share a member.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                data = payload(raw)
                digest = hashlib.sha256(data).hexdigest()
                rows.append((len(raw), digest, *writer.add(digest, lambda data=data: to_png(data))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keep(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, digest string, shard string, offset bigint, length bigint"))


def metadata(stored: DataFrame, folder: str) -> DataFrame:
    """All columns and width, height, bits, from the first bytes of each member."""
    names = stored.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            rows, shard, source = [], None, None
            for name, offset in zip(batch.column(names.index("shard")).to_pylist(), batch.column(names.index("offset")).to_pylist()):
                if name != shard:
                    source, shard = fs.open_input_file(f"{path}/{name}"), name
                rows.append(png_header(source.read_at(HEAD, offset)))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int32()) for c in columns]], [*names, "width", "height", "bits"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stored.schema]
    return stored.mapInArrow(run, ", ".join([*fields, "width int", "height int", "bits int"]))


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation and the shares of eight ranges of samples in thousandths."""
    shares = np.bincount(samples.reshape(-1) >> 5, minlength=8) * 1000 // samples.size
    return f"{len(samples)}:{samples.mean():.4f}:{samples.std():.4f}:" + ",".join(map(str, shares))


def read_back(stored: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height."""
    headed = metadata(stored, folder)
    names = headed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            rows, shard, source, known = [], None, None, {}
            for name, offset, length in zip(*(batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if name != shard:
                    source, shard, known = fs.open_input_file(f"{path}/{name}"), name, {}
                if offset not in known:
                    image = source.read_at(length, offset)
                    samples = from_png(image)
                    data = samples.tobytes()
                    known[offset] = len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)
                rows.append(known[offset])
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            pick = lambda c: batch.column(names.index(c))
            yield pa.RecordBatch.from_arrays([pick("doc_id"), pick("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds)], pick("width"), pick("height")], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return headed.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores all texts and reads them back; see store and read_back.

    Rows are independent: nulls and empty texts have a payload of zeros, repeated rows have equal values, other columns are
    ignored, and an empty frame writes no shard.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    return read_back(store(docs, folder), folder)
