"""Capture files of orders' flows, written to the shared folder and read again.

An order is a flow of a few segments between a client and a mail server; 64 orders make a capture, by turns pcap and pcapng of
either byte order and several clocks, and 256 captures a zip file, as the driver lists files and the disk holds them.  Numbers start just below 2^32, so they wrap within flows.  The SQL counts from the orders;
the queries have nothing but the files' bytes.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
from datetime import datetime, timezone
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import reassembly
from tidemark.plans.registry import query
from tidemark.sources import captures
from tidemark.sources.shared import filesystem, shared_dir
from tidemark.sources.tables import read

#: Orders of a capture, captures of a zip file.
FLOWS, CAPTURES = 64, 256
SUITES = [0x1301, 0x1302, 0xC02F, 0xC030, 0x009C, 0x002F]


def record(kind: int, body: bytes) -> bytes:
    message = bytes([kind]) + len(body).to_bytes(3) + body
    return b"\x16\3\1" + len(message).to_bytes(2) + message


def client_hello(suites: list[int], versions: list[int]) -> bytes:
    listed = b"".join(s.to_bytes(2) for s in suites)
    told = b"".join(v.to_bytes(2) for v in versions)
    extension = struct.pack(">HHB", 0x002B, len(told) + 1, len(told)) + told
    return record(1, b"\3\3" + bytes(32) + b"\0" + len(listed).to_bytes(2) + listed + b"\1\0" + len(extension).to_bytes(2) + extension)


def server_hello(suite: int, version: int | None) -> bytes:
    extension = struct.pack(">HHH", 0x002B, 2, version) if version else b""
    return record(2, b"\3\3" + bytes(32) + b"\0" + suite.to_bytes(2) + b"\0" + len(extension).to_bytes(2) + extension)


def frame(src: bytes, dst: bytes, sport: int, dport: int, seq: int, payload: bytes) -> bytes:
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 5 << 4, 0x18, 1024, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + src + dst
    return bytes(12) + b"\x08\0" + ip + tcp


def segments(k: int) -> list[tuple[bool, int, bytes]]:
    """(from the client, place in its bytes, payload) of an order's flow in the order of arrival."""
    hello = client_hello(SUITES[: 1 + k % 4], [0x0304, 0x0303] if k % 3 == 0 else [0x0303])
    sent = [(True, 0, b"EHLO a.example\r\n"), (True, 16, b"STARTTLS\r\n"), (True, 26, hello)]
    # one segment again, two in the wrong order, one lost, one again with more at its end
    sent = {1: [sent[0], sent[1], sent[1], sent[2]], 2: [sent[1], sent[0], sent[2]], 3: [sent[0], sent[2]], 4: [sent[0], (True, 8, sent[0][2][8:] + sent[1][2]), sent[2]]}.get(k % 5, sent)
    return [(False, 0, b"220 mail ready\r\n"), *sent, (False, 16, server_hello(SUITES[k % 4], 0x0304 if k % 3 == 0 else None))]


def capture(file: int, orders: list[tuple[int, int, datetime]]) -> bytes:
    """The file of (key, customer, time)."""
    packets = []
    for k, customer, at in orders:
        client, server = bytes([10, customer >> 16 & 255, customer >> 8 & 255, customer & 255]), b"\xc0\0\2\1"
        for nr, (own, place, payload) in enumerate(segments(k)):
            ends = (client, server, 1024 + k % FLOWS, 587) if own else (server, client, 587, 1024 + k % FLOWS)
            packets.append((int(at.timestamp()) * 1000 + 10 * nr, frame(*ends, 2**32 - 1 - k % 40 + place, payload)))
    if file % 2 == 0:
        order, fine = (">", True) if file % 4 else ("<", False)
        head = struct.pack(order + "IHHiIII", 0xA1B23C4D if fine else 0xA1B2C3D4, 2, 4, 0, 0, 1 << 16, 1)
        return head + b"".join(struct.pack(order + "4I", t // 1000, t % 1000 * (10**6 if fine else 1000), len(f), len(f)) + f for t, f in packets)
    order, digits = (">", 9) if file % 4 == 3 else ("<", 3)
    block = lambda kind, body: struct.pack(order + "II", kind, 12 + len(body) + -len(body) % 4) + body + bytes(-len(body) % 4) + struct.pack(order + "I", 12 + len(body) + -len(body) % 4)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHIHHB3xHH", 1, 0, 1 << 16, 9, 1, digits, 0, 0)) + block(5, bytes(8))
    for t, f in packets:
        count = t * 10 ** (digits - 3)
        out += block(6, struct.pack(order + "5I", 0, count >> 32, count & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def recorded(spark, sf: str) -> str:
    """The folder of the captures of all orders, FLOWS orders to a capture and CAPTURES captures to a zip file."""
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    store, place = filesystem(folder)
    store.create_dir(place)

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("o_orderkey", "o_custkey", "at")]))
        archive, made = rows[0][0] // (FLOWS * CAPTURES), 0
        store, place = filesystem(f"{folder}/{archive}.zip")
        # a task that runs again writes the same bytes
        with store.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for file, own in groupby(rows, lambda r: r[0] // FLOWS):
                body = capture(file, [(k, c, datetime.fromtimestamp(t, timezone.utc)) for k, c, t in own])
                z.writestr(zipfile.ZipInfo(f"{file}.{'pcapng' if file % 2 else 'pcap'}"), body, zipfile.ZIP_DEFLATED, 1)
                made += 1
        return pa.table({"archive": pa.array([archive], pa.int64()), "captures": pa.array([made], pa.int64())})

    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    orders.groupBy(F.floor(F.col("o_orderkey") / (FLOWS * CAPTURES)).alias("archive")).applyInArrow(write, "archive bigint, captures bigint").write.format("noop").mode("overwrite").save()
    return folder


def flows(packets: DataFrame) -> DataFrame:
    """Packets with their order (from the file's name and the client's port) and direction."""
    file = F.regexp_extract("capture", r"([0-9]+)\.pcap", 1).cast("bigint")
    own = F.col("dport") == 587
    return packets.select((file * FLOWS + F.when(own, F.col("sport")).otherwise(F.col("dport")) - 1024).alias("o_orderkey"), own.alias("client"), "pkt_no", "at", "src", "seq", F.octet_length("payload").alias("len"), "payload")


@query("""select o_orderkey, case o_orderkey % 5 when 1 then 4 when 3 then 2 else 3 end as packets, o_custkey // 65536 % 256 || '.' || o_custkey // 256 % 256 || '.' || o_custkey % 256 as client, epoch(o_orderdate)::bigint as first_second, 10 as first_milliseconds from orders""")
def captured_packets(spark, sf):
    """Client packets of each flow, its address and the time of the first, from pcap and pcapng files alike."""
    found = flows(captures.packets_at(spark, recorded(spark, sf))).where("client").groupBy("o_orderkey")
    first = F.min(F.round(F.col("at") * 1000).cast("bigint"))
    return found.agg(F.count("*").alias("packets"), F.regexp_replace(F.first("src"), "^10[.]", "").alias("client"), F.floor(first / 1000).alias("first_second"), (first % 1000).alias("first_milliseconds"))


@query("""with f as (select o_orderkey as k, 59 + 2 * (o_orderkey % 4) + case when o_orderkey % 3 = 0 then 2 else 0 end as h from orders)
select k as o_orderkey, case k % 5 when 1 then 4 when 3 then 2 else 3 end as packets, case k % 5 when 1 then 36 + h when 3 then 16 + h when 4 then 34 + h else 26 + h end as total_bytes, case k % 5 when 3 then 16 + h else 26 + h end as reassembled,
case when k % 5 = 3 then 10 else 0 end as gap_bytes, k % 5 in (1, 4) as has_overlap from f""")  # fmt: skip
def captured_reassembly(spark, sf):
    """Coverage of each client's bytes, over numbers that wrap."""
    found = flows(captures.packets_at(spark, recorded(spark, sf))).where("client").select(F.col("o_orderkey").alias("flow"), "pkt_no", "seq", "len")
    covered = reassembly.coverage(reassembly.walk(reassembly.unwrapped(found)))
    return covered.select(F.col("flow").alias("o_orderkey"), "packets", "total_bytes", "reassembled", "gap_bytes", "has_overlap")


@query("""select o_orderkey, array_to_string([4865, 4866, 49199, 49200][:1 + o_orderkey % 4], ',') as ciphers, case when o_orderkey % 3 = 0 then '772,771' else '771' end as supported, [4865, 4866, 49199, 49200][o_orderkey % 4 + 1] as cipher, case when o_orderkey % 3 = 0 then 772 end as selected from orders""")
def captured_hellos(spark, sf):
    """The first client and server hello of each flow."""
    found = flows(captures.packets_at(spark, recorded(spark, sf)))
    client, server = captures.hellos(found.where("client"), "o_orderkey"), captures.server_hellos(found.where("not client"), "o_orderkey")
    return client.join(server.select("o_orderkey", "cipher", "selected"), "o_orderkey").select("o_orderkey", F.array_join("ciphers", ",").alias("ciphers"), F.array_join("supported", ",").alias("supported"), "cipher", "selected")
