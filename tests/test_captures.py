"""Capture files: both formats, ranges of large files, zip members, damage, hellos; numbers that wrap."""

import io
import random
import struct
import zipfile
from datetime import datetime, timezone

import pytest

from tidemark.operators import reassembly
from tidemark.plans import recordings as r
from tidemark.sources import blocks, captures

ORDERS = [(k, 70_000 + k, datetime(2024, 5, 1, 12, 0, k % 60, tzinfo=timezone.utc)) for k in range(60)]


def rows(found):
    return sorted((x.pkt_no, round(x.at, 3), x.src, x.sport, x.dst, x.dport, x.seq, bytes(x.payload)) for x in found)


@pytest.fixture(scope="module")
def want():
    return [(n, round(t, 3), *p) for n, t, *p in captures.parse_packets(io.BytesIO(r.capture(0, ORDERS)))]


def test_both_formats_all_orders_and_clocks_give_equal_rows(spark, tmp_path, want):
    assert len(want) == sum(len(r.segments(k)) for k, _, _ in ORDERS)
    for file in range(4):
        (tmp_path / f"{file}.{'pcapng' if file % 2 else 'pcap'}").write_bytes(r.capture(file, ORDERS))
    found = captures.packets_at(spark, str(tmp_path)).collect()
    for name in ("0.pcap", "1.pcapng", "2.pcap", "3.pcapng"):
        assert rows([x for x in found if x.capture.endswith(f"/{name}")]) == sorted(want)


def test_large_files_and_members_give_all_of_their_packets(spark, tmp_path, want):
    for file in range(4):
        (tmp_path / f"{file}.{'pcapng' if file % 2 else 'pcap'}").write_bytes(r.capture(file, ORDERS))
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/large.pcap", r.capture(0, ORDERS))
        z.writestr("in/small.pcap", r.capture(0, ORDERS[:1]))
    with zipfile.ZipFile(tmp_path / "stored.zip", "w") as z:
        z.writestr("x.pcapng", r.capture(1, ORDERS))
    sizes = {p.name: p.stat().st_size for p in tmp_path.iterdir()}
    whole = sizes["many.zip"] + 1
    assert sizes["stored.zip"] > whole and sizes["0.pcap"] > whole
    told = {x.name.rsplit("/", 1)[-1]: (x.large, x.malformed, x.content is None) for x in captures.files(spark, str(tmp_path), whole).collect()}
    assert told["0.pcap"] == told["stored.zip"] == (True, False, True) and told["large.pcap"] == (True, False, True) and told["small.pcap"] == (False, False, False)
    found = captures.packets_at(spark, str(tmp_path), whole, split=3000).collect()
    by = {}
    for x in found:
        by.setdefault(x.capture.rsplit("/", 1)[-1], []).append(x)
    for name in ("0.pcap", "1.pcapng", "2.pcap", "3.pcapng", "large.pcap", "stored.zip!x.pcapng"):
        assert rows(by[name]) == sorted(want), name
    assert len(by["small.pcap"]) == len(r.segments(0))


def test_ranges_hold_what_a_reader_must_know(want):
    for file in range(4):
        body = r.capture(file, ORDERS)
        cut = list(blocks.ranges(io.BytesIO(body), 2000))
        assert len(cut) > 5 and cut[-1][1] is None and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        found = []
        for start, stop, told in cut:
            f = io.BytesIO(body)
            f.seek(start)
            found += [(n, round(t, 3), *p) for n, t, *p in captures.parse_packets(f, blocks.State.of(told), stop)]
        assert found == want


def section(order, *interfaces):
    block = lambda kind, body: struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link, digits, offset in interfaces:
        out += block(1, struct.pack(order + "HHI", link, 0, 0) + struct.pack(order + "HHB3x", 9, 1, digits) + struct.pack(order + "HHq", 14, 8, offset) + struct.pack(order + "HH", 0, 0))
    return out, block


def test_sections_have_their_own_order_and_interfaces_their_own_clocks():
    ethernet = r.frame(b"\1\2\3\4", b"\5\6\7\10", 9, 25, 7, b"data")
    out, pad = b"", lambda f: f + bytes(-len(f) % 4)
    for order in "<>":
        head, block = section(order, (1, 6, 100), (101, 0x80 | 10, 0))
        out += head
        for nr, f, ticks in ((0, ethernet, 10**6), (1, ethernet[14:], 1024)):
            count = 5 * ticks + ticks // 2
            out += block(6, struct.pack(order + "5I", nr, count >> 32, count & 0xFFFFFFFF, len(f), len(f)) + pad(f))
        out += block(6, struct.pack(order + "5I", 9, 0, 0, len(ethernet), len(ethernet)) + pad(ethernet))  # an interface that there isn't
        out += block(3, struct.pack(order + "I", len(ethernet)) + pad(ethernet)) + block(0x80000001, b"own!")
    found = list(captures.parse_packets(io.BytesIO(out)))
    assert [(n, t) for n, t, *_ in found] == [(1, 105.5), (2, 5.5), (4, None), (5, 105.5), (6, 5.5), (8, None)]
    assert {p[2:] for p in found} == {("1.2.3.4", 9, "5.6.7.8", 25, 7, b"data")}


def test_damage_ends_a_file_early(spark, tmp_path):
    for file in (0, 1):
        body = r.capture(file, ORDERS[:5])
        whole = len(list(captures.parse_packets(io.BytesIO(body))))
        for cut in range(0, len(body), 37):
            found = list(captures.parse_packets(io.BytesIO(body[:cut])))
            assert len(found) <= whole
            assert list(blocks.ranges(io.BytesIO(body[:cut]), 500)) is not None
        assert len(list(captures.parse_packets(io.BytesIO(body[:-300] + b"\xff" * 300)))) < whole
    for name, body in {"empty.pcap": b"", "text.pcap": b"no capture at all", "bad.zip": b"PK\3\4 no zip file", "ok.pcap": r.capture(0, ORDERS[:1])}.items():
        (tmp_path / name).write_bytes(body)
    told = {x.name.rsplit("/", 1)[-1]: x.malformed for x in captures.files(spark, str(tmp_path)).collect()}
    assert "empty.pcap" not in told and told["text.pcap"] and not told["ok.pcap"]
    assert {x.capture.rsplit("/", 1)[-1] for x in captures.packets_at(spark, str(tmp_path)).collect()} == {"ok.pcap"}


def test_server_hello():
    h = captures.parse_server_hello(r.server_hello(0x1301, 0x0304))
    assert h == {"legacy": 0x0303, "extensions": [0x2B], "selected": 0x0304, "cipher": 0x1301}
    assert captures.parse_server_hello(r.client_hello([1], [2])) is None and captures.parse_server_hello(r.server_hello(1, None)[:20])["cipher"] is None


def test_numbers_that_wrap(spark):
    rng, rows_, want_ = random.Random(4), [], {}
    for flow in range(30):
        start, at, true = rng.randrange(2**32), 0, []
        for _ in range(rng.randrange(1, 40)):
            size = rng.randrange(1, 2**29)
            true.append((at, size))
            at += size
        for k in range(0, len(true) - 1, 3):  # late ones, some from before a wrap
            true[k], true[k + 1] = true[k + 1], true[k]
        rows_ += [(flow, nr, (start + place) % 2**32, size) for nr, (place, size) in enumerate(true)]
        want_[flow] = true
    df = spark.createDataFrame(rows_, "flow int, pkt_no int, seq bigint, len bigint").repartition(3)
    got = {}
    for x in reassembly.unwrapped(df).collect():
        got.setdefault(x.flow, {})[x.pkt_no] = x.seq
    for flow, true in want_.items():
        first = got[flow][0] - true[0][0]
        assert [got[flow][nr] - first for nr in range(len(true))] == [place for place, _ in true]
    covered = reassembly.coverage(reassembly.walk(reassembly.unwrapped(df))).collect()
    assert all(x.gap_bytes == 0 and not x.has_overlap and x.reassembled == x.total_bytes for x in covered)


def test_captures_of_many_orders_are_few_files(spark, sf):
    from pathlib import Path

    from tidemark.sources.tables import read

    folder = Path(r.recorded(spark, sf).removeprefix("file:"))
    files = [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")]
    keys = {x.o_orderkey for x in read(spark, sf, "orders").select("o_orderkey").collect()}
    assert len(files) == len({k // 16384 for k in keys}) < len({k // 64 for k in keys}) / 10
    assert sum(p.stat().st_size for p in files) < 200 * len(keys)
    assert {x.capture.rsplit("!", 1)[-1] for x in captures.packets_at(spark, str(folder)).select("capture").distinct().collect()} == {f"{k}.{'pcapng' if k % 2 else 'pcap'}" for k in {k // 64 for k in keys}}
