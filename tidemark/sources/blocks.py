"""The blocks of capture files: pcap and pcapng, from any place whose state is known.

A capture is a chain of blocks, so where a packet begins is known only from the one before it.  An index walks the headers
alone, in bounded memory, and notes about every SPLIT bytes where a packet begins and what a reader must know there: byte
order, interfaces with their link types and clocks, and how many packets came before.  Ranges between such places are then
parsed by different tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: Bytes of a range that one task parses.
SPLIT = 64 << 20
# fixed values: magic numbers, block types and options of the two formats
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, ORDERS = b"\x0a\x0d\x0d\x0a", {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
INTERFACE, OLD_PACKET, SIMPLE_PACKET, ENHANCED_PACKET = 1, 2, 3, 6
RESOLUTION, OFFSET = 9, 14
#: Larger blocks than this are no blocks but damage.
LARGEST = 1 << 28


class State:
    """What a reader must know at a packet: format, byte order, interfaces as [link type, ticks a second, offset, longest packet], packets before it."""

    def __init__(self, kind: str = "", order: str = "<", interfaces: list | None = None, number: int = 0):
        self.kind, self.order, self.interfaces, self.number = kind, order, interfaces or [], number

    def told(self) -> str:
        return json.dumps([self.kind, self.order, self.interfaces, self.number])

    @classmethod
    def of(cls, told: str) -> State:
        return cls(*json.loads(told))


def begin(f: BinaryIO) -> State | None:
    """The state at a file's first block, read from its head; None if it is no capture."""
    head = f.read(4)
    if head in PCAP:
        order, ticks = PCAP[head]
        rest = f.read(20)
        if len(rest) < 20:
            return None
        longest, link = struct.unpack(order + "8xII", rest[4:])
        return State("pcap", order, [[link & 0xFFFF, ticks, 0, longest]])
    if head == SECTION:
        f.seek(-4, 1)
        return State("pcapng")
    return None


def options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "HH", body[at : at + 4])
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + size + -size % 4


def interface(body: bytes, order: str) -> list:
    link, longest = struct.unpack(order + "H2xI", body[:8])
    ticks, offset = 10**6, 0
    for code, value in options(body[8:], order):
        if code == RESOLUTION and value:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == OFFSET and len(value) == 8:
            offset = struct.unpack(order + "q", value)[0]
    return [link, ticks, offset, longest]


def walk(f: BinaryIO, state: State, stop: int | None = None, bodies: bool = True) -> Iterator[tuple[int, float | None, int, bytes | None]]:
    """(place, time, link type, frame) of each packet that begins before `stop`; the state follows along.

    A file that is cut off ends early, and so does one whose next block can't be one.  Without bodies frames are None and are skipped over.
    """
    while stop is None or f.tell() < stop:
        place = f.tell()
        if state.kind == "pcap":
            head = f.read(16)
            if len(head) < 16:
                return
            seconds, fraction, size, _ = struct.unpack(state.order + "4I", head)
            if size > LARGEST:
                return
            link, ticks = state.interfaces[0][:2]
            frame = f.read(size) if bodies else None
            if not bodies:
                f.seek(size, 1)
            state.number += 1
            yield place, seconds + fraction / ticks, link, frame
            continue
        head = f.read(8)
        if len(head) < 8:
            return
        if head[:4] == SECTION:
            mark = f.read(4)
            if mark not in ORDERS:
                return
            state.order, state.interfaces = ORDERS[mark], []
            size = struct.unpack(state.order + "I", head[4:])[0]
            if not 28 <= size <= LARGEST:
                return
            f.seek(size - 12, 1)
            continue
        kind, size = struct.unpack(state.order + "II", head)
        if not 12 <= size <= LARGEST:
            return
        size += -size % 4
        if kind == INTERFACE:
            body = f.read(size - 12)
            if len(body) < size - 12:
                return
            state.interfaces.append(interface(body, state.order))
            f.seek(4, 1)
            continue
        if kind not in (ENHANCED_PACKET, SIMPLE_PACKET, OLD_PACKET):
            f.seek(size - 8, 1)
            continue
        state.number += 1
        if not bodies:
            f.seek(size - 8, 1)
            yield place, None, 0, None
            continue
        body = f.read(size - 12)
        f.seek(4, 1)
        if len(body) < 4:
            return
        told = packet(kind, body, state)
        if told:
            yield place, *told


def packet(kind: int, body: bytes, state: State) -> tuple[float | None, int, bytes] | None:
    """(time, link type, frame) of a packet's block; None if its interface is unknown."""
    if kind == SIMPLE_PACKET:
        if not state.interfaces:
            return None
        link, _, _, longest = state.interfaces[0]
        size = struct.unpack(state.order + "I", body[:4])[0]
        return None, link, body[4 : 4 + min(size, longest or size)]
    if len(body) < 20:
        return None
    nr, high, low, size = struct.unpack(state.order + ("HxxIII" if kind == OLD_PACKET else "IIII"), body[:16])
    if nr >= len(state.interfaces):
        return None
    link, ticks, offset, _ = state.interfaces[nr]
    count = high << 32 | low
    return offset + count // ticks + count % ticks / ticks, link, body[20 : 20 + size]


def ranges(f: BinaryIO, split: int = SPLIT) -> Iterator[tuple[int, int | None, str]]:
    """(start, stop, state) of the ranges of a file, the last without a stop.  Reads headers only."""
    state = begin(f)
    if state is None:
        return
    start, told = f.tell(), state.told()
    for place, *_ in walk(f, state, bodies=False):
        if place - start >= split:
            yield start, place, told
            # as it was before this packet was counted
            start, told = place, State(state.kind, state.order, state.interfaces, state.number - 1).told()
    yield start, None, told
