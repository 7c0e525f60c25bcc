"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Encoding.  For each prefix of a piece of text the transducer keeps one token: the last one of that prefix's encoding.
A token t may follow a token s in an encoding if and only if merging their bytes leaves the boundary between them, which
depends on the merge list alone; so the last token of a prefix is the one suffix of it that is a token and may follow the
last token of the rest.  The last tokens link every prefix to a shorter one.  No link is longer than the longest token,
which is the lookahead that suffices: whatever comes later hangs on one of that many newest prefixes.  Once the links
of all of these meet in one prefix, the tokens before it can no longer change and are emitted; only the unstable rest is
held.  Pieces are cut as the byte-level pattern cuts them, from a buffer that holds back what later text could change.
All texts take this one way: chunk in, stable ids out, and the bytes of a piece that is still open wait in the transducer.

Results for short whole pieces are cached (bounded, two generations), which changes nothing but the time.

Decoding.  Token bytes feed a UTF-8 state machine that emits characters as soon as they are whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm._arrow import prepare, utf8

# fixed values: the byte-level pre-tokenizer's pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a text that are taken at once; characters of the longest piece that a later character can still cut.
FEED, LEAD = 1 << 16, 3
#: Entries of each generation of a cache.
CACHED = 300_000
NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Generations(dict):
    """A cache of at most twice CACHED entries that keeps what was used last."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value, stored = self.make(key)
            if not stored:
                return value
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeList:
    """What the vocabulary and the merges determine."""

    def __init__(self, vocabulary: dict[str, int], merges: list, special: dict[str, int]):
        alphabet = byte_characters()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.token = {as_bytes(t): i for t, i in vocabulary.items() if all(c in alphabet for c in t) and t not in special}
        self.special = special
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.token.items():
            self.bytes[i] = b
        for s, i in special.items():
            self.bytes[i] = s.encode()
        self.longest = max(map(len, self.token))  # the sufficient lookahead, in bytes
        self.merge: dict[tuple[int, int], int] = {}
        # from a single byte up to the token: (token, rank at which it forms), along its right and left edge
        self.right: list = [((i, -1),) for i in range(size)]
        self.left: list = [((i, -1),) for i in range(size)]
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = rank
                self.right[z] = (*self.right[y], (z, rank))
                self.left[z] = (*self.left[x], (z, rank))
        self.follows: dict[int, bool] = {}
        self.ends = ahocorasick.Automaton()  # finds all tokens that end at a byte, the longest first
        for b, i in self.token.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()

    def may_follow(self, s: int, t: int) -> bool:
        """Whether s, t is the encoding of its bytes: no merge over the boundary comes before one on either side."""
        a, b, i, j = self.right[s], self.left[t], 0, 0
        answer = None
        while answer is None:
            next_a = a[i + 1][1] if i + 1 < len(a) else NEVER
            next_b = b[j + 1][1] if j + 1 < len(b) else NEVER
            over = self.merge.get((a[i][0], b[j][0]))
            if over is not None and over < next_a and over <= next_b:
                answer = False
            elif next_a == next_b == NEVER:
                answer = True
            elif next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.follows) > 4 * CACHED:
            self.follows.clear()
        self.follows[s << 32 | t] = answer
        return answer


class Transducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.held = b""  # bytes after the last emitted token
        self.last: list[int] = [-1]  # of each prefix of held: the last token of its encoding

    def push(self, more: bytes) -> None:
        known, last, may_follow = self.m.follows, self.last, self.m.may_follow
        base = max(0, len(self.held) - self.m.longest)
        self.held += more
        need = len(last) - base - 1  # of the window's bytes, the first whose token isn't known
        for end, (t, size) in self.m.ends.iter(self.held[base:].decode("latin-1")):
            if end != need:
                continue
            s = last[base + end + 1 - size]
            if s >= 0:
                fits = known.get(s << 32 | t)
                if fits is None:
                    fits = may_follow(s, t)
                if not fits:
                    continue
            last.append(t)
            need += 1

    def stable(self) -> list[int]:
        """The tokens that no later bytes can change."""
        n = len(self.held)
        live = [-i for i in range(max(0, n - self.m.longest + 1), n + 1)]
        heapq.heapify(live)
        while len(live) > 1:
            newest = heapq.heappop(live)
            if live[0] != newest and newest != 0:
                heapq.heappush(live, newest + len(self.m.bytes[self.last[-newest]]))
        meet = -live[0]
        tokens = self._path(meet)
        if meet:
            before = self.last[meet]
            self.held, self.last = self.held[meet:], self.last[meet:]
            self.last[0] = before  # what follows must still fit to it
        return tokens

    def finish(self) -> list[int]:
        return self._path(len(self.held))

    def _path(self, end: int) -> list[int]:
        found = []
        while end > 0:
            t = self.last[end]
            found.append(t)
            end -= len(self.m.bytes[t])
        return found[::-1]


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes these."""

    def __init__(self, merges: MergeList, library: bool = False):
        """library: short pieces are encoded by tiktoken over the same merge list, which gives the same ids."""
        self.m = merges
        if library:
            ranks = {b: i for b, i in merges.token.items()}
            single = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            merged = self.run  # long pieces take the library time by their square
            self.run = lambda piece: self.pack(single(piece.encode())) if len(piece) < 1024 else merged(piece)
        self.pattern = regex.compile(PATTERN)
        self.runs = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]
        self.piece = Generations(self._piece)
        self.word = Generations(self._word)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.most_special = max(map(len, merges.special), default=0)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def run(self, piece: str) -> bytes:
        t = Transducer(self.m)
        t.push(piece.encode())
        return self.pack(t.finish())

    def _piece(self, piece: str) -> tuple[bytes, bool]:
        return self.run(piece), len(piece) < 64

    def _word(self, word: str) -> tuple[bytes | None, bool]:
        """A word that a space goes before; None where the pieces depend on what is around it."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None, False
        first, *rest = self.pattern.findall(" " + word)
        start = self.word[first[1:]] if rest else self.run(first)
        return start + b"".join(map(self.piece.__getitem__, rest)), len(word) < 32

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(text)))

    def plain(self, text: str) -> bytes:
        """A short text without special tokens.

        A space, and a line feed, between other characters always ends a piece; where white space meets white space
        the pieces are found together.
        """
        found = []
        try:
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if not first and rest and not k:  # the text goes on with a space and a word
                    found.append(b"".join(map(self.word.__getitem__, rest)))
                    continue
                if not first or first[0].isspace() or first[-1].isspace():
                    return self.pieces(text)
                found.append(self.pieces(first) + b"".join(map(self.word.__getitem__, rest)))
        except TypeError:
            return self.pieces(text)
        return self.piece["\n"].join(found)

    def run_end(self, kind, buffer: str, last: bool) -> tuple[int, bool]:
        """How much of the buffer surely belongs to the long piece, and whether the piece ends there."""
        special = self.split.search(buffer) if self.split else None
        stop = special.start() if special else len(buffer) if last else max(0, len(buffer) - self.most_special)
        end = kind.match(buffer, 0, stop).end()
        over = end < stop or special is not None or last
        # the last white space before other text is not part of a piece of white space
        spare = kind is self.runs[3] and (end < stop or not over)
        return max(0, end - spare), over

    def rest(self, buffer: str) -> Iterator[bytes]:
        """All of a text's end, in which nothing is open."""
        for k, part in enumerate(self.split.split(buffer) if self.split else [buffer]):
            yield self.pack([self.m.special[part]]) if k % 2 else self.plain(part)

    def encode(self, text: str) -> bytes:
        """All ids of a text at once, for those who need them together."""
        return b"".join(self.rest(text))

    def decode(self, packed: Iterable[bytes]) -> Iterator[str]:
        """Characters as they become whole; bytes that are no UTF-8 become U+FFFD."""
        decoder = Decoder(self)
        for ids in packed:
            yield decoder.feed(ids)
        yield decoder.finish()


class Encoder:
    """The state of one text: what is held doesn't grow with it."""

    def __init__(self, codec: Codec):
        self.c, self.buffer, self.run, self.kind = codec, "", None, None

    def feed(self, chunk: str) -> Iterator[bytes]:
        """The ids that this chunk makes stable."""
        c = self.c
        self.buffer += chunk
        while True:
            if self.run:  # within an open piece
                end, over = c.run_end(self.kind, self.buffer, False)
                if end:
                    self.run.push(self.buffer[:end].encode())
                    self.buffer = self.buffer[end:]
                    yield c.pack(self.run.stable())
                if not over:
                    return
                yield c.pack(self.run.finish())
                self.run = None
            special = c.split.search(self.buffer) if c.split else None
            if special:
                yield c.plain(self.buffer[: special.start()])
                yield c.pack([c.m.special[special[0]]])
                self.buffer = self.buffer[special.end() :]
                continue
            if end := self.safe():
                yield c.plain(self.buffer[:end])
                self.buffer = self.buffer[end:]
            m = c.pattern.match(self.buffer)
            if not m or len(m[0]) <= LEAD or m.end() < len(self.buffer) - c.most_special:
                return
            self.open()

    def safe(self) -> int:
        """An end of a piece, the last if there is one before a space, that no later text and no special token moves."""
        text, limit = self.buffer, len(self.buffer) - max(self.c.most_special, 2)
        at = text.rfind(" ", 1, max(limit, 0))
        while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", 1, at)
        if at > 0:
            return at
        if len(text) <= 4 * self.c.most_special:
            return 0
        ends = [m.end() for m in self.c.pattern.finditer(text)]
        return max((e for e in ends[:-2] if e < limit and not text[e - 1].isspace()), default=0)

    def open(self) -> None:
        self.run, self.kind = Transducer(self.c.m), next(k for k in self.c.runs if k.match(self.buffer[1:2]).end() == 1)
        if self.buffer[0] == " " and self.kind is not self.c.runs[3]:
            self.run.push(b" ")
            self.buffer = self.buffer[1:]

    def finish(self) -> Iterator[bytes]:
        """The ids of what is still held."""
        if self.run:
            end, _ = self.c.run_end(self.kind, self.buffer, True)
            self.run.push(self.buffer[:end].encode())
            yield self.c.pack(self.run.stable() + self.run.finish())
            self.buffer, self.run = self.buffer[end:], None
        yield from self.c.rest(self.buffer)
        self.buffer = ""


class Decoder:
    """Ids in, characters out as they become whole."""

    def __init__(self, codec: Codec):
        self.table, self.machine = codec.m.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(4)
def codec(path: str, library: bool = False) -> Codec:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    return Codec(MergeList(told["model"]["vocab"], told["model"]["merges"], special), library)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text.

    Null is the empty text (no ids; both digests are those of nothing).  Rows are independent, so ties and repeated rows
    give repeated rows; other columns are ignored; an empty frame gives an empty frame.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            data, at = utf8(batch.column(1))
            body, ends = memoryview(data), at.tolist()
            for low, high in zip(ends[:-1], ends[1:]):
                n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
                encoder, decoder, characters = Encoder(c), Decoder(c), codecs.getincrementaldecoder("utf-8")()
                for i in range(low, high, FEED):
                    for packed in encoder.feed(characters.decode(body[i : min(i + FEED, high)])):
                        n += len(packed)
                        ids.update(packed)
                        text.update(decoder.feed(packed).encode())
                for packed in encoder.finish():
                    n += len(packed)
                    ids.update(packed)
                    text.update(decoder.feed(packed).encode())
                text.update(decoder.finish().encode())
                counts.append(n // 4)
                ids_digest.append(ids.hexdigest())
                text_digest.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
