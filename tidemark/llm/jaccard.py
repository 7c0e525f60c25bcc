"""Exact Jaccard join of documents' sets of word n-grams, by relations between sets.

1.  Two sketches of fixed size, taken over all texts, say how common words and n-grams are.  They order all n-grams: the
    common last, the rarest words first.  Any order gives right results; a good one gives short lists.
2.  Documents with the same set are one node.  Of a set of n, the first n - ceil(t n) + 1 n-grams in that order are posted;
    two sets of a Jaccard similarity of t or more share one of these.  Lists of one node are dropped.
3.  A list is cut into blocks by set size and by the position that its n-gram has in a set, each of which overlaps with the
    next, so sets whose sizes or positions rule out a link are skipped by blocks and
    don't meet.  In a block the smallest node is the pivot, so that lists of the same sets have the same one.  Lists thus
    become groups around pivots.  A group is cut into families: every set has a bitmap in which each n-gram flips one bit,
    and the bits in which two bitmaps differ are a metric that is never more than what their sets differ in.  A set beyond
    some link distances of each leader leads a family of its own; a family takes what is one link distance further
    away, so two linked sets are in one family, whichever leader either has.
4.  Sets are read again for the members of families only.  Each member is compared to its leader once.  What the leader and a member
    differ in answers for the members among themselves: |B and C| = |A| - |A-B| - |A-C| + what the differences share.
    A member that is linked with the leader brings the leader's links; for the others, only members with a common
    difference are looked at, as without one they are no more similar than either is to the leader.
    So a group of copies costs as much as it has members, and no list is expanded into pairs.
    Groups and families of more than a part's sets are dealt to several tasks.  The parts of a group each elect leaders, these
    elect among themselves, and each part then finds its members' families.  The parts of a family each compare their members
    with the leader; those that it isn't linked with go on to all parts, in blocks.
5.  Links that span each group's components go on to connected components over all groups.

Groups and families that lie in another one are dropped before bitmaps and sets are sent (`uncovered`), and after each step the disk
of what is no longer needed is freed.

N-grams and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._arrow import groups, keep, let_go, pieces, prepare
from tidemark.llm._words import U, mix, totals, words
from tidemark.llm.components import components

#: Buckets of each sketch, and of the filter of documents that are read again.
SKETCH, FILTER = 1 << 18, 1 << 23
#: Link distances from its leader within which a set leads no family of its own, at most; and how far, as a part of a set's
#: size, a family may reach: bitmaps of unlike sets differ in some .86 of it.
REACH, APART = 3, 0.7
#: Numbers of places of a size's blocks, of which two divided by the distance from 1 to the similarity are in use.
BLOCKS = 1 << 20
#: Words of bitmaps up to which all of a group's are compared with each other first.
PAIRED = 1 << 21
#: Sets of a group or a family that one task takes; there is no bound on either, as larger ones are dealt in parts.
PART = 512
#: Rows of a few numbers up to which a side of a join is broadcast.
SIDE = 1 << 18
#: Slots, 64 to a row, of the filter of rows that may have to go, and so cross the network to learn that.
SLOTS = 1 << 23


@dataclass
class Sets:
    """N-grams of some documents, one after another; doc: the owner, common: how common its words are."""

    hash: np.ndarray
    doc: np.ndarray
    common: np.ndarray | None


def grams(data: np.ndarray, at: np.ndarray, size: int, rarity: np.ndarray | None = None) -> Sets:
    """The n-grams of lower-cased words of each document, with repetitions; of fewer words, all of them as one."""
    w = words(data, at, True)
    counts = np.diff(w.first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), number)
    start = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    hashes = np.full(len(doc), U(size))
    common = np.zeros(len(doc)) if rarity is not None else None
    for k in range(size):
        there = counts[doc] > k
        at_word = np.minimum(start + k, max(len(w.hash) - 1, 0))
        hashes = np.where(there, hashes * U(0xC2B2AE3D27D4EB4F) + w.hash[at_word], hashes)
        if common is not None:
            common += np.where(there, rarity[w.hash[at_word] >> U(46)], 0)
    # shorter sequences have hashes of their own, as their length is in them
    return Sets(mix(hashes ^ mix(np.minimum(counts[doc], size).astype(U))), doc, common)


def distinct(s: Sets, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of each document's set in the order of the key, which equal hashes have in common."""
    order = np.argsort(key, kind="stable")
    small = s.doc.astype(np.uint16) if not len(s.doc) or s.doc[-1] < 65536 else s.doc
    order = order[np.argsort(small[order], kind="stable")]
    h, d = s.hash[order], s.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def sketches(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of how common words are, level of how common n-grams are) by bucket, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * SKETCH, np.int64)
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                w = words(data, at, True)
                s = grams(data, at, size)
                seen[:SKETCH] += np.bincount((w.hash >> U(46)).astype(np.int64), minlength=SKETCH)
                seen[SKETCH:] += np.bincount((s.hash >> U(46)).astype(np.int64), minlength=SKETCH)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["at", "n"])

    table = docs.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(2 * SKETCH)
    seen[table["at"].to_numpy()] = table["n"].to_numpy()
    usual = max(seen[SKETCH:].mean(), 1.0)
    level = np.clip(np.floor(np.log2(np.maximum(seen[SKETCH:] / (2 * usual), 1))), 0, 31)
    return np.log2(seen[:SKETCH] + 1).astype(np.float32), level.astype(np.uint8)


def bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set: twice as many bits as it has n-grams, or more (a power of two), of which each n-gram flips one."""
    n = np.diff(first)
    bits = 1 << np.maximum(np.ceil(np.log2(np.maximum(2 * n, 1))), 6).astype(np.int64)
    start = np.r_[0, np.cumsum(bits)]
    spot = np.repeat(start[:-1], n) + (mix(h + U(0x13198A2E03707344)) & np.repeat(bits - 1, n).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(spot, minlength=start[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def reach_of(percent: int) -> int:
    """The link distances that a leader spans, fewer where a link may be wide, so that families hold no unlike sets."""
    t = percent / 100
    return int(min(max(APART / max(2 * (1 - t) / (1 + t), 1e-9) - 1, 1), REACH))


def families(nodes: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int) -> list[tuple[int, int]]:
    """(leader, member) for the sets of a group, the leader as a member of its own family too; alone, it has none."""
    shortest, t = min(map(len, maps)), percent / 100
    share, reach = (1 - t) / (1 + t) + 1e-9, reach_of(percent)
    if len(maps) == 2 and len(maps[0]) == len(maps[1]):  # most groups
        away = (int.from_bytes(maps[0]) ^ int.from_bytes(maps[1])).bit_count()
        return [(nodes[0], nodes[0]), (nodes[0], nodes[1])] if away <= share * int(sizes.sum()) else []
    words_of = fold(maps, shortest)
    if len(maps) * words_of.size <= PAIRED:  # sets that can have no link in the group leave it
        apart = np.bitwise_count(words_of[:, None] ^ words_of).sum(2) - share * (sizes[:, None] + sizes)
        np.fill_diagonal(apart, 1)
        may = apart.min(1) <= 0
        nodes, sizes, words_of = nodes[may], sizes[may], words_of[may]
    led, found = np.zeros(len(nodes), bool), []
    for seed in range(len(nodes)):
        if led[seed]:
            continue
        # all links of what is led are in its leader's family, so later ones do without it
        free = np.flatnonzero(~led)
        away = np.bitwise_count(words_of[free] ^ words_of[seed]).sum(1)
        around = free[away <= share * reach * (sizes[free] + sizes[seed])]
        lead = around[np.bitwise_count(words_of[around] ^ majority(words_of[around])).sum(1).argmin()] if len(around) > 2 else seed
        if lead != seed:
            away = np.bitwise_count(words_of[free] ^ words_of[lead]).sum(1)
        new = away <= share * reach * (sizes[free] + sizes[lead])
        # a set linked with one of those is no further away than that one and their link together
        near = free[away <= (away + share * sizes[free])[new].max() + share * sizes[free]]
        led[free[new]] = True
        if len(near) > 1:
            found += [(nodes[lead], nodes[x]) for x in near]
    return found


def fold(maps: list[bytes], width: int) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all of this width in bytes; folding brings none further apart."""
    folded = np.empty((len(maps), width), np.uint8)
    for k, m in enumerate(maps):
        folded[k] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width))
    return folded.view(U)


def apart_from(words_of: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bits each row differs from one."""
    return np.bitwise_count(words_of ^ one).sum(1, dtype=np.int64)


def elect(sizes: np.ndarray, words_of: np.ndarray, weight: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(index, weight led) of leaders so that each set is within half of a family's reach of one, by the smaller of both sizes.

    Two elections in a row thus leave each set within a family's reach of a leader.
    """
    t = percent / 100
    radius = ((1 - t) / (1 + t) + 1e-9) * reach_of(percent)
    free, found = np.argsort(-weight, kind="stable"), []
    while len(free):
        lead = free[0]
        away = apart_from(words_of[free], words_of[lead])
        around = free[away <= radius * np.minimum(sizes[free], sizes[lead])]
        if len(around) > 2:
            lead = around[apart_from(words_of[around], majority(words_of[around])).argmin()]
            away = apart_from(words_of[free], words_of[lead])
        led = away <= radius * np.minimum(sizes[free], sizes[lead])
        found.append((int(lead), int(weight[free[led]].sum())))
        free = free[~led]
    return found


def join_families(leaders: tuple, members: tuple, percent: int) -> list[tuple[int, int]]:
    """(leader, member) of a part's members, given all leaders of the group in one order; each is (nodes, sizes, rows of words).

    A member is led by the first leader in reach, and in the families of leaders up to that one whose members it may be linked
    with.  So of two linked sets, both are in the family of the one that is led first.
    """
    t = percent / 100
    share, reach, found = (1 - t) / (1 + t) + 1e-9, reach_of(percent), []
    nodes, sizes, words_of = members
    free = np.arange(len(nodes))
    for lead, n, row in zip(*leaders):
        away, s = apart_from(words_of[free], row), sizes[free]
        near = free[(away <= share * (reach * (s / t + n) + s / t + s)) & (nodes[free] != lead)]
        if len(near):
            found += [(lead, lead), *((lead, x) for x in nodes[near])]
        free = free[away > share * reach * (s + n)]
    return found


def majority(maps: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The bitmap of the bits that more than half of the bitmaps (rows of 64-bit words) have."""
    ones = sum(np.unpackbits(maps[k : k + rows].view(np.uint8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(maps), rows))
    return np.packbits(2 * ones > len(maps)).view(U)


def read_sets(docs: DataFrame, size: int, percent: int, model: tuple) -> DataFrame:
    """doc_id, n (size of the set), node (null: empty) and, where this is the node's first in the partition, first (the posted
    n-grams) and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, level = sent.value
        seen: set[int] = set()
        for batch in batches:
            n_all, node_all, lists, maps = [], [], [], []
            for _, _, data, at in pieces(batch.column(1)):
                s = grams(data, at, size, rarity)
                key = level[s.hash >> U(46)].astype(U) << U(58) | np.minimum(s.common / 2, 63).astype(U) << U(52) | s.hash >> U(12)
                h, d = distinct(s, key)
                n = np.bincount(d, minlength=len(at) - 1)
                first = np.r_[0, np.cumsum(n)]
                node = identity(h, first)
                posted = n - (percent * n + 99) // 100 + 1
                mapped = bitmaps(h, first)
                for k in range(len(n)):
                    v = int(node[k])
                    new = n[k] > 0 and v not in seen
                    if new:
                        seen.add(v)
                    maps.append(mapped[k] if new else None)
                    lists.append(h[first[k] : first[k] + posted[k]].view(np.int64) if new else h[:0].view(np.int64))
                n_all.append(n)
                node_all.append(node)
            n, node = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (n_all, node_all))
            sizes = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0), arrays, pa.array(maps, pa.binary())], ["doc_id", "n", "node", "first", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, node bigint, first array<bigint>, bitmap binary")


def list_blocks(n: Column, position: Column, percent: int) -> Column:
    """The blocks (numbers made of a size and a place) of a list that a set of n with the list's n-gram at this position stands in: four of them.

    Two sets of sizes a and b that link, t being the similarity, differ in size by a factor of t at most, and the n-gram stands so
    that their values of 2 * position - n differ by (1 - t) / (1 + t) * (a + b) at most: before the n-gram they share no more
    than the lesser position, after it no more than the lesser rest.  Blocks of these widths overlap with the next, so such
    sets meet in one, and others are skipped block by block.
    """
    t = percent / 100
    wide = float(-np.log(t))
    size = F.floor(F.log(n) / wide)
    z = 2.0 * position - n

    def places(s: Column) -> Column:
        most = F.exp((s + 1) * wide)
        place = F.floor(z / (most * (2 * (1 - t) / (1 + t)) + 1e-6))
        first = (s * BLOCKS + place + BLOCKS // 2).cast("bigint")
        return F.array(first, first + 1)

    return F.concat(places(size), places(size + 1))


def identity(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on the order of its n-grams."""
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ U(0x243F6A8885A308D3)), out=sums[1:])
    n = np.diff(first).astype(U)
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(n)).view(np.int64)


def fetch(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set as bytes) of the wanted (node, doc_id): these documents are read again, and others that a filter lets by."""
    spot = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(FILTER)), F.lit(0))
    bits = np.zeros(FILTER, bool)
    bits[wanted.select(spot("doc_id").alias("x")).distinct().toArrow()["x"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let = np.unpackbits(sent.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            chosen = batch.filter(pa.array(let[batch.column(0).to_numpy()]))
            for _, _, data, at in pieces(chosen.column(1)):
                s = grams(data, at, size)
                h, d = distinct(s, s.hash)
                first = np.searchsorted(d, np.arange(len(at)))
                node = identity(h, first)
                rows = []
                for k in range(len(node)):
                    if first[k] < first[k + 1] and int(node[k]) not in seen:
                        seen.add(int(node[k]))
                        rows.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(node[rows], pa.int64()), pa.array([h[first[k] : first[k + 1]].tobytes() for k in rows], pa.binary())], ["node", "set"])

    found = docs.select(spot("doc_id").cast("int").alias("x"), "text").mapInArrow(run, "node bigint, set binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def group_links(leader: np.ndarray, members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a group: pairs of indices, of which -1 is the leader.

    Sets are sorted arrays.  All links between any two of the sets are accounted for.
    """
    m, a = len(members), len(leader)
    parent = list(range(m + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []

    def tie(x: int, y: int) -> None:
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            found.append((x, y))

    sizes = np.array([len(s) for s in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(m), sizes)
    spot = np.minimum(np.searchsorted(leader, flat), a - 1)
    inside = leader[spot] == flat
    shared = np.bincount(owner[inside], minlength=m)
    linked = 100 * shared >= percent * (a + sizes - shared)
    for x in np.flatnonzero(linked):
        tie(int(x), m)
    rest = np.flatnonzero(~linked)
    if len(rest) and m > 1:
        # differences: what a member has beside the leader, and what it lacks of it
        ends = np.r_[0, np.cumsum(np.bincount(owner[inside], minlength=m))]
        there = spot[inside]
        missing = [np.delete(np.arange(a), there[ends[x] : ends[x + 1]]) for x in range(m)]
        lacks = np.repeat(np.arange(m), list(map(len, missing))), np.concatenate(missing)
        extra, code = np.unique(flat[~inside], return_inverse=True)
        codes = np.concatenate([lacks[1], a + code])
        owners = np.concatenate([lacks[0], owner[~inside]])
        by_code = np.argsort(codes, kind="stable")
        at_code = np.searchsorted(codes[by_code], np.arange(a + len(extra) + 1))
        holders = owners[by_code]
        by_owner = np.argsort(owners, kind="stable")
        at_owner = np.searchsorted(owners[by_owner], np.arange(m + 1))
        lack = a - shared
        for x in rest:
            own = codes[by_owner[at_owner[x] : at_owner[x + 1]]]
            both = np.zeros(m, np.int64)
            for c in own:
                both[holders[at_code[c] : at_code[c + 1]]] += 1
            overlap = a - lack - lack[x] + both
            links = 100 * overlap >= percent * (sizes + sizes[x] - overlap)
            for y in np.flatnonzero(links):
                if y != x:
                    tie(int(x), int(y))
    return [(x if x < m else -1, y if y < m else -1) for x, y in found]


def links_batch(found: list[tuple[int, int]], left: str, right: str) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], [left, right])


def dealt(key: Column, parts: Column) -> Column:
    """The part, of so many, that a key is dealt to."""
    return F.pmod(F.xxhash64(key), parts).cast("int")


def sides(kept: DataFrame) -> tuple:
    """(what to do with a frame of as many rows or fewer when it is joined, number of rows): broadcast where that is small."""
    n = kept.count()
    return (F.broadcast if n <= SIDE else lambda df: df), n


def uncovered(pairs: DataFrame, group: str) -> DataFrame:
    """(group, node), from the same, without groups whose nodes all have one other group as their largest: all their pairs of nodes are in that.

    A group that is the largest of a node stays.  Only numbers cross the network here, so bitmaps and sets needn't for what is dropped.
    """
    pairs = keep(pairs)
    sized = pairs.join(pairs.groupBy(group).agg(F.count("*").alias("m")), group)
    home = sized.groupBy("node").agg(F.max(F.struct("m", group)).getField(group).alias("home"))
    inside = sized.join(home, "node").groupBy(group).agg(F.min("home").alias("low"), F.max("home").alias("high")).where((F.col("low") == F.col("high")) & (F.col("low") != F.col(group)))
    return keep(pairs.select(group, "node").join(inside.select(group), group, "left_anti"))


def families_of(pairs: DataFrame, mapped: DataFrame, percent: int, part: int) -> DataFrame:
    """(leader, node) of the families of all groups, from (pivot, node) and (node, n, bitmap)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in groups(batches, 0):
            nodes = rows.column(1).to_numpy()
            order = np.lexsort((nodes, nodes != rows.column(0)[0].as_py()))
            maps = rows.column(3).to_pylist()
            found += families(nodes[order], rows.column(2).to_numpy()[order], [maps[k] for k in order], percent)
            if len(found) > 50_000:
                yield links_batch(found, "leader", "node")
                found = []
        yield links_batch(found, "leader", "node")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 0, 1):
            rows = rows.sort_by("node")
            words_of = fold(rows["bitmap"].to_pylist(), rows["narrow"][0].as_py())
            led = elect(rows["n"].to_numpy(), words_of, rows["weight"].to_numpy(), percent)
            at = [k for k, _ in led]
            taken = rows.select(["pivot", "parts", "narrow", "node", "n"]).take(at).combine_chunks()
            yield from taken.append_column("weight", pa.array([w for _, w in led], pa.int64())).append_column("bitmap", pa.array([words_of[k].tobytes() for k in at], pa.binary())).to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 0, 1):
            rows = rows.sort_by([("weight", "descending"), ("node", "ascending")])
            words_of = fold(rows["bitmap"].to_pylist(), rows["narrow"][0].as_py())
            nodes, n, leads = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["weight"].to_numpy() > 0
            yield links_batch(join_families(*((nodes[x], n[x], words_of[x]) for x in (leads, ~leads)), percent), "leader", "node")

    held = pairs.join(mapped.select("node", F.length("bitmap").alias("width")), "node").groupBy("pivot").agg(F.count("*").alias("m"), F.min("width").alias("narrow"))
    crowded = keep(held.where(F.col("m") > part).select("pivot", F.ceil(F.col("m") / part).cast("int").alias("parts"), "narrow"))
    side, n = sides(crowded)
    small = pairs.join(side(crowded), "pivot", "left_anti") if n else pairs
    told = small.join(mapped, "node").select("pivot", "node", "n", "bitmap").repartition("pivot").sortWithinPartitions("pivot")
    found = told.mapInArrow(whole, "leader bigint, node bigint")
    if n:
        kind = "pivot bigint, parts int, narrow int, node bigint, n bigint, weight bigint, bitmap binary"
        names = ["pivot", "part", "parts", "narrow", "node", "n", "weight", "bitmap"]
        deal = lambda df: df.select(names).repartition("pivot", "part").sortWithinPartitions("pivot", "part")
        members = pairs.join(side(crowded), "pivot").join(mapped, "node").withColumn("part", dealt(F.col("node"), F.col("parts")))
        local = deal(members.withColumn("weight", F.lit(1).cast("bigint"))).mapInArrow(chosen, kind)
        leaders = keep(deal(local.withColumn("part", F.lit(0))).mapInArrow(chosen, kind))
        everywhere = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = found.union(deal(members.withColumn("weight", F.lit(0).cast("bigint")).select(names).union(everywhere.select(names))).mapInArrow(joined, "leader bigint, node bigint"))
    return found.distinct()


def links_of(pairs: DataFrame, sets: DataFrame, percent: int, part: int) -> DataFrame:
    """Links (u, v) that span the components of each family, from (leader, node) and (node, set)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in groups(batches, 0, 1, 2):
            centre = rows["leader"][0].as_py()
            nodes, at = np.unique(rows["node"].to_numpy(), return_index=True)
            sets = rows["set"]
            others = nodes != centre
            if others.any() and not others.all():
                own, *held = (np.frombuffer(sets[int(k)].as_py(), U) for k in (*at[~others], *at[others]))
                name = [*nodes[others].tolist(), centre]
                found += [(name[x], name[y]) for x, y in group_links(own, held, percent)]
            if len(found) > 50_000:
                yield links_batch(found, "u", "v")
                found = []
        yield links_batch(found, "u", "v")

    def unlinked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 0, 1):
            centre, nodes = rows["leader"][0].as_py(), rows["node"].to_numpy()
            sets = [np.frombuffer(x, U) for x in rows["set"].to_pylist()]
            own = sets[int(np.flatnonzero(nodes == centre)[0])]
            both = [len(np.intersect1d(own, x, assume_unique=True)) for x in sets]
            yield from rows.filter(pa.array([100 * k < percent * (len(own) + len(x) - k) for k, x in zip(both, sets)], pa.bool_())).drop(["part"]).to_batches()

    whole = lambda df: df.withColumns({"part": F.lit(0), "block": F.lit(0)})
    names = ["leader", "part", "block", "node", "set"]
    crowded = keep(pairs.groupBy("leader").agg(F.count("*").alias("m")).where(F.col("m") > part).select("leader", F.ceil(F.col("m") / part).cast("int").alias("parts")))
    side, n = sides(crowded)
    if not n:
        rows = whole(pairs.join(sets, "node")).select(names)
    else:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        shipped = keep(pairs.join(side(crowded), "leader", "left").join(sets, "node").select("leader", "parts", "node", "set"))
        leaders = shipped.where("parts is not null and leader = node")
        members = shipped.where("parts is not null and leader <> node").withColumn("part", dealt(F.col("node"), F.col("parts")))
        first = members.select("leader", "part", "parts", "node", "set").union(leaders.select("leader", each("parts").alias("part"), "parts", "node", "set"))
        loose = keep(first.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInArrow(unlinked, "leader bigint, parts int, node bigint, set binary"))
        blocks = crowded.select("leader").join(loose.groupBy("leader").agg(F.count("*").alias("m")), "leader", "left").select("leader", F.greatest(F.ceil(F.coalesce("m", F.lit(0)) / part), F.lit(1)).cast("int").alias("blocks"))
        blocks = side(keep(blocks))
        # every member meets the leader, and every one that isn't linked with it, in the blocks of its part
        rows = (
            whole(shipped.where("parts is null")).select(names)
            .union(members.join(blocks, "leader").withColumn("block", each("blocks")).select(names))
            .union(loose.join(blocks, "leader").withColumns({"block": dealt(F.col("node"), F.col("blocks")), "part": each("parts")}).select(names))
            .union(leaders.join(blocks, "leader").withColumn("part", each("parts")).withColumn("block", each("blocks")).select(names))
        )
    return rows.repartition("leader", "part", "block").sortWithinPartitions("leader", "part", "block").mapInArrow(link, "u bigint, v bigint")


def similar(docs: DataFrame, size: int = 3, percent: int = 90, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that it reaches over links.

    Documents are linked when 100 * |A and B| >= percent * |A or B|, over their sets of `size` lower-cased words in a row.
    With fewer words the whole sequence is the one n-gram.  A text without words, or null, has an empty set, links with
    nothing and is its own component.  Equal sets are linked, so repeated rows and copies are in one component; the
    ends of ranges are included.  A null doc_id is never the smallest where another is there.  Other columns are ignored;
    an empty frame gives an empty frame.  A task takes `part` sets of a group; any number gives the same rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = sketches(docs, size)
    let_go(docs.sparkSession)
    read = keep(read_sets(docs, size, percent, model))

    posts = read.select("node", "n", F.posexplode("first").alias("position", "gram"))
    all_of = Window.partitionBy("gram")
    met = posts.withColumn("low", F.min("node").over(all_of)).withColumn("high", F.max("node").over(all_of)).where("low <> high")
    met = met.dropDuplicates(["gram", "node"]).select("gram", "node", "position", F.explode(list_blocks(F.col("n"), F.col("position"), percent)).alias("block"))
    # a list's blocks are where the list is, so their pivots need no further shuffle
    block = Window.partitionBy("gram", "block")
    told = met.select("node", F.min("node").over(block).alias("pivot"), F.max("node").over(block).alias("high"))
    pairs = uncovered(told.where("pivot <> high").select("pivot", "node").distinct(), "pivot")
    # of sets that meet no other, neither n-grams nor bitmaps are held any longer
    mapped = keep(read.where("bitmap is not null").select("node", "n", "bitmap").join(pairs.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    read = keep(read.select("doc_id", "n", "node"))
    del posts, met, told
    let_go(docs.sparkSession)
    pairs = uncovered(families_of(pairs, mapped, percent, part), "leader")
    del mapped
    let_go(docs.sparkSession)

    first_doc = read.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = fetch(docs, first_doc.join(pairs.select("node").distinct(), "node"), size)
    joined = components(links_of(pairs, sets, percent, part))
    del sets
    let_go(docs.sparkSession)
    smallest = first_doc.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    named = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = smallest.join(named, "component").select("node", "component_id")
    return read.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def slotted(df: DataFrame) -> DataFrame:
    """df with `word` and `bit`, the place in the filter of its column `row`."""
    slot = F.pmod(F.col("row"), F.lit(SLOTS))
    return df.withColumns({"word": F.floor(slot / 64), "bit": F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))})


def representatives(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row of docs, with all its columns, of each component: the smallest doc_id, then the smallest hash of the text.

    A null doc_id comes after all others.  Of repeated rows one stays.  Texts without words are in no component with others,
    so different ones all stay, as equal ones do under different doc_ids.  Columns of docs may have any names.
    """
    content = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), content.alias("content"))
    known = similar(docs.select(key.alias("doc_id"), "text"), size, percent)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    told = keep(known.select(F.xxhash64("doc_id.id", "doc_id.content").alias("row"), F.col("doc_id.content").alias("content"), stays.alias("stays")).groupBy("row", "content").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("times")))
    del known
    let_go(docs.sparkSession)
    # texts cross the network only where their row may go or be there again; whatever the filter lets by meets the exact join
    bits = F.broadcast(slotted(told.where("not stays or times > 1")).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    held = slotted(docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("held"), F.xxhash64("doc_id", content).alias("row"), content.alias("content"))).join(bits, "word", "left")
    doubt = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    asked = held.where(doubt).select("row", "content", "held").join(told.where("stays").select("row", "content"), ["row", "content"], "left_semi").dropDuplicates(["row", "content"])
    one = held.where(~doubt).select("held").unionByName(asked.select("held"))
    return one.select(*[F.col("held").getField(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
