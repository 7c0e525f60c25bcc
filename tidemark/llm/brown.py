"""A class-based bigram model: exchange clustering, class transitions and word emissions.

Words are counted over all training texts by 64-bit hash.  All words that are seen SEEN times and make up 1 / MOST of the
tokens are clustered, so their number, and with it that of classes (its cube root), grows with the corpus and is never more
than MOST.  The most frequent start with exact exchange on their bigrams.  Then come sweeps of exchange over all clustered words:
Spark counts how often each word stands beside each class, and every word moves to the class that fits these counts best
under the transitions of the sweep before; workers move words independently of each other, and only classes come to the driver.
All other words, unseen ones among them, are one class, whose emissions are smoothed by one.  Transitions are interpolated
with how frequent a class is.

Training texts are written once as numbers of words (three bytes each) for the sweeps.  Counts of words that are not clustered
never leave the cluster: they meet the documents in a join.  No such word can be frequent, so no key of it is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, pieces, prepare
from tidemark.llm._words import U, Words, words
from tidemark.llm.quality import remainder

#: Part of all tokens that a clustered word is at least, and how often it is seen; words that start with exact exchange,
#: rounds of that, sweeps over all words; weight of the interpolation.
MOST, SEEN, CORE, ROUNDS, SWEEPS, PRIOR = 1 << 23, 3, 1024, 10, 3, 20.0
#: The hash that stands for the end of a text.
END = np.uint64(0x5BD1E9955BD1E995)
#: Neighbours that a task holds before it hands them on.
HELD = 1 << 22


def slog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """The class of each word but the last two, which stand for other words and the end and have classes of their own."""
    n, k = len(bigrams) - 2, classes + 2
    of = np.r_[np.arange(n) % classes, classes, classes + 1]
    b = bigrams.astype(float)
    onehot = np.eye(k)[of]
    after, before = b @ onehot, b.T @ onehot  # of each word: the classes that follow it, and that it follows
    g = onehot.T @ after
    word_out, word_in = b.sum(1), b.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            old, r, q, own = of[w], after[w].copy(), before[w].copy(), b[w, w]
            r[old] -= own
            q[old] -= own
            g[old, :] -= r
            g[:, old] -= q
            g[old, old] -= own
            out, into = g.sum(1) + q, g.sum(0) + r  # also what leads to the word, and from it
            gain = (slog(g + r) - slog(g)).sum(1) + (slog(g + q[:, None]) - slog(g)).sum(0)
            d = g.diagonal()
            gain += slog(d + r + q + own) - slog(d + r) - slog(d + q) + slog(d)
            gain -= slog(out + word_out[w]) - slog(out) + slog(into + word_in[w]) - slog(into)
            new = int(np.argmax(gain[:classes]))
            if new != old and gain[new] <= gain[old] + 1e-9:
                new = old
            g[new, :] += r
            g[:, new] += q
            g[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                after[:, old] -= b[:, w]
                after[:, new] += b[:, w]
                before[:, old] -= b[w, :]
                before[:, new] += b[w, :]
        if moved <= n // 200:
            break
    return of[:n]


@dataclass
class Head:
    """The most frequent words: sorted hashes, and their rank and count in that order."""

    hash: np.ndarray
    rank: np.ndarray
    count: np.ndarray  # by rank

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word; the number of all for a word beyond."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.rank[at], len(self.hash))


def tokens(ids: np.ndarray, w: Words, end: int) -> np.ndarray:
    """The ids of all documents, each followed by `end`."""
    found = np.full(len(ids) + len(w.first) - 1, end, np.int64)
    found[np.arange(len(ids)) + w.doc] = ids
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of the texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [words(data, at, True).hash for _, _, data, at in pieces(batch.column(0))]
            word, c = np.unique(np.concatenate([*held, np.full(batch.num_rows, END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c, pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, head: Head) -> DataFrame:
    """The texts as numbers: ranks of clustered words, then that of any other word and that of the end."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(sent.value.hash)
        for batch in batches:
            held = []
            for _, _, data, at in pieces(batch.column(0)):
                w = words(data, at, True)
                ids = tokens(sent.value.ranks(w.hash), w, size + 1).astype("<u4")
                held.append(ids.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["ids"])

    return docs.select("text").mapInArrow(run, "ids binary")


def decoded(packed: bytes) -> np.ndarray:
    ids = np.zeros((len(packed) // 3, 4), np.uint8)
    ids[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return ids.view("<u4").reshape(-1).astype(np.int64)


def count_pairs(encoded: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """How often a token of each class, in a row of k * k numbers, follows one of each; an end goes before all texts."""
    sent = encoded.sparkSession.sparkContext.broadcast(of.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(k * k, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                c = sent.value[decoded(packed.as_py())].astype(np.int64)
                if len(c):
                    seen += np.bincount(np.r_[k - 1, c[:-1]] * k + c, minlength=k * k)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["cell", "n"])

    rows = encoded.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(k * k, np.int64)
    found[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return found.reshape(k, k)


def neighbours(encoded: DataFrame, of: np.ndarray, k: int) -> DataFrame:
    """(rank, cell array, n array): what clustered words stand beside; cell c is a class before, k + c one behind.  A rank has a
    row for each task, or more."""
    sent = encoded.sparkSession.sparkContext.broadcast(of.astype(np.int16))
    size = len(of) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def said() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            rank = keys // (2 * k)
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]][: len(rank)])
            offsets = pa.array(np.r_[first, len(rank)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((keys % (2 * k), pa.int16()), (n, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(rank[first], pa.int32()), *lists], ["rank", "cell", "n"])

        waiting = 0
        for batch in batches:
            for packed in batch.column(0):
                ids = decoded(packed.as_py())
                c = sent.value[ids].astype(np.int64)
                some = np.flatnonzero(ids < size)
                base = ids[some] * 2 * k
                held += [base + np.r_[k - 1, c[:-1]][some], base + k + np.r_[c[1:], k - 1][some]] if len(ids) else []
                waiting += 2 * len(some)
                if waiting > HELD:
                    yield said()
                    waiting = 0
        yield said()

    return encoded.mapInArrow(run, "rank int, cell array<smallint>, n array<int>")


def fitting(near: np.ndarray, count: np.ndarray, old: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class of each word by its neighbours (words x 2 x classes), its count and class so far, from the transitions g.

    Those who have no class yet, and stand in the last but one, join the best; the others move if another is better.
    """
    k = len(g)
    into, out = g.sum(0), g.sum(1)
    share = np.log((g + PRIOR * into / max(into.sum(), 1) + 1e-9) / (out[:, None] + PRIOR + 1e-9))
    fit = near[:, 0] @ share[:, : k - 2] + near[:, 1] @ share[: k - 2].T
    mass = into[: k - 2] + np.where(np.arange(k - 2) == old[:, None], 0, count[:, None])
    fit -= count[:, None] * np.log(np.maximum(mass, 1))
    return np.argmax(fit, axis=1)


def sweep(encoded: DataFrame, of: np.ndarray, k: int, count: np.ndarray) -> np.ndarray:
    """The classes after each clustered word has moved once."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast((of.astype(np.int16), count, count_pairs(encoded, of, k).astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, count, g = sent.value

        def moved(rows: pa.Table) -> pa.RecordBatch:
            rank = rows.column(0).to_numpy()
            words_, which = np.unique(rank, return_inverse=True)
            cell, n = (rows.column(i).combine_chunks() for i in (1, 2))
            key = np.repeat(which, np.diff(cell.offsets.to_numpy())) * 2 * k + cell.flatten().to_numpy()
            near = np.bincount(key, n.flatten().to_numpy(), minlength=len(words_) * 2 * k).reshape(-1, 2, k)
            new = fitting(near, count[words_].astype(float), of[words_], g)
            return pa.RecordBatch.from_arrays([pa.array(words_, pa.int32()), pa.array(new.astype(np.int16))], ["rank", "class"])

        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by rank: the last one may go on
            held.append(batch)
            table = pa.Table.from_batches(held)
            rank = table.column(0).to_numpy()
            whole = int(np.searchsorted(rank, rank[-1])) if len(rank) else 0
            if whole:
                yield moved(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield moved(pa.Table.from_batches(held))

    near = neighbours(encoded, of, k).repartition("rank").sortWithinPartitions("rank")
    rows = near.mapInArrow(run, "rank int, class smallint").toArrow()
    new = of.copy()
    new[rows["rank"].to_numpy()] = rows["class"].to_numpy()
    return new


@dataclass
class ClassModel:
    """of: the class of each rank, then that of other words, then that of the end; logarithms to base 10."""

    head: Head
    of: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # by rank; 0 for other words, which a join adds, and for the end
    rest: float  # what another word with no count has
    total: int
    distinct: int
    ends: int


def train(docs: DataFrame, counted: DataFrame) -> ClassModel:
    """From the training texts and the counts of their words."""
    end = int(END.astype(np.int64))
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("c"))), F.lit(0))).first()
    total, distinct, ends = map(int, totals)
    top = counted.where((F.col("word") != end) & (F.col("c") >= SEEN) & (F.col("c") * MOST >= total)).toArrow()
    hashes, count = top["word"].to_numpy().view(U), top["c"].to_numpy()
    by_rank = np.lexsort((hashes, -count))
    hashes, count = hashes[by_rank], count[by_rank].astype(np.int64)
    order = np.argsort(hashes)
    head, size = Head(hashes[order], order.astype(np.int64), count), len(hashes)
    encoded = keep(encode(docs, head))

    classes, n = max(2, round(size ** (1 / 3))), min(CORE, size)
    k = classes + 2  # with that of other words and that of the end
    first = np.r_[np.minimum(np.arange(size), n), n, n + 1]
    of = np.full(size + 2, classes, np.int64)
    of[-1] = classes + 1
    of[:n] = exchange(count_pairs(encoded, first, n + 2), classes, ROUNDS)
    for _ in range(SWEEPS if size else 0):
        of = sweep(encoded, of, k, count)

    g = count_pairs(encoded, of, k).astype(float)
    into, mass = g.sum(0), np.bincount(of[:size], count, minlength=k)
    there = (mass > 0) | (np.arange(k) >= classes)
    usual = np.where(there, into + 1, 0) / np.where(there, into + 1, 0).sum()
    transition = np.log10(np.maximum((g + PRIOR * usual) / (g.sum(1, keepdims=True) + PRIOR), 1e-300))
    emission = np.zeros(size + 2)
    emission[:size] = np.log10(count / mass[of[:size]]) if size else 0
    beyond, kinds = total - ends - int(count.sum()), max(distinct - size - (ends > 0), 0)
    return ClassModel(head, of, transition, emission, -float(np.log10(beyond + kinds + 1)), total, distinct, ends)


def log10_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Learns from the documents whose crc32(doc_id as text) mod 7 is not 2.  Null is the empty text, which is one end.  A null
    doc_id counts as the empty text's crc32.  Repeated documents count, and are scored, as often as they are there.
    With nothing to learn from, base scores are 0 and all words are alike.  Other columns are ignored; an empty frame gives
    an empty frame.  Counts, training texts as numbers, and the words of each text that are not clustered are written to the
    checkpoint folder.
    """
    spark = prepare(docs.sparkSession)
    training = docs.where(remainder(7) != 2)
    counted = keep(count_words(training))
    model = train(training, counted)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        size, row = len(m.head.hash), TaskContext.get().partitionId() << 33
        known = np.log10(np.r_[m.head.count, 0, m.ends] + 1.0)
        for batch in batches:
            out: list = [[] for _ in range(4)]
            rare, often, sizes = [], [], []
            for _, _, data, at in pieces(batch.column(2)):
                w = words(data, at, True)
                ranks = m.head.ranks(w.hash)
                ids = tokens(ranks, w, size + 1)
                c = m.of[ids]
                ends = w.first + np.arange(len(w.first))

                def total(x: np.ndarray) -> np.ndarray:
                    s = np.zeros(len(x) + 1)
                    np.cumsum(x, out=s[1:])
                    return s[ends[1:]] - s[ends[:-1]]

                previous = np.r_[len(m.transition) - 1, c[:-1]]
                for to, x in zip(out, (np.diff(ends), total((ids < size) | (ids == size + 1) & (m.ends > 0)), total(known[ids]), total(m.transition[previous, c] + m.emission[ids]))):
                    to.append(x)
                beyond = ranks == size
                hashes, doc = w.hash[beyond], w.doc[beyond]
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])][: len(hashes)])
                rare.append(hashes[new].view(np.int64))
                often.append(np.diff(np.r_[new, len(hashes)]))
                sizes.append(np.bincount(doc[new], minlength=len(at) - 1))
            n, known_n, base, score = (np.concatenate(x) if x else np.empty(0) for x in out)
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes) if sizes else [])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((rare, pa.int64()), (often, pa.int32()))]
            uid = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([uid, *batch.columns[:2], pa.array(n, pa.int64()), pa.array(known_n.astype(np.int64)), pa.array(base), pa.array(score), *lists], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "often"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = keep(docs.select("doc_id", (remainder(7) == 2).alias("held_out"), "text").mapInArrow(run, f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, often array<int>"))

    pairs = scored.select("uid", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.often").alias("often"))
    found = pairs.join(counted, "word").groupBy("uid").agg(F.sum("often").alias("more_known"), F.sum(F.col("often") * F.log10(F.col("c") + 1.0)).alias("more"))
    joined = scored.join(found, "uid", "left")
    more, beyond = F.coalesce("more", F.lit(0.0)), F.aggregate("often", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # N + 1 * (V + 1), as a logarithm
    each = float(np.log10(model.total + model.distinct + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("score") + more + beyond * model.rest).alias("score"),
    )
