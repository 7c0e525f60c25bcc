"""Quality rules: counts of whole texts, and bands of perplexity under an n-gram model.

The model is modified Kneser-Ney of order 4 over code points, with three edges before a text and one after it, so that all
scripts are treated alike.  Spark counts n-grams exactly over all texts, and joins of each order with its histories and with the
order below give every n-gram its probability; none is left out.  Workers hold the most frequent ones, at most MOST, as sorted
64-bit hashes beside their values, and look a text's n-grams up in them, each once, by binary search.  The rarer ones of all
texts meet their probabilities in a join.  Logarithms are whole numbers of 1 / UNIT bits, so sums don't depend on who adds up.

Each language's documents give a median and a median deviation of log2 perplexity.  A document is rejected that lies
further than `lower` deviations below or `upper` ones above.  Languages come from the column `lang`; null is a language of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import statistics
from tidemark.llm._arrow import keep, pieces, prepare
from tidemark.llm._words import U, mix

#: Length of the longest n-grams; bits of a symbol; the symbol at a text's edges, one above all code points.
ORDER, BITS, EDGE = 4, 21, 0x110000
#: N-grams that workers hold at most; it decides about time, never about results.
MOST = 1 << 22
#: Parts of a bit in which logarithms are added up; steps of a factor of 2 in which n-grams are called equally frequent.
UNIT, FINE = 1 << 24, 16
#: Different n-grams that a task adds up before it hands them on.
HELD = 1 << 20
#: Steps of log2 perplexity in which medians are counted.
STEP = 1 / 256
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What a row is known by: equal rows have the same perplexity.
ROW = "xxhash64(doc_id, text)"
#: What a symbol counts for in a hash, by its distance from the n-gram's end.
_WEIGHTS = mix(np.arange(11, 11 + ORDER, dtype=U)) | U(1)


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all documents with their edges, index of each that is predicted, offsets of each document's own)."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum(statistics.FIRST[data], out=first[1:])
    at = first[at]
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    padded = np.full(len(codes) + ORDER * n, EDGE, np.int64)
    padded[np.arange(len(codes)) + ORDER * doc + ORDER - 1] = codes
    own = np.ones(len(padded), bool)
    starts = at[:-1] + ORDER * np.arange(n)
    for k in range(ORDER - 1):
        own[starts + k] = False
    return padded, np.flatnonzero(own), at + np.arange(n + 1)


def sums(padded: np.ndarray) -> list[np.ndarray]:
    """By order less one: the hash of the n-gram that ends at each symbol (before it is mixed)."""
    s, found = np.zeros(len(padded), U), []
    values = padded.astype(U) + U(1)
    for k in range(ORDER):
        s = s.copy()
        s[k:] += values[: len(values) - k] * _WEIGHTS[k]
        found.append(s)
    return found


def longest(padded: np.ndarray) -> np.ndarray:
    """The mixed hash of the longest n-gram that ends at each symbol."""
    s, values = np.zeros(len(padded), U), padded.astype(U) + U(1)
    for k in range(ORDER):
        s[k:] += values[: len(values) - k] * _WEIGHTS[k]
    return mix(s)


def once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of one of each, which of these each is, how often each is there)."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(ranked), np.int64)
    which[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], which, np.diff(np.r_[starts, len(ranked)])


@dataclass
class KneserNey:
    """By order: sorted hashes of n-grams and log2 of their probability, sorted hashes of histories and log2 of their
    back-off weight.  unknown: log2 of the probability of a symbol that the model hasn't."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    backoff: list[tuple[np.ndarray, np.ndarray]]
    unknown: float

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its value or 0)."""
        keys, values = table
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        there = keys[at] == hashes
        return there, np.where(there, values[at], 0.0)

    def log2(self, ends: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """Of n-grams by their hashes of each order, and those of their histories (of one symbol less)."""
        total, open_ = np.zeros(len(ends[0])), np.arange(len(ends[0]))
        for k in range(ORDER - 1, -1, -1):
            there, value = self.find(self.grams[k], mix(ends[k][open_]))
            total[open_] += value
            open_ = open_[~there]
            if k:
                total[open_] += self.find(self.backoff[k], mix(histories[k - 1][open_]))[1]
        total[open_] += self.unknown
        return total

    def score(self, padded: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log2 of the probability of each symbol in `own`."""
        s = sums(padded)
        one, which, _ = once(s[-1][own])
        place = own[one]
        return self.log2([x[place] for x in s], [x[place - 1] for x in s[:-1]])[which]


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen one to four times."""
    if not all(n):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


def fit(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], kinds: int) -> KneserNey:
    """From each order's kept n-grams (rows of symbols), their counts, their history's whole count, and the order's
    discounts; kinds: how many different symbols there are."""
    model = KneserNey([], [(np.empty(0, U), np.empty(0))], 0.0)
    left = 1.0
    for k, (grams, seen, whole, cut) in enumerate(levels):
        rows = len(grams)
        s = np.zeros(rows, U)
        ends, histories = [], []
        for j in range(k + 1):  # from the last symbol backwards
            value = grams[:, k - j].astype(U) + U(1)
            s = s + value * _WEIGHTS[j]
            ends.append(s)
            if j:
                histories.append((histories[-1] if histories else U(0)) + value * _WEIGHTS[j - 1])
        own = np.maximum(seen - cut[np.minimum(seen, 3)], 0) / np.maximum(whole, 1)
        if k == 0:
            left = 1 - float(own.sum())
            model.unknown = float(np.log2(max(left, 1e-12) / (kinds + 1)))
            p = own + left / (kinds + 1)
        else:
            key, which = np.unique(mix(histories[-1]), return_inverse=True)
            weight = np.maximum(1 - np.bincount(which, own, minlength=len(key)), 1e-12)
            pad = [np.zeros(rows, U)] * (ORDER - k)
            model.grams += [(np.empty(0, U), np.empty(0))] * (ORDER - k)
            model.backoff += [(np.empty(0, U), np.empty(0))] * (ORDER - k)
            p = own + weight[which] * 2.0 ** model.log2([*ends[:-1], *pad], [*histories[:-1], *pad])
            del model.grams[k:], model.backoff[k:]
            model.backoff.append((key, np.log2(weight).astype(np.float32)))
        hashes = mix(ends[-1])
        order = np.argsort(hashes)
        model.grams.append((hashes[order], np.log2(p[order]).astype(np.float32)))
    return model


def count(docs: DataFrame) -> DataFrame:
    """(high, low, n): the n-grams of all texts, two symbols in each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def add_up() -> tuple[np.ndarray, ...]:
            hashes, high, low, n = (np.concatenate(x) for x in zip(*held))
            one, which, _ = once(hashes)
            return hashes[one], high[one], low[one], np.bincount(which, n, minlength=len(one)).astype(np.int64)

        def said(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in x[1:]], ["high", "low", "n"])

        waiting = 0
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                padded, own, _ = symbols(data, at)
                hashes = longest(padded)[own]
                one, _, n = once(hashes)
                p = own[one]
                held.append((hashes[one], padded[p - 3] << BITS | padded[p - 2], padded[p - 1] << BITS | padded[p], n))
                waiting += len(one)
                if waiting > HELD:
                    held = [add_up()]
                    waiting = len(held[0][0])
                    if waiting > HELD // 2:
                        yield said(held[0])
                        held, waiting = [], 0
        if held:
            yield said(add_up())

    return docs.select("text").mapInArrow(run, "high bigint, low bigint, n bigint").groupBy("high", "low").agg(F.sum("n").alias("n"))


def orders(docs: DataFrame) -> list[DataFrame]:
    """(s0, s1 ..., n): the n-grams of each order and their counts, from order 1."""
    prepare(docs.sparkSession)
    mask = F.lit((1 << BITS) - 1)
    second, last = F.col("high").bitwiseAND(mask), F.col("low").bitwiseAND(mask)
    counted = keep(count(docs).select(F.shiftright("high", BITS).alias("s0"), second.alias("s1"), F.shiftright("low", BITS).alias("s2"), last.alias("s3"), "n"))
    found = [counted]
    for k in range(ORDER - 1, 0, -1):  # of shorter ones it counts how many symbols go before them
        found.append(keep(found[-1].groupBy(*[F.col(f"s{j}").alias(f"s{j - 1}") for j in range(1, k + 1)]).agg(F.count("*").alias("n"))))
    return found[::-1]


def facts(table: DataFrame) -> tuple[list[int], int, int]:
    """(how many n-grams are there one to four times, how many there are, sum of counts) of an order."""
    often = [F.count(F.when(F.col("n") == x, 1)) for x in (1, 2, 3, 4)]
    *few, kinds, total = table.agg(*often, F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return few, kinds, total


def probabilities(docs: DataFrame) -> DataFrame:
    """(high, low, n, bits): all n-grams of the longest order, two symbols in each number, and -log2 of their probability in UNITs."""
    for k, table in enumerate(orders(docs)):
        few, kinds, total = facts(table)
        cut = discounts(few)
        own = F.col("n") - F.element_at(F.array(*map(F.lit, cut.tolist())), F.least("n", F.lit(3)).cast("int") + 1)
        one, two, more = (F.count(F.when(x, 1)) for x in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2))
        if k == 0:
            left = float(cut[1:] @ [few[0], few[1], kinds - few[0] - few[1]]) / max(total, 1)
            found = table.select("s0", "n", (own / max(total, 1) + left / (kinds + 1)).alias("p"))
            continue
        history, end = [f"s{j}" for j in range(k)], [f"s{j}" for j in range(1, k + 1)]
        left = float(cut[1]) * one + float(cut[2]) * two + float(cut[3]) * more
        whole = table.groupBy(*history).agg(F.sum("n").alias("whole"), left.alias("left"))
        below = found.select(*[F.col(f"s{j}").alias(f"s{j + 1}") for j in range(k)], F.col("p").alias("below"))
        found = table.join(whole, history).join(below, end).select("s0", *end, "n", ((own + F.col("left") * F.col("below")) / F.col("whole")).alias("p"))
    pair = lambda x, y: F.shiftleft(x, BITS).bitwiseOR(F.col(y))
    return keep(found.select(pair("s0", "s1").alias("high"), pair("s2", "s3").alias("low"), "n", F.round(-F.log2("p") * UNIT).cast("bigint").alias("bits")))


def parted(table: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """((sorted hashes, bits) of the most frequent n-grams, at most MOST; the rows of all others, or None) of probabilities."""
    level = F.floor(F.log2("n") * FINE)
    least, n = None, 0
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n + r.n > MOST:
            held, rare = (table.where(level >= least), table.where(level < least)) if n else (table.where("false"), table)
            break
        least, n = r.level, n + r.n
    else:
        held, rare = table, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            s = np.zeros(len(high), U)
            for weight, x in zip(_WEIGHTS, (low & (1 << BITS) - 1, low >> BITS, high & (1 << BITS) - 1, high >> BITS)):
                s += (x.astype(U) + U(1)) * weight
            yield pa.RecordBatch.from_arrays([pa.array(mix(s).view(np.int64)), batch.column(2)], ["hash", "bits"])

    rows = held.select("high", "low", F.col("bits").cast("int")).mapInArrow(run, "hash bigint, bits int").toArrow()
    hashes = rows["hash"].to_numpy().view(U)
    order = np.argsort(hashes)
    return (hashes[order], rows["bits"].to_numpy()[order]), rare


def train(docs: DataFrame) -> KneserNey:
    """A model for other texts than those it is of, within bounds; rules don't use it.

    Each order has the n-grams with 1 / MOST of its counts, at most MOST; what rarer ones have goes to their history's back-off
    weight, so probabilities add up to 1.
    """
    levels = []
    for k, table in enumerate(orders(docs)):
        few, kinds, total = facts(table)
        history = [f"s{j}" for j in range(k)]
        kept = table.where(F.col("n") * MOST >= total)
        if history:
            kept = kept.join(table.groupBy(*history).agg(F.sum("n").alias("whole")), history)
        else:
            kept = kept.withColumn("whole", F.lit(total))
            symbols_there = kinds
        rows = kept.select(*history, f"s{k}", "n", "whole").toArrow()
        columns = [rows[c].to_numpy() for c in rows.column_names]
        levels.append((np.stack(columns[:-2], axis=1), columns[-2], columns[-1], discounts(few)))
    return fit(levels, symbols_there)


def score(docs: DataFrame, sent: Broadcast, names: list[str]) -> DataFrame:
    """Columns c0, c1 ... for those named, then the counts of each text, its row's hash, the bits of its n-grams that workers
    hold, and its length (code points and its end)."""
    put = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            found: list = [[] for _ in range(len(COUNTS) + 2)]
            for _, _, data, at in pieces(batch.column(put + 1)):
                padded, own, offsets = symbols(data, at)
                hashes = longest(padded)[own]
                one, which, _ = once(hashes)
                bits = np.zeros(len(own) + 1, np.int64)
                np.cumsum(KneserNey.find(held, hashes[one])[1].astype(np.int64)[which], out=bits[1:])
                for to, x in zip(found, [*statistics.counts(data, at).values(), bits[offsets[1:]] - bits[offsets[:-1]], np.diff(offsets)]):
                    to.append(x)
            columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: put + 1], *columns], [f"c{k}" for k in range(put)] + ["row", *COUNTS, "bits", "length"])

    fields = [f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names)] + [f"{c} bigint" for c in ("row", *COUNTS, "bits", "length")]
    return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.expr(ROW).alias("row"), F.col("text").alias("t")).mapInArrow(run, ", ".join(fields))


def rarer(docs: DataFrame, sent: Broadcast, rare: DataFrame) -> DataFrame:
    """(row, more): the bits of those n-grams of a text that workers don't hold, which rare (high, low, n, bits) has; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for low, _, data, at in pieces(batch.column(1)):
                padded, own, offsets = symbols(data, at)
                hashes = longest(padded)[own]
                left = np.flatnonzero(~KneserNey.find(held, hashes)[0])
                doc = np.searchsorted(offsets, left, "right") - 1
                one, _, n = once(hashes[left] ^ mix(doc.astype(U) + U(1)))
                p = own[left[one]]
                columns = [rows[low + doc[one]], padded[p - 3] << BITS | padded[p - 2], padded[p - 1] << BITS | padded[p], n]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["row", "high", "low", "n"])

    met = docs.select(F.expr(ROW).alias("row"), "text").mapInArrow(run, "row bigint, high bigint, low bigint, n bigint")
    times = met.repartition("high", "low").groupBy("high", "low", "row").agg(F.max("n").alias("times"))
    return keep(times.join(rare.select("high", "low", "bits"), ["high", "low"]).groupBy("row").agg(F.sum(F.col("times") * F.col("bits")).alias("more")))


def learnt(docs: DataFrame) -> tuple[Broadcast, DataFrame | None]:
    """(what workers hold of the model of all texts, the bits of the rest by row; None where they hold all)."""
    held, rare = parted(probabilities(docs))
    sent = docs.sparkSession.sparkContext.broadcast(held)
    return sent, None if rare is None else rarer(docs, sent, rare)


def whole(scored: DataFrame, more: DataFrame | None) -> DataFrame:
    """scored with the log2_perplexity of each text, of all its n-grams."""
    bits = F.col("bits")
    if more is not None:
        scored, bits = scored.join(more, "row", "left"), bits + F.coalesce("more", F.lit(0))
    return scored.withColumn("log2_perplexity", bits / UNIT / F.col("length")).drop("row", "bits", "length", "more")


def bands(scored: DataFrame, lower: float, upper: float) -> DataFrame:
    """(lang, low, high) from lang and log2_perplexity of documents of ten words or more."""
    counted = scored.where("n_words >= 10").groupBy("lang", F.round(F.col("log2_perplexity") / STEP).cast("bigint").alias("x")).agg(F.count("*").alias("n"))

    def middle(df: DataFrame, x: str) -> DataFrame:
        key = Window.partitionBy("lang")
        run = df.select("lang", F.col(x).alias("x"), "n", F.sum("n").over(key.orderBy(x)).alias("upto"), F.sum("n").over(key).alias("all"))
        return run.where("2 * upto >= all").groupBy("lang").agg(F.min("x").alias("middle"))

    median = middle(counted, "x")
    away = counted.alias("c").join(median.alias("m"), F.col("c.lang").eqNullSafe(F.col("m.lang"))).select(F.col("c.lang").alias("lang"), F.abs(F.col("x") - F.col("middle")).alias("away"), "n")
    spread = middle(away.groupBy("lang", "away").agg(F.sum("n").alias("n")), "away")
    reach = lambda width: F.greatest(F.col("d.middle") * STEP * 1.4826 * width, F.lit(MARGIN))
    joined = median.alias("m").join(spread.alias("d"), F.col("m.lang").eqNullSafe(F.col("d.lang")))
    return joined.select(F.col("m.lang").alias("lang"), (F.col("m.middle") * STEP - reach(lower)).alias("low"), (F.col("m.middle") * STEP + reach(upper)).alias("high"))


#: Least half-width of a band in bits, for languages whose documents hardly differ; deviations that a band reaches down and
#: up; and what it reaches further for a text, over the square root of its characters, as a short text's perplexity varies more.
MARGIN, LOWER, UPPER, SHORT = 0.1, 3.5, 3.5, 1.0


def verdict(band: DataFrame, scored: DataFrame, lang: str) -> DataFrame:
    """scored with base_failed and kept, from its language's band."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    more = SHORT / F.sqrt(F.col("word_chars") + 1.0)
    inside = F.coalesce(F.col("log2_perplexity").between(F.col("low") - more, F.col("high") + more), F.lit(True))
    joined = scored.join(F.broadcast(band.withColumnRenamed("lang", "_lang")), F.col(lang).eqNullSafe(F.col("_lang")), "left")
    return joined.withColumns({"base_failed": failed, "kept": ~failed & inside}).drop("_lang", "low", "high")


def rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log2_perplexity of every row.

    A null text is the empty text: no words, so base_failed and not kept.  The model, medians and deviations are taken from
    all rows, repeated ones as often as they are there.  A document is kept that passes the base rules and whose
    perplexity lies in its language's band, the ends included; where no document of a language has ten words there is no
    band, and none of them passes the base rules.  Other columns are ignored.  Empty frames stay empty.
    """
    sent, more = learnt(docs)
    scored = keep(whole(score(docs, sent, ["doc_id", "lang"]), more))
    judged = verdict(keep(bands(scored.withColumnRenamed("c1", "lang"), lower, upper)), scored, "c1")
    return judged.select(F.col("c0").alias("doc_id"), *COUNTS, "base_failed", "kept", "log2_perplexity")


def accepted(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The rows of docs, with all their columns as they are, that the rules keep; see rules.

    Texts are scored twice, for the bands and for the verdicts, rather than written in between.  Columns of docs may have any
    names.
    """
    sent, more = learnt(docs)
    band = keep(bands(whole(score(docs, sent, ["lang"]), more).withColumnRenamed("c0", "lang"), lower, upper))
    names = docs.columns
    judged = verdict(band, whole(score(docs, sent, names), more), f"c{names.index('lang')}")
    return judged.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
