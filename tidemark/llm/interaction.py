"""How filters interact: what each removes in every order, from parity sums (a Walsh-Hadamard transform).

A document's mask says which of the filters A to E it fails.  For each part and label, 32 sums of +1 and -1 are taken over the
documents, the sign of sum s being the parity of the filters that s and the mask share.  The transform is its own inverse but
for a factor of 32, so the sums give the exact number of documents of each mask; these 32 cells answer every order.  A filter
removes what fails it and none before it.  Its Shapley value needs no orders: a document that fails f filters is removed by
each of them in 120 / f of the 120 orders.

Sums of parts and labels are all that meets; a text is read once, and known by its SHA-256 from there on.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, prepare

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
WHITE = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column, words: Column) -> Column:
    """The bits of A to D.  A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * A-Z > 2 * code points; D: any of #$%&*|."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return reduce(Column.__add__, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def masks(docs: DataFrame) -> DataFrame:
    """(part, doc_id, mask, n): rows of equal part, doc_id and text counted together, with the bits of A to E."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    split = read.select("*", F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"))
    narrow = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    counted = keep(narrow.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    # only the rows of a text's smallest doc_id, and those without one, have none before them
    first = counted.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known, unknown = counted.where("doc_id is not null"), counted.where("doc_id is null")
    later = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    found = known.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + later)
    return found.select("part", "doc_id", "mask", "n").unionByName(unknown.select("part", "doc_id", "mask", "n"))


def parity_sums(rows: DataFrame, *by: str) -> DataFrame:
    """The 32 signed sums of n of each group, as the array `sums`."""
    sign = lambda s: F.when(F.bit_count(F.col("mask").bitwiseAND(s)) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    return rows.groupBy(*by).agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(CELLS)]).select(*by, F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """The number of documents of each mask, from the parity sums: the transform again, a filter at a time, and a 32nd of it."""
    at = lambda x, m: F.element_at(x, m + 1)

    def step(bit: int):
        sign = lambda m: F.when(m.bitwiseAND(bit) == 0, 1).otherwise(-1)
        return lambda x: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: at(x, m.bitwiseAND(CELLS - 1 - bit)) + sign(m) * at(x, m.bitwiseOR(bit)))

    for k in range(len(FILTERS)):
        # the outer transform binds the array, whose elements are used twice
        sums = F.element_at(F.transform(F.array(sums), step(1 << k)), 1)
    return F.transform(sums, lambda x: F.shiftright(x, len(FILTERS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic.  A null text is empty, a null source the part ''.  A document
    whose doc_id is null has no label and no smaller doc_id, and none is smaller for it.  Repeated rows count each; of several
    labels of a document any 1 counts, and documents without label are neither good nor toxic.  Other columns are ignored, and an empty frame gives an
    empty frame.
    """
    prepare(docs.sparkSession)
    rows = masks(docs)
    marked = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(marked("quality"), marked("toxic"))
    none = F.lit(False)
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("quality", "toxic")})
    rows = known.unionByName(rows.where("doc_id is null").withColumns({"quality": none, "toxic": none}))
    found = parity_sums(rows, "part", "quality", "toxic").select("part", "quality", "toxic", cells(F.col("sums")).alias("cells"))
    # four labels of a part at most
    label = found.groupBy("part").agg(F.collect_list(F.struct("quality", "toxic", "cells")).alias("labels"))

    def total(which) -> Column:
        start = F.array_repeat(F.lit(0).cast("long"), CELLS)
        return F.aggregate(F.filter("labels", which), start, lambda a, x: F.zip_with(a, x["cells"], lambda p, q: p + q))

    parts = label.select("part", total(lambda x: F.lit(True)).alias("all"), total(lambda x: x["quality"]).alias("good"), total(lambda x: x["toxic"]).alias("bad"))
    steps = parts.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [F.instr("filter_order", letter) for letter in FILTERS]
    bits = lambda holds: reduce(Column.__add__, [F.when(holds(p), 1 << k).otherwise(0) for k, p in enumerate(place)])
    asked = steps.select("*", bits(lambda p: p == F.col("step")).alias("own"), bits(lambda p: p < F.col("step")).alias("before"))
    return asked.select("part", "filter_order", "step", *answers(F.col("own"), F.col("before")))


def answers(own: Column, before: Column) -> list[Column]:
    """The counts of the filter `own` (a bit) after those of `before` (bits), from the cells of a part."""

    def over(name: str, weight) -> Column:
        return F.aggregate(F.transform(name, lambda n, m: n * weight(m).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    fails, free = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & free(m)
    return [
        over("all", lambda m: ~fails(m) & free(m)).alias("kept"),
        over("all", removed).alias("removed"),
        over("all", lambda m: fails(m) & ~free(m)).alias("redundant"),
        over("all", lambda m: m == own).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("bad", removed).alias("toxic_lost"),
        over("all", lambda m: F.when(fails(m), len(ORDERS) / F.greatest(F.bit_count(m), F.lit(1))).otherwise(0)).alias("shapley"),
    ]
