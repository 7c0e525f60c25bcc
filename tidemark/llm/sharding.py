"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix (DataFrame functions only).

Each input partition permutes its rows locally.  How many of partition p's rows go to shard s is drawn from the
multivariate hypergeometric law, the law that these counts have under a uniform permutation of all rows, with shard
sizes fixed beforehand.  Rows are then exchanged and permuted again within their shard.

The matrix is drawn with SQL functions alone, down a tree: a few groups of groups draw their shares of each shard in one
row, then the groups of each of them theirs, at the same time, and so on down to the partitions.  A draw inverts the distribution
function over a window of 12 standard deviations and 30 more on each side of the mode; what lies outside is far
below the resolution of a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep

#: Parts, and teams of them, that draw their shares of a team's one after another.
FAN = 64
#: Rows of a shard that one task permutes at the end; larger shards are dealt into more blocks.
BLOCK_ROWS = 100_000


def _uniform(*parts: Column) -> Column:
    """In [0, 1), a function of its inputs."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _long(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric count by inversion of u: of `total` rows `good` are marked and `draws` are drawn."""
    n = F.greatest(total, F.lit(1)).cast("double")
    low, high = F.greatest(_long(0), draws + good - total), F.least(draws, good)
    mode = F.floor((draws + 1.0) * (good + 1.0) / (n + 2.0))
    spread = F.sqrt(F.greatest(draws * (good / n) * (1 - good / n) * (n - draws) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(spread * 12 + 30)
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def ratio(k: Column) -> Column:
        """P(k + 1) / P(k)."""
        return (good - k).cast("double") * (draws - k) / ((k + 1.0) * (total - good - draws + k + 1))

    def grow(state: Column, k: Column) -> Column:
        total_weight = state["sum"] + state["w"]
        return F.struct((state["w"] * ratio(k)).alias("w"), total_weight.alias("sum"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(F.sequence(first, last), start, grow, lambda s: s["sum"])

    def seek(state: Column, k: Column) -> Column:
        below = state["sum"] + state["w"]
        past = below <= state["goal"]
        return F.struct((state["w"] * ratio(k)).alias("w"), below.alias("sum"), state["goal"].alias("goal"), (state["k"] + F.when(past, 1).otherwise(0)).alias("k"))

    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), (u * whole).alias("goal"), first.cast("long").alias("k"))
    found = F.aggregate(F.sequence(first, last), begin, seek, lambda s: s["k"])
    return F.when(low >= high, low).otherwise(F.least(found, last))


def deal(shares: Column, parts: Column, seed: Column) -> Column:
    """Splits `shares` (rows of each shard) over `parts` (array of structs id, n): an array of structs id, shares.

    Parts draw one after another from what is left; within a part, shards are drawn one after another.
    """

    def shard(state: Column, x: Column, part: Column) -> Column:
        taken = hypergeometric(state["pool"], x["left"], state["want"], _uniform(seed, part["id"], x["s"]))
        # the transform binds the draw, which is used twice, to a variable
        return F.element_at(F.transform(F.array(taken), lambda t: F.struct((state["pool"] - x["left"]).alias("pool"), (state["want"] - t).alias("want"), F.concat(state["out"], F.array(t)).alias("out"))), 1)

    def one(state: Column, part: Column) -> Column:
        left = state["left"]
        start = F.struct(F.aggregate(left, _long(0), lambda a, x: a + x).alias("pool"), part["n"].alias("want"), F.array().cast("array<bigint>").alias("out"))
        numbered = F.transform(left, lambda x, i: F.struct(x.alias("left"), i.alias("s")))
        drawn = F.aggregate(numbered, start, lambda a, x: shard(a, x, part), lambda a: a["out"])
        return F.struct(drawn.alias("drawn"), left.alias("left"), state["out"].alias("out"), part["id"].alias("id"))

    def settle(s: Column) -> Column:
        return F.struct(F.zip_with(s["left"], s["drawn"], lambda a, b: a - b).alias("left"), F.concat(s["out"], F.array(F.struct(s["id"].alias("id"), s["drawn"].alias("shares")))).alias("out"))

    empty = F.array().cast("array<struct<id:bigint,shares:array<bigint>>>")
    # the inner transform keeps each part's draw as one value, so that it is computed once
    step = lambda state, part: F.element_at(F.transform(F.array(one(state, part)), settle), 1)
    return F.aggregate(parts, F.struct(shares.alias("left"), empty.alias("out")), step, lambda s: s["out"])


def communication_matrix(counts: DataFrame, shards: int, seed: int, parts: int | None = None) -> DataFrame:
    """(part, shares array<bigint>) from (part, n): exact counts of rows from each part to each shard; parts: how many there may be, numbered from 0.

    Shard sizes differ by one at most and sum to all rows; every part's shares sum to its n.  FAN parts are a team, FAN teams a
    team of teams, and so on, until FAN are left, which draw in one row; then the teams of each one draw, all at the same time, down to the parts.
    """
    if parts is None:
        parts = (counts.agg(F.max("part").alias("most")).first().most or 0) + 1
    levels = [counts.select(F.col("part").cast("bigint").alias("id"), "n")]
    while parts > FAN:
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(F.sum("n").alias("n")))
        parts = -(-parts // FAN)
    rows = levels[-1].agg(F.coalesce(F.sum("n"), _long(0)).alias("rows"), F.sort_array(F.collect_list(F.struct("id", "n"))).alias("parts"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"rows div {shards}") + F.when(s < F.col("rows") % shards, 1).otherwise(0))
    drawn = rows.select(F.explode(deal(sizes, F.col("parts"), F.lit(seed))).alias("x")).select("x.*")
    for k, level in enumerate(reversed(levels[:-1]), 1):
        teams = level.groupBy(F.floor(F.col("id") / FAN).alias("team")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("parts"))
        met = teams.join(drawn.withColumnRenamed("id", "team"), "team")
        drawn = met.select(F.explode(deal(F.col("shares"), F.col("parts"), F.lit(seed + k))).alias("x")).select("x.*")
    return drawn.select(F.col("id").alias("part"), "shares")


def uniform_shards(df: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard): a uniform shuffle of all rows.

    Shard sizes differ by one at most.  Any column may hold nulls; repeated rows are rows of their own and are placed
    independently; an empty frame gives an empty frame.  The caller's columns may have any names, as all are held in one
    struct meanwhile.  The frame should be narrow: it is written to the checkpoint folder once, in its local order.
    """
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    local = held.withColumn("key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions("key").select("row", F.monotonically_increasing_id().alias("at"))
    base = keep(local).select("row", F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("rank"))
    matrix = keep(communication_matrix(base.groupBy("part").agg(F.count("*").alias("n")), shards, seed, base.rdd.getNumPartitions()))

    # the ranks of a part's rows that each shard gets follow one another
    bounds = F.aggregate("shares", F.array(_long(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    sent = base.join(matrix.select("part", bounds.alias("bounds")), "part").select("row", "part", "rank", (F.size(F.filter("bounds", lambda b: b <= F.col("rank"))) - 1).alias("shard"))

    share = matrix.select(F.posexplode("shares").alias("shard", "n")).groupBy("shard").agg(F.sum("n").alias("n"))
    blocks = share.select("shard", F.explode(F.sequence(_long(0), F.floor(F.col("n") / BLOCK_ROWS))).alias("block"), F.floor(F.col("n") / BLOCK_ROWS + 1).alias("blocks"))
    # a row for each shard, so small whatever the table is
    keyed = sent.join(F.broadcast(share.select("shard", F.floor(F.col("n") / BLOCK_ROWS + 1).alias("blocks"))), "shard").withColumn("key", F.xxhash64(F.lit(seed + 100), "part", "rank"))
    # equal parts of the range of keys make blocks, so order by block, then by key, is order by key
    keyed = keyed.withColumn("block", F.floor(F.shiftrightunsigned("key", 32) * F.col("blocks") / F.lit(float(1 << 32))))
    filled = keyed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = blocks.join(filled, ["shard", "block"], "left").select("shard", "block", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), _long(0)).alias("offset"))
    order = Window.partitionBy("shard", "block").orderBy(F.shiftrightunsigned("key", 1), "part", "rank")
    placed = keyed.withColumn("place", F.row_number().over(order)).join(offsets, ["shard", "block"])
    return placed.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("place") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """The law `rows` over documents: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text (null: none) and 16.  Each row, copies included, is a row of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = uniform_shards(narrow, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
