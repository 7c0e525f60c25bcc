"""Bootstraps, expansion and tiered samples whose draws are hashes.

Rows are added up by group before anything is drawn, and a round's draw of a group is a function of both, so what is expanded
are groups by rounds, without any order over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform

# fixed values: cumulative shares of the Poisson law of mean 1 up to 4
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153]


def group_sums(df: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, t, n)."""
    return df.groupBy(group).agg(F.sum(value).alias("t"), F.count("*").alias("n"))


def _rounds(sums: DataFrame, group: str, rounds: int, seed: int) -> DataFrame:
    return sums.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", uniform(F.lit(seed), F.col("round"), F.col(group)))


def set_draws(sums: DataFrame, group: str, rounds: int, seed: int) -> DataFrame:
    """(round, m): means over the groups that a draw with replacement would hold at all, each counted once."""
    drawn = _rounds(sums, group, rounds, seed).where(F.col("u") < 0.632120559)
    return drawn.groupBy("round").agg((F.sum("t") / F.sum("n")).alias("m"))


def poisson_draws(sums: DataFrame, group: str, rounds: int, seed: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, round, m): means with each group as often as the Poisson law says; null where none is drawn."""
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = _rounds(sums, group, rounds, seed).withColumn("times", times)
    return drawn.groupBy(*keys, "round").agg(F.try_divide(F.sum(F.col("times") * F.col("t")), F.sum(F.col("times") * F.col("n"))).alias("m"))


def interval(draws: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, low, high, rounds): the middle 95 % of the rounds' means."""
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(q.alias("q"), F.count("m").alias("rounds")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "rounds")


def expanded(df: DataFrame, id_: str, value: str, copies: int, width: float, seed: int) -> DataFrame:
    """Each row `copies` times, its value blurred by a factor within 1 - width / 2 and 1 + width / 2."""
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return many.withColumn(value, F.col(value) * (1 + width * (uniform(F.lit(seed), F.col(id_), F.col("copy")) - 0.5)))


def tiered(df: DataFrame, tier: str, id_: str, tiers: list, total: int, seed: int) -> DataFrame:
    """`total` rows over the tiers, alike for each, the remainder from the last tiers; a tier that is short gives all it has."""
    each, more = divmod(total, len(tiers))
    wanted = F.lit(0)
    for k, t in enumerate(tiers):
        wanted = F.when(F.col(tier) == t, each + (k >= len(tiers) - more)).otherwise(wanted)
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(tier).orderBy(order, id_)))
    return ranked.where(F.col("place") <= wanted)
