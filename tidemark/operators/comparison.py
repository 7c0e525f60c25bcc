"""Two models on the same rows: paired DeLong (N16), ranking gains with an interval and a tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import resampling
from tidemark.operators.statistics import ndcg, running


def normal_tail(z: Column) -> Column:
    """The two-sided tail of the normal law, from the series of positive terms of erf; 0 beyond 8."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * 2 * state["x"] * state["x"] / (2 * k + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), state["x"].alias("x"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("term"), x.alias("sum"), x.alias("x")), add, lambda s: s["sum"])
    return F.when(F.abs(z) < 8, F.greatest(F.lit(0.0), 1 - 2 / F.sqrt(F.pi()) * F.exp(-x * x) * series)).otherwise(F.when(z.isNotNull(), 0.0))


def placements(df: DataFrame, p: str, y: str, name: str) -> DataFrame:
    """For each distinct score the share of the other class's rows that a positive beats, and that a negative is beaten by."""
    c = running(df.groupBy(p).agg(F.sum(y).cast("bigint").alias("pos"), (F.count("*") - F.sum(y)).cast("bigint").alias("neg")), p, ["pos", "neg"], [])
    beats = F.try_divide(F.col("upto_neg") - F.col("neg") / 2.0, F.col("all_neg"))
    beaten = F.try_divide(F.col("all_pos") - F.col("upto_pos") + F.col("pos") / 2.0, F.col("all_pos"))
    return c.select(F.col(p).alias(f"_{name}"), beats.alias(f"{name}1"), beaten.alias(f"{name}0"))


def paired_delong(df: DataFrame, first: str, second: str, y: str) -> DataFrame:
    """auc_a, auc_b, var_a, var_b, cov, z and p_value (two-sided) of two scores of the same rows.

    Rows of equal scores and outcome are one with a count; each score's placements come from running counts of its distinct
    values and meet these rows by value.  Rows with nulls are left out.  Null with fewer than two rows of a class; z is
    null where the variance of the difference is 0.
    """
    clean = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(y).isNotNull())
    rows = clean.groupBy(F.col(first).alias("_a"), F.col(second).alias("_b"), F.col(y).alias("_y")).agg(F.count("*").alias("n"))
    met = rows.join(placements(clean, first, y, "a"), "_a").join(placements(clean, second, y, "b"), "_b")
    one = F.col("_y") == 1
    a, b = (F.when(one, F.col(f"{s}1")).otherwise(F.col(f"{s}0")) for s in "ab")
    sums = met.groupBy(one.alias("one")).agg(F.sum("n").alias("m"), *[F.sum(F.col("n") * v).alias(k) for k, v in {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}.items()])
    spread = lambda xy, x, y_: (F.col(xy) - F.col(x) * F.col(y_) / F.col("m")) / F.nullif(F.col("m") - 1, F.lit(0)) / F.col("m")
    per = sums.select("one", *[F.when(F.col("one"), F.col(s) / F.col("m")).alias(f"auc_{s}") for s in "ab"], spread("aa", "a", "a").alias("var_a"), spread("bb", "b", "b").alias("var_b"), spread("ab", "a", "b").alias("cov"))
    both = per.agg(*[F.max(f"auc_{s}").alias(f"auc_{s}") for s in "ab"], *[F.when((F.count("*") == 2) & (F.count(c) == 2), F.sum(c)).alias(c) for c in ("var_a", "var_b", "cov")])
    var = F.greatest(F.col("var_a") + F.col("var_b") - 2 * F.col("cov"), F.lit(0.0))
    z = F.when(var > 1e-18, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var))
    return both.select("*", z.alias("z")).select("*", normal_tail(F.col("z")).alias("p_value"))


def ndcg_difference(df: DataFrame, query: str, item: str, gain: str, first: str, second: str, k: int, rounds: int, seed: int) -> DataFrame:
    """ndcg_a, ndcg_b, delta (a - b), low, high (95 % by bootstrap over queries) and verdict: `tie` where the interval holds 0, else the better of a and b."""
    a, b = (ndcg(df, query, item, gain, s, k).withColumnRenamed("ndcg", n) for s, n in ((first, "a"), (second, "b")))
    both = a.join(b, query)
    means = both.agg(F.avg("a").alias("ndcg_a"), F.avg("b").alias("ndcg_b"))
    sums = both.select(query, (F.col("a") - F.col("b")).alias("t"), F.lit(1).cast("bigint").alias("n"))
    limits = resampling.interval(resampling.poisson_draws(sums, query, rounds, seed)).select("low", "high")
    verdict = F.when(F.col("low") > 0, "a").when(F.col("high") < 0, "b").otherwise("tie")
    return means.join(F.broadcast(limits), F.lit(True)).select("ndcg_a", "ndcg_b", (F.col("ndcg_a") - F.col("ndcg_b")).alias("delta"), "low", "high", verdict.alias("verdict"))
