"""Weak supervision: label functions, their agreement, accuracies and votes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir

ABSTAIN = -1


def coverage(labels: DataFrame, functions: list[str]) -> DataFrame:
    """A row for each function, and one for all: how much it labels, and the rate of conflicts."""
    voted = lambda f: F.col(f) != ABSTAIN
    some, ones, zeros = (F.greatest(*[F.when(c(f), 1).otherwise(0) for f in functions]) for c in (voted, lambda f: F.col(f) == 1, lambda f: F.col(f) == 0))
    row = labels.agg(*[F.avg(voted(f).cast("double")).alias(f) for f in functions], F.avg(some.cast("double")).alias("any"), F.avg((ones * zeros).cast("double")).alias("conflict"))
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, [*functions, "any", "conflict"])), F.array(*functions, "any", "conflict"))).alias("name", "share"))


def agreements(labels: DataFrame, functions: list[str]) -> DataFrame:
    """(a, b, n, e, jaccard) of each pair, in one pass: joint votes, mean product of signs, and how alike coverage is."""
    parts = []
    for a, b in combinations(functions, 2):
        x, y = F.col(a), F.col(b)
        both, either = (x != ABSTAIN) & (y != ABSTAIN), (x != ABSTAIN) | (y != ABSTAIN)
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.avg(F.when(both, (2 * x - 1) * (2 * y - 1)).cast("double")).alias("e"), F.try_divide(F.count_if(both), F.count_if(either)).alias("jaccard")))
    return labels.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def accuracies(pairs: DataFrame, least: int = 10) -> DataFrame:
    """(name, alpha): the median over triplets of half of 1 + sqrt(|e_ab e_ac / e_bc|), kept in [.51, .99], else .6."""
    both = pairs.select("a", "b", "n", "e").union(pairs.select("b", "a", "n", "e")).where((F.col("n") >= least) & (F.col("e") != 0))
    ab, ac, bc = both.alias("ab"), both.alias("ac"), both.alias("bc")
    triple = ab.join(ac, (F.col("ab.a") == F.col("ac.a")) & (F.col("ab.b") < F.col("ac.b"))).join(bc, (F.col("bc.a") == F.col("ab.b")) & (F.col("bc.b") == F.col("ac.b")))
    alpha = 0.5 * (1 + F.sqrt(F.abs(F.col("ab.e") * F.col("ac.e") / F.col("bc.e"))))
    found = triple.select(F.col("ab.a").alias("name"), F.greatest(F.lit(0.51), F.least(F.lit(0.99), alpha)).alias("alpha")).groupBy("name").agg(F.median("alpha").alias("alpha"))
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    return names.join(found, "name", "left").select("name", F.coalesce("alpha", F.lit(0.6)).alias("alpha"))


def weighted_vote(labels: DataFrame, functions: list[str], alphas: DataFrame) -> DataFrame:
    """Adds vote: the sign of the sum of log odds (within 2 of 0) of the functions that voted; abstains at a tie."""
    weights = alphas.agg(F.map_from_entries(F.collect_list(F.struct("name", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log(F.col("alpha") / (1 - F.col("alpha"))))).alias("w")))).alias("w"))
    total = sum((F.when(F.col(f) == 1, F.col("w")[f]).when(F.col(f) == 0, -F.col("w")[f]).otherwise(0.0) for f in functions), F.lit(0.0))
    return labels.join(F.broadcast(weights), F.lit(True)).withColumn("_t", F.round(total, 9)).withColumn("vote", _sign(F.col("_t"))).drop("_t", "w")


def majority_vote(labels: DataFrame, functions: list[str]) -> DataFrame:
    """N33."""
    total = sum((F.when(F.col(f) == 1, 1).when(F.col(f) == 0, -1).otherwise(0) for f in functions), F.lit(0))
    return labels.withColumn("vote", _sign(total))


def cross_fit(labels: DataFrame, functions: list[str], fold: str, folds: int) -> DataFrame:
    """Weighted votes of each fold's rows, with accuracies from the rows of the other folds.

    Labels are written once and read by all folds.
    """
    shared_dir(labels.sparkSession)
    labels = labels.checkpoint()
    voted = [weighted_vote(labels.where(F.col(fold) == f), functions, accuracies(agreements(labels.where(F.col(fold) != f), functions))) for f in range(folds)]
    return reduce(DataFrame.union, voted)


def _sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, 0).otherwise(ABSTAIN)
