"""Group folds and models fitted from sums: stratified folds, nested selection, one group left out, importance by permutation
(N37, N38, H13, H14, H18).

The model is Gaussian and naive: of each class the share of rows and of each feature the mean and variance, the latter drawn towards
that of all rows by a part `shrink`.  It is fitted from counts, sums and sums of squares, and those of a training set are
those of all rows less those of what is held out.  So one pass over the rows gives the models of all folds, of all pairs of
folds and of all groups left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators.statistics import roc_auc, running
from tidemark.sources.shared import kept

#: Variances are at least this part of the variance of all rows.
FLOOR = 1e-9


def stratified_groups(df: DataFrame, group: str, y: str, folds: int) -> DataFrame:
    """(group, fold): groups dealt so that folds are alike in rows and positives; a group is in one fold.

    Groups of equal counts are a profile, and dealt evenly; what a profile has beyond a multiple of `folds` goes, group by group, from
    the most uneven profile on, to the fold that it leaves the most even.  The driver sees profiles, which are pairs of counts, not groups.
    A group's place in its profile is its rank by hash.  Rows without a label count as negative; a null group is a group.
    """
    positive = F.coalesce(F.col(y) == 1, F.lit(False)).cast("bigint")
    counts = kept(df.groupBy(group).agg(F.sum(positive).alias("pos"), F.count("*").alias("n")))
    profiles = counts.groupBy("pos", "n").agg(F.count("*").alias("groups")).collect()
    held = [[0, 0] for _ in range(folds)]
    left: dict[tuple[int, int], list[int]] = {}
    for r in profiles:
        for f in held:
            f[0] += r.groups // folds * r.pos
            f[1] += r.groups // folds * (r.n - r.pos)
    total = [max(1, sum(r.pos * r.groups for r in profiles)), max(1, sum((r.n - r.pos) * r.groups for r in profiles))]
    for r in sorted(profiles, key=lambda r: (-abs(r.pos - (r.n - r.pos)), -r.n, r.pos)):
        for _ in range(r.groups % folds):
            add = (r.pos, r.n - r.pos)

            def uneven(k: int) -> tuple[float, int, int]:
                shares = [[(f[c] + (add[c] if j == k else 0)) / total[c] for j, f in enumerate(held)] for c in (0, 1)]
                mean = [sum(s) / folds for s in shares]
                return sum(sum((x - m) ** 2 for x in s) for s, m in zip(shares, mean)), sum(held[k]), k

            best = min(range(folds), key=uneven)
            left.setdefault((r.pos, r.n), []).append(best)
            held[best][0] += add[0]
            held[best][1] += add[1]
    spread = df.sparkSession.createDataFrame([(r.pos, r.n, r.groups // folds * folds, left.get((r.pos, r.n), [])) for r in profiles], "pos bigint, n bigint, even bigint, rest array<int>")
    hashed = counts.withColumn("h", F.xxhash64(F.col(group))).withColumn("one", F.lit(1))
    ranked = running(hashed.groupBy("pos", "n", "h").agg(F.sum("one").alias("one")), "h", ["one"], ["pos", "n"]).select("pos", "n", "h", "upto_one")
    place = F.col("upto_one") - 1
    fold = F.when(place < F.col("even"), place % folds).otherwise(F.element_at("rest", F.greatest(F.lit(1), F.least(place - F.col("even") + 1, F.size("rest").cast("bigint"))).cast("int"))).cast("int")
    return hashed.join(ranked, ["pos", "n", "h"]).join(F.broadcast(spread), ["pos", "n"]).select(group, fold.alias("fold"))


def sums(df: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    """(keys, n0, n1, and for each feature and class sum and square): all that a model needs, in one pass."""
    out = []
    for k in (0, 1):
        mine = F.col(y) == k
        out.append(F.count_if(mine).alias(f"n{k}"))
        for f in features:
            out += [F.coalesce(F.sum(F.when(mine, F.col(f))), F.lit(0.0)).alias(f"{f}_s{k}"), F.coalesce(F.sum(F.when(mine, F.col(f) * F.col(f))), F.lit(0.0)).alias(f"{f}_q{k}")]
    return df.groupBy(*keys).agg(*out)


def names(features: list[str]) -> list[str]:
    return ["n0", "n1", *[f"{f}_{s}{k}" for f in features for k in (0, 1) for s in "sq"]]


def score(features: list[str], shrink: Column, of: str = "") -> Column:
    """The log odds of class 1 by a model of the sums in columns `of`name; null where the model lacks a class."""
    c = lambda n: F.col(f"{of}{n}")
    total = F.log(c("n1") / c("n0"))
    for f in features:
        x, n = F.col(f), c("n0") + c("n1")
        mean = (c(f"{f}_s0") + c(f"{f}_s1")) / n
        pooled = F.greatest((c(f"{f}_q0") + c(f"{f}_q1")) / n - mean * mean, F.lit(1e-300))
        for k, sign in ((0, 1), (1, -1)):
            m = c(f"{f}_s{k}") / c(f"n{k}")
            var = F.greatest((1 - shrink) * (c(f"{f}_q{k}") / c(f"n{k}") - m * m) + shrink * pooled, FLOOR * pooled)
            total = total + sign * ((x - m) * (x - m) / (2 * var) + F.log(var) / 2)
    return F.when((c("n0") > 0) & (c("n1") > 0), total)


def without(part: DataFrame, whole: DataFrame, features: list[str]) -> DataFrame:
    """The sums of all rows less those of each part."""
    all_ = whole.select(*[F.col(n).alias(f"_{n}") for n in names(features)])
    return part.join(F.broadcast(all_), F.lit(True)).select(*[c for c in part.columns if c not in names(features)], *[(F.col(f"_{n}") - F.col(n)).alias(n) for n in names(features)])


def nested(df: DataFrame, fold: str, features: list[str], y: str, folds: int, grid: list[float]) -> DataFrame:
    """(outer, shrink, inner_auc, auc) of each outer fold: the shrink of the grid with the best mean AUC over inner folds, and the outer fold's AUC with it.

    For outer fold o each other fold i is scored once by a model of the rest; ties go to the smaller shrink.  Folds of one class have no AUC.
    """
    rows = kept(df.select(fold, y, *features))
    per = kept(sums(rows, [fold], features, y))
    whole = per.agg(*[F.sum(n).alias(n) for n in names(features)])
    outer = without(per.withColumnRenamed(fold, "outer"), whole, features)
    # what is left without two folds; folds by folds rows of sums
    inner = outer.alias("o").join(F.broadcast(per.withColumnRenamed(fold, "inner").alias("i")), F.col("outer") != F.col("inner")).select("outer", "inner", *[(F.col(f"o.{n}") - F.col(f"i.{n}")).alias(n) for n in names(features)])
    tried = rows.withColumn("inner", F.col(fold)).join(F.broadcast(inner), "inner").withColumn("shrink", F.explode(F.array(*map(F.lit, grid))))
    aucs = roc_auc(tried.select("outer", "inner", "shrink", y, F.round(score(features, F.col("shrink")), 9).alias("p")).where("p is not null"), "p", y, ["outer", "inner", "shrink"])
    means = aucs.groupBy("outer", "shrink").agg(F.round(F.avg("auc"), 12).alias("inner_auc"))
    chosen = means.groupBy("outer").agg(F.max_by(F.struct("shrink", "inner_auc"), F.struct("inner_auc", (-F.col("shrink")).alias("less"))).alias("x")).select("outer", "x.*")
    told = rows.withColumn("outer", F.col(fold)).join(F.broadcast(outer.join(chosen, "outer")), "outer")
    final = roc_auc(told.select("outer", y, F.round(score(features, F.col("shrink")), 9).alias("p")).where("p is not null"), "p", y, ["outer"])
    return chosen.join(final, "outer", "left").select("outer", "shrink", "inner_auc", "auc")


def leave_one_group_out(df: DataFrame, group: str, features: list[str], y: str, shrink: float = 0.0) -> DataFrame:
    """(group, n, auc): each group's AUC by a model of all other groups; null for groups of one class.

    A group's model meets its rows by group; a large group's rows are many in that join, where Spark splits them.
    """
    rows = kept(df.select(group, y, *features))
    per = sums(rows, [group], features, y)
    models = without(per, per.agg(*[F.sum(n).alias(n) for n in names(features)]), features)
    scored = rows.join(models, group).select(group, y, F.round(score(features, F.lit(shrink)), 9).alias("p"))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counts.join(roc_auc(scored.where("p is not null"), "p", y, [group]), group, "left").select(group, "n", "auc")


def ranks(df: DataFrame, draw: Column, name: str) -> DataFrame:
    """df with `name`: the place, from 1, of each row in the order of a draw, which is not shared by two rows of note."""
    drawn = df.withColumn("_u", draw)
    return running(drawn, "_u", ["_one"], []).withColumnRenamed("upto__one", name).drop("_u", "all__one")


def permuted(df: DataFrame, id_: str, column: str, seed: int) -> DataFrame:
    """(id, value): the column permuted over all rows: the row of a place in one order by hash gets the value at that place in another.

    Orders are ranks by counts over blocks of hashes, so no task and no partition sees the column whole.
    """
    rows = df.select(id_, F.col(column).alias("value"), F.lit(1).alias("_one"))
    places = [ranks(rows, uniform(F.lit(seed + k), F.col(id_)), "place") for k in (0, 1)]
    return places[0].select(id_, "place").join(places[1].select("place", "value"), "place").select(id_, "value")


def shuffled_target(df: DataFrame, held: Column, id_: str, features: list[str], y: str, rounds: int, seed: int, shrink: float = 0.0) -> DataFrame:
    """(round, auc): what a model that is fitted and judged on permuted labels reaches; about one half, unless rows tell of each other.

    held: whether a row is judged; the others are learnt from.  Labels are permuted over all rows.
    """
    rows = kept(df.select(id_, held.alias("_held"), y, *features))
    parts = []
    for r in range(rounds):
        moved = rows.drop(y).join(permuted(rows, id_, y, seed + 2 * r).withColumnRenamed("value", y), id_).withColumn("round", F.lit(r))
        parts.append(moved)
    every = kept(reduce(DataFrame.unionByName, parts))
    models = F.broadcast(sums(every.where("not _held"), ["round"], features, y))  # a row for each round
    scored = every.where("_held").join(models, "round").select("round", y, F.round(score(features, F.lit(shrink)), 9).alias("p"))
    return roc_auc(scored.where("p is not null"), "p", y, ["round"])


def permutation_importance(train: DataFrame, test: DataFrame, id_: str, features: list[str], y: str, rounds: int, seed: int, shrink: float = 0.0) -> DataFrame:
    """(feature, auc, permuted_auc, importance): what the AUC on test loses, on average, where a feature's column is permuted."""
    held = kept(test.select(id_, y, *features))
    model = F.broadcast(sums(train, [], features, y))
    auc = lambda rows, keys: roc_auc(rows.join(model, F.lit(True)).select(*keys, y, F.round(score(features, F.lit(shrink)), 9).alias("p")), "p", y, keys)
    base = auc(held, [])
    parts = []
    for k, f in enumerate(features):
        for r in range(rounds):
            moved = held.drop(f).join(permuted(held, id_, f, seed + 2 * (k * rounds + r)).withColumnRenamed("value", f), id_)
            parts.append(moved.select(F.lit(f).alias("feature"), F.lit(r).alias("round"), y, *features))
    return _importance(base, auc(reduce(DataFrame.unionByName, parts), ["feature", "round"]))


def _importance(base: DataFrame, aucs: DataFrame) -> DataFrame:
    told = aucs.groupBy("feature").agg(F.avg("auc").alias("permuted_auc")).join(F.broadcast(base), F.lit(True))
    return told.select("feature", "auc", "permuted_auc", (F.col("auc") - F.col("permuted_auc")).alias("importance"))


def conditional(train: DataFrame, test: DataFrame, id_: str, features: list[str], column: str, rounds: int, seed: int, trees: int = 30, depth: int = 5) -> DataFrame:
    """(id, round, value): the column as other features leave it: a forest of these, fitted on train, and the residual of some training row by a draw.

    Values are kept within the column's range in train.  A draw's residual is that of a place in train's order by hash, so training rows are ranked, not collected.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    others = [f for f in features if f != column]
    assembler = VectorAssembler(inputCols=others, outputCol="_x")
    forest = RandomForestRegressor(featuresCol="_x", labelCol=column, predictionCol="_e", numTrees=trees, maxDepth=depth, seed=42, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="all" if len(others) == 1 else "onethird").fit(assembler.transform(train.withColumn(column, F.col(column).cast("double"))))
    expect = lambda df: forest.transform(assembler.transform(df))
    left = expect(train).select(id_, (F.col(column) - F.col("_e")).alias("residual"), F.lit(1).alias("_one"))
    placed = kept(ranks(left, uniform(F.lit(seed), F.col(id_)), "place").select("place", "residual"))
    limits = train.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("rows"))
    asked = expect(test).select(id_, "_e").join(F.broadcast(limits), F.lit(True)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = asked.withColumn("place", (F.floor(uniform(F.lit(seed + 1), F.col("round"), F.col(id_)) * F.col("rows")) + 1).cast("bigint"))
    return drawn.join(placed, "place").select(id_, "round", F.greatest("low", F.least("high", F.col("_e") + F.col("residual"))).alias("value"))


def conditional_importance(train: DataFrame, test: DataFrame, id_: str, features: list[str], y: str, rounds: int, seed: int, shrink: float = 0.0) -> DataFrame:
    """(feature, auc, permuted_auc, importance) with columns that keep what other features tell of them.

    Both frames are computed once and written: forests read train many times for each feature.
    """
    train, held = kept(train.select(id_, y, *features)), kept(test.select(id_, y, *features))
    model = F.broadcast(sums(train, [], features, y))
    auc = lambda rows, keys: roc_auc(rows.join(model, F.lit(True)).select(*keys, y, F.round(score(features, F.lit(shrink)), 9).alias("p")), "p", y, keys)
    parts = []
    for k, f in enumerate(features):
        values = conditional(train, held, id_, features, f, rounds, seed + 10 * k)
        parts.append(held.drop(f).join(values.withColumnRenamed("value", f), id_).select(F.lit(f).alias("feature"), "round", y, *features))
    return _importance(auc(held, []), auc(reduce(DataFrame.unionByName, parts), ["feature", "round"]))
