"""Models over flow features: boosted trees with calibration, isolation forest, clustering, group folds, importance
(N16, N23, N36, N37, N40, N41)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.sources.shared import shared_dir


def group_fold(group: str, folds: int, seed: int = 0) -> Column:
    """The fold of a group, so that no group is in two."""
    return F.floor(uniform(F.lit(seed), F.col(group)) * folds).cast("int")


def fit_risk(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, halves: int = 2):
    """Boosted trees on each half of the training rows; a logistic regression over their margins on the other half,
    which they haven't seen, turns these into probabilities, which are averaged."""
    made = []
    half = F.pmod(F.xxhash64(F.lit("half"), *[F.col(c) for c in train.columns]), F.lit(halves))
    for h in range(halves):
        trees = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=42)]).fit(train.where(half != h))
        platt = LogisticRegression(featuresCol="rawPrediction", labelCol=label, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_lr").fit(trees.transform(train.where(half == h)))
        made.append((trees, platt))
    return made


def predict_risk(model, rows: DataFrame) -> DataFrame:
    """Adds probability, within [0, 1]; where rows have one already it stays unless it is null."""
    given = rows.withColumnRenamed("probability", "_given")
    out = given
    for k, (trees, platt) in enumerate(model):
        out = platt.transform(trees.transform(out)).select(*given.columns, *[f"_p{j}" for j in range(k)], vector_to_array(F.col("_p"))[1].alias(f"_p{k}"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.col(f"_p{k}") for k in range(len(model))), F.lit(0.0)) / len(model)))
    if "_given" in given.columns:
        p = F.coalesce(F.col("_given"), p)
    return out.select(*[c for c in rows.columns if c != "probability"], p.alias("probability"))


def cross_predict(rows: DataFrame, features: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """Each fold's rows by a model of the other folds.  Rows are written once, as every round of every model reads them."""
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint()
    parts = [predict_risk(fit_risk(rows.where(F.col(fold) != f), features, label), rows.where(F.col(fold) == f)) for f in range(folds)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


class Tree:
    """One isolation tree over a sample, as arrays: feature, split, left child (the right one follows), size of a leaf."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator):
        self.rows: list[list[float]] = []
        deepest = int(np.ceil(np.log2(max(len(sample), 2))))
        waiting = [(self._add(), sample, 0)]
        while waiting:
            at, x, depth = waiting.pop()
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if depth >= deepest or not len(spread):
                self.rows[at] = [-1, 0, -1, len(x)]
                continue
            f = int(rng.choice(spread))
            split = rng.uniform(x[:, f].min(), x[:, f].max())
            left, right = self._add(), self._add()
            self.rows[at] = [f, split, left, len(x)]
            low = x[:, f] < split
            waiting += [(left, x[low], depth + 1), (right, x[~low], depth + 1)]

    def _add(self) -> int:
        self.rows.append([-1, 0, -1, 0])
        return len(self.rows) - 1

    def depth(self, x: np.ndarray) -> np.ndarray:
        table = np.array(self.rows)
        at, depth = np.zeros(len(x), int), np.zeros(len(x))
        while True:
            inner = table[at, 0] >= 0
            if not inner.any():
                return depth + usual(table[at, 3])
            f = table[at, 0].astype(int)
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= table[at, 1]
            at = np.where(inner, table[at, 2].astype(int) + right, at)
            depth += inner


def usual(n) -> np.ndarray:
    """Mean depth of a search that fails in a tree of n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, id_: str, features: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score) of an isolation forest; each tree's sample is the first `sample` rows by a hash, a fixed number."""
    order = [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256), F.col(id_)]
    pool = df.select(*features, id_).orderBy(*order).limit(sample * 8).toPandas()[features].to_numpy(float)
    rng = np.random.default_rng(seed)
    grown = [Tree(pool[rng.choice(len(pool), min(sample, len(pool)), replace=False)], rng) for _ in range(trees)] if len(pool) else []
    scale = float(usual(min(sample, len(pool))) or 1.0) if len(pool) else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            mean = np.mean([t.depth(x) for t in grown], axis=0) if grown else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-mean / scale))], [id_, "score"])

    return df.select(id_, *features).mapInArrow(run, f"{id_} {df.schema[id_].dataType.simpleString()}, score double")


def select_uncertain(df: DataFrame, id_: str, features: list[str], p: str, clusters: int = 15, most: int | None = None) -> DataFrame:
    """Of each k-means cluster the row of most uncertain probability; where that gives fewer than `most` rows, the
    most uncertain of all others fill up (cluster null)."""
    from tidemark.functions.numbers import entropy

    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    found = KMeans(k=clusters, seed=42, featuresCol="_x", predictionCol="cluster").fit(assembled).transform(assembled)
    told = found.select("cluster", id_, entropy(F.col(p)).alias("entropy"))
    best = told.groupBy("cluster").agg(F.max_by(F.struct(id_, "entropy"), F.struct("entropy", (-F.col(id_)).alias("back"))).alias("x")).select("cluster", "x.*")
    if most is None:
        return best
    # a fixed number of rows fills up
    others = told.join(F.broadcast(best.select(id_)), id_, "left_anti").orderBy(F.desc("entropy"), id_).limit(max(0, most - best.count()))
    return best.union(others.select(F.lit(None).cast("int").alias("cluster"), id_, "entropy"))


def delong(df: DataFrame, p: str, y: str) -> DataFrame:
    """Auc and its variance from structural components.

    Each row's component needs the rows of the other class that it beats, which running counts by distinct score give.
    """
    from tidemark.operators.statistics import running

    c = running(df.groupBy(p).agg(F.sum(y).cast("bigint").alias("pos"), (F.count("*") - F.sum(y)).cast("bigint").alias("neg")), p, ["pos", "neg"], [])
    v10 = (F.col("upto_neg") - F.col("neg") / 2.0) / F.col("all_neg")
    v01 = (F.col("all_pos") - F.col("upto_pos") + F.col("pos") / 2.0) / F.col("all_pos")
    m = c.select("pos", "neg", "all_pos", "all_neg", v10.alias("a"), v01.alias("b")).agg(
        F.first("all_pos").alias("m"), F.first("all_neg").alias("n"), F.sum(F.col("pos") * F.col("a")).alias("sa"), F.sum(F.col("pos") * F.col("a") ** 2).alias("qa"), F.sum(F.col("neg") * F.col("b")).alias("sb"), F.sum(F.col("neg") * F.col("b") ** 2).alias("qb"))
    var = lambda s, q, k: (F.col(q) - F.col(s) ** 2 / F.col(k)) / (F.col(k) - 1) / F.col(k)
    return m.select((F.col("sa") / F.col("m")).alias("auc"), (var("sa", "qa", "m") + var("sb", "qb", "n")).alias("variance"))


def permutation_p(df: DataFrame, id_: str, p: str, y: str, rounds: int = 200, blocks: int = 256, seed: int = 1) -> DataFrame:
    """(1 + how often a permutation of the labels has the mean difference or more) / (1 + rounds).

    In each round the rows of the smallest hashes, as many as there are positives, get the label 1.  Hashes are dealt into blocks,
    so only the rows of one block of a round meet in a task.
    """
    seen = df.agg(F.sum(y).alias("ones"), (F.avg(F.when(F.col(y) == 1, F.col(p))) - F.avg(F.when(F.col(y) == 0, F.col(p)))).alias("seen"))
    drawn = df.select(id_, p, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("u", uniform(F.lit(seed), F.col(id_), F.col("round"))).withColumn("block", F.floor(F.col("u") * blocks))
    counts = drawn.groupBy("round", "block").agg(F.count("*").alias("n"))
    before = counts.select("round", "block", F.coalesce(F.sum("n").over(Window.partitionBy("round").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("round", "block").orderBy("u", id_)) + F.col("before")
    one = F.col("place") <= F.col("ones")
    placed = drawn.join(before, ["round", "block"]).withColumn("place", place).join(F.broadcast(seen), F.lit(True))
    diff = placed.groupBy("round").agg((F.avg(F.when(one, F.col(p))) - F.avg(F.when(~one, F.col(p)))).alias("d"), F.first("seen").alias("seen"))
    return diff.agg(((1 + F.count_if(F.col("d") >= F.col("seen"))) / (1 + F.count("*"))).alias("p_value"))
