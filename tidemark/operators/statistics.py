"""Metrics of probabilities, rankings and agreement (N01-N21), as aggregations.

Global ranks come from counts of distinct values: tied values are one row, and running sums go over these rows in
ranges of values, so no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: str, sums: list[str], keys: list[str], blocks: int = 64) -> DataFrame:
    """Adds upto_<s>, the sum of s over rows of smaller or equal order, and all_<s>.

    Rows are put in blocks by approximate quantiles; sums within a block are added to those of the blocks before it.
    """
    edges = df.groupBy(*keys).agg(F.percentile_approx(order, F.array(*[F.lit(i / blocks) for i in range(1, blocks)])).alias("_edges"))
    on = edges.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    placed = df.join(F.broadcast(on) if not keys else on, cond).drop(*[f"_k{i}" for i in range(len(keys))]).withColumn("_block", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    total = placed.groupBy(*keys, "_block").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    over = Window.partitionBy(*keys).orderBy("_block")
    before = total.select(*keys, "_block", *[F.coalesce(F.sum(f"_b_{s}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_p_{s}") for s in sums], *[F.sum(f"_b_{s}").over(Window.partitionBy(*keys)).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    summed = placed.withColumns({f"_i_{s}": F.sum(s).over(inside) for s in sums}).alias("a")
    c = F.col("a._block") == F.col("b._block")
    for k in keys:
        c = c & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = summed.join(before.alias("b"), c)
    return joined.select(*[F.col(f"a.{x}").alias(x) for x in df.columns], *[(F.col(f"a._i_{s}") + F.col(f"b._p_{s}")).alias(f"upto_{s}") for s in sums], *[F.col(f"b.all_{s}").alias(f"all_{s}") for s in sums])


def by_score(df: DataFrame, p: str, y: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each score: positives, rows and what lies at or below it."""
    return running(df.groupBy(*keys, p).agg(F.sum(y).cast("bigint").alias("pos"), F.count("*").alias("n")), p, ["pos", "n"], keys)


def roc_auc(df: DataFrame, p: str, y: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The rank sum with ties; null where a class is missing."""
    r = by_score(df, p, y, keys).withColumn("rank", F.col("upto_n") - (F.col("n") - 1) / 2.0)
    ones, all_ = F.first("all_pos"), F.first("all_n")
    return r.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), ones.alias("p1"), all_.alias("nn")).select(*keys, F.when((F.col("p1") > 0) & (F.col("p1") < F.col("nn")), (F.col("s") - F.col("p1") * (F.col("p1") + 1) / 2.0) / (F.col("p1") * (F.col("nn") - F.col("p1")))).alias("auc"))


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    """Precision at each score, weighted by the recall that it adds."""
    r = by_score(df, p, y)
    above = lambda s: F.col(f"all_{s}") - F.col(f"upto_{s}") + F.col(s)
    return r.agg(F.sum(F.col("pos") / F.col("all_pos") * above("pos") / above("n")).alias("average_precision"))


def youden(df: DataFrame, p: str, y: str) -> DataFrame:
    """The score whose threshold (>=) has the largest TPR - FPR, the smallest of equals, kept in [.2, .9]."""
    r = by_score(df, p, y)
    tp, n = F.col("all_pos") - F.col("upto_pos") + F.col("pos"), F.col("all_n") - F.col("upto_n") + F.col("n")
    j = F.round(tp / F.col("all_pos") - (n - tp) / (F.col("all_n") - F.col("all_pos")), 12)
    return r.select(F.col(p).alias("p"), j.alias("j")).agg(F.max_by("p", F.struct("j", (-F.col("p")).alias("low"))).alias("t"), F.max("j").alias("j")).select(F.greatest(F.lit(0.2), F.least(F.lit(0.9), F.col("t"))).alias("threshold"), "j")


def bins(p: Column, k: int) -> Column:
    """Equal widths, (low, high], the first one closed."""
    return F.greatest(F.lit(1), F.least(F.lit(k), F.ceil(p * k)))


def calibration_bins(df: DataFrame, p: str, y: str, k: int) -> DataFrame:
    return df.groupBy(bins(F.col(p), k).alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence"))


def calibration_error(df: DataFrame, p: str, y: str, k: int) -> DataFrame:
    """N01."""
    b = calibration_bins(df, p, y, k)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, p: str, y: str, k: int) -> DataFrame:
    """Brier score, log loss, and reliability, resolution and uncertainty over equal bins."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    whole = df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"), F.avg(y).alias("base"), F.count("*").alias("total"))
    b = calibration_bins(df, p, y, k).join(F.broadcast(whole), F.lit(True))
    w = F.col("n") / F.col("total")
    return b.agg(F.first("brier").alias("brier"), F.first("log_loss").alias("log_loss"), F.sum(w * (F.col("confidence") - F.col("accuracy")) ** 2).alias("reliability"), F.sum(w * (F.col("accuracy") - F.col("base")) ** 2).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def class_calibration(df: DataFrame, label: str, p: str, y: str, k: int) -> DataFrame:
    """(label, n, ece, brier) of each class against the rest, and a last row for their means (label null): rows are (label, p, y), one for each
    item and class."""
    b = df.groupBy(label, bins(F.col(p), k).alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("a"), F.avg(p).alias("c"), F.sum((F.col(p) - F.col(y)) ** 2).alias("s"))
    per = b.groupBy(label).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), (F.sum("s") / F.sum("n")).alias("brier"))
    macro = per.agg(F.sum("n").alias("n"), F.avg("ece").alias("ece"), F.avg("brier").alias("brier")).where("n is not null")
    return per.unionByName(macro.select(F.lit(None).cast(per.schema[label].dataType).alias(label), "n", "ece", "brier"))


def group_bootstrap(df: DataFrame, group: str, p: str, y: str, rounds: int, seed: int) -> DataFrame:
    """Mean squared error under group resampling: a draw picks groups with replacement by hash, and only group sums
    are multiplied.  Groups are numbered by a window over the table of groups."""
    sums = df.groupBy(group).agg(F.sum((F.col(p) - F.col(y)) ** 2).alias("s"), F.count("*").alias("n"))
    numbered = sums.withColumn("g", F.row_number().over(Window.orderBy(group)) - 1)
    count = numbered.agg(F.count("*").alias("groups"))
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("round")).join(F.broadcast(count), F.lit(True)).select("round", "groups", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("groups"))).alias("draw"))
    code = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "round", "draw"), 256), 1, 8), 16, 10).cast("bigint")
    picked = draws.select("round", (code % F.col("groups")).cast("int").alias("g")).groupBy("round", "g").agg(F.count("*").alias("times"))
    return picked.join(numbered, "g").groupBy("round").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("value"))


def kappa(table: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's, from two columns of labels."""
    n = table.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = n.groupBy(a).agg(F.sum("n").alias("l")), n.groupBy(b).agg(F.sum("n").alias("r"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    chance = left.join(right, F.col(a) == F.col(b)).agg(F.sum(F.col("l") * F.col("r")).alias("chance"))
    e, o = F.col("chance") / F.col("total") / F.col("total"), F.col("same") / F.col("total")
    return total.crossJoin(F.broadcast(chance)).select(((o - e) / (1 - e)).alias("kappa"))


def fleiss(counts: DataFrame, item: str, category: str, n: str) -> DataFrame:
    """Fleiss', from (item, category, n) with equally many ratings of each item."""
    per = counts.groupBy(item).agg(F.sum(n).alias("r"), F.sum(F.col(n) * F.col(n)).alias("sq"))
    agree = per.agg(F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"), F.sum("r").alias("total"))
    share = counts.groupBy(category).agg(F.sum(n).alias("c")).crossJoin(F.broadcast(agree)).agg(F.sum((F.col("c") / F.col("total")) ** 2).alias("e"), F.first("p").alias("p"))
    return share.select(((F.col("p") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))


def ndcg(df: DataFrame, query: str, item: str, gain: str, score: str, k: int) -> DataFrame:
    """Of each query, over its k best by score, ties by item."""
    by = lambda c: Window.partitionBy(query).orderBy(F.desc(c), item)
    r = df.withColumns({"_s": F.row_number().over(by(score)), "_g": F.row_number().over(by(gain))})
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col(gain) / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    return r.groupBy(query).agg(F.coalesce(F.try_divide(part("_s"), part("_g")), F.lit(0.0)).alias("ndcg"))


def ecdf(df: DataFrame, id_: str, features: list[str]) -> DataFrame:
    """ECOD: for each feature the negative logarithms of both tails; the larger of left, right and skew-chosen sums."""
    long = df.select(id_, F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "x"))
    skew = long.groupBy("feature").agg(F.skewness("x").alias("skew"))
    counted = running(long.groupBy("feature", "x").agg(F.count("*").alias("n")), "x", ["n"], ["feature"])
    tails = counted.select("feature", "x", (-F.log(F.col("upto_n") / F.col("all_n"))).alias("left"), (-F.log((F.col("all_n") - F.col("upto_n") + F.col("n")) / F.col("all_n"))).alias("right")).join(F.broadcast(skew), "feature")
    scored = long.join(tails, ["feature", "x"])
    return scored.groupBy(id_).agg(F.greatest(F.sum("left"), F.sum("right"), F.sum(F.when(F.col("skew") < 0, F.col("left")).otherwise(F.col("right")))).alias("ecod"))


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """n of each stratum by hash; a stratum with fewer gives all it has."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_))).where(F.col("_r") <= n).drop("_r")


def filled(df: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """Exactly n of each stratum: a stratum with fewer rows gives each as often as it takes, in the order of the hash."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_n")).withColumnRenamed(stratum, "_s")
    chosen = stratified(df, stratum, id_, n, seed)
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    ranked = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_))).join(F.broadcast(size), F.col(stratum).eqNullSafe(F.col("_s")))
    times = F.expr(f"({n} - _r) div least(_n, {n})") + 1
    return ranked.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_r", "_n", "_s", "_t")


def balanced(df: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """N of each stratum; one with fewer rows is an error."""
    short = df.groupBy(stratum).count().where(F.col("count") < n).first()
    if short:
        raise ValueError(f"{stratum} {short[0]!r} has {short[1]} rows, not {n}")
    return stratified(df, stratum, id_, n, seed)


def design_effect(df: DataFrame, group: str, y: str) -> DataFrame:
    """Icc (from the mean squares between and within groups, not below 0), deff and n_eff; null with one group."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), (F.sum(F.col(y) * F.col(y)) - F.count("*") * F.avg(y) * F.avg(y)).alias("w"))
    between = F.try_divide(F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n"), F.count("*") - 1)
    t = g.agg(F.sum("n").alias("n"), F.avg("n").alias("size"), between.alias("b"), F.try_divide(F.sum("w"), F.sum("n") - F.count("*")).alias("w"))
    icc = F.greatest(F.lit(0.0), F.try_divide(F.col("b") - F.col("w"), F.col("b") + (F.col("size") - 1) * F.col("w")))
    return t.select(icc.alias("icc"), (1 + (F.col("size") - 1) * icc).alias("deff"), (F.col("n") / (1 + (F.col("size") - 1) * icc)).alias("n_eff"))


def gates(metrics: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(metric, value, broken) of each metric of the one row that is below its least or above its most."""
    told = []
    for name, (least, most) in bounds.items():
        broken = F.when(F.col(name) < least, "below") if least is not None else F.lit(None).cast("string")
        if most is not None:
            broken = F.coalesce(broken, F.when(F.col(name) > most, "above"))
        told.append(F.struct(F.lit(name).alias("metric"), F.round(F.col(name), 9).alias("value"), broken.alias("broken")))
    return metrics.select(F.explode(F.array(*told)).alias("x")).select("x.*").where("broken is not null")


def varying(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, varies)."""
    row = df.agg(*[(F.var_pop(f) > 1e-12).alias(f) for f in features])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "varies"))
