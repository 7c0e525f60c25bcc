"""Isotonic fits, kernel sums, paired comparisons and model studies against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, comparison


def pool(rows):
    """Pool adjacent violators, one score after another: {p: value}."""
    counts = {}
    for p, y in rows:
        n, pos = counts.get(p, (0, 0))
        counts[p] = (n + 1, pos + y)
    blocks = []
    for p in sorted(counts):
        blocks.append([*counts[p], [p]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, pos, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + pos, blocks[-1][2] + ps]
    return {p: pos / n for n, pos, ps in blocks for p in ps}


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_is_pool_adjacent_violators(spark, monkeypatch, seed):
    monkeypatch.setattr(calibration, "FAN", 2)
    rng = random.Random(seed)
    rows = [(round(rng.random() ** 2, [1, 2, 6][seed]), 0) for _ in range(400)]
    rows = [(p, int(rng.random() < (p if seed < 2 else 1 - p))) for p, _ in rows]
    df = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(rows)] + [(-1, None, 1), (-2, 0.5, None)], "id int, p double, y int").repartition(5)
    got = calibration.recalibrated(df, "p", "y").collect()
    want = pool(rows)
    assert all(abs(r.calibrated - want[r.p]) < 1e-12 for r in got if r.id >= 0) and len(got) == 402 and all(r.calibrated is None for r in got if r.id < 0)
    d = calibration.decomposition(df, "p", "y").first()
    fitted = np.mean([(want[p] - y) ** 2 for p, y in rows])
    base = np.mean([y for _, y in rows])
    assert abs(d.score - (d.mcb - d.dsc + d.unc)) < 1e-12 and abs(d.mcb - (np.mean([(p - y) ** 2 for p, y in rows]) - fitted)) < 1e-12 and abs(d.unc - base * (1 - base)) < 1e-12 and d.mcb >= -1e-12 and d.dsc >= -1e-12


def test_isotonic_of_nothing_and_of_one_class(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1)], "p double, y int")
    assert [tuple(r) for r in calibration.isotonic(df, "p", "y").collect()] == [(0, 2, 2)]
    assert calibration.isotonic(df.limit(0), "p", "y").count() == 0 and calibration.decomposition(df.limit(0), "p", "y").first().mcb is None


@pytest.mark.parametrize("h", [0.015, 0.05, 0.35])
def test_kernel_sums_are_those_of_all_pairs(spark, h):
    rng = np.random.default_rng(1)
    p, y = np.r_[rng.random(500), 0.0, 1.0, 1.0, 0.5], rng.integers(0, 2, 504)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y int").repartition(3)
    k = np.exp(-0.5 * ((p[:, None] - p) / h) ** 2)
    want = dict(zip(p.tolist(), ((k @ y) / k.sum(axis=1)).tolist()))
    got = {r.p: r.smooth for r in calibration.smoothed(df, "p", "y", h).collect()}
    assert set(got) == set(want) and max(abs(got[x] - want[x]) for x in want) < 1e-9


def test_tail_of_the_normal_law(spark):
    z = [0.0, 0.1, -1.0, 1.96, 3.0, -5.0, 7.5, 9.0, None]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(comparison.normal_tail(F.col("z"))).collect()
    assert all((g[0] is None) if x is None else abs(g[0] - math.erfc(abs(x) / math.sqrt(2))) < 1e-10 for x, g in zip(z, got))


def test_paired_delong_with_ties_and_nulls(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 1), round(rng.random(), 2), rng.randrange(2)) for _ in range(120)]
    df = spark.createDataFrame([*rows, (None, 0.1, 1), (0.3, None, 0), (0.1, 0.1, None)], "a double, b double, y int")
    beats = lambda u, v: (u > v) + 0.5 * (u == v)
    one, zero = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    v1 = np.array([[np.mean([beats(r[k], s[k]) for s in zero]) for k in (0, 1)] for r in one])
    v0 = np.array([[np.mean([beats(r[k], s[k]) for r in one]) for k in (0, 1)] for s in zero])
    cov = np.cov(v1.T) / len(one) + np.cov(v0.T) / len(zero)
    got = comparison.paired_delong(df, "a", "b", "y").first()
    assert np.allclose([got.auc_a, got.auc_b, got.var_a, got.var_b, got.cov], [*v1.mean(axis=0), cov[0, 0], cov[1, 1], cov[0, 1]], atol=1e-12)
    z = (got.auc_a - got.auc_b) / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert abs(got.z - z) < 1e-9 and abs(got.p_value - math.erfc(abs(z) / math.sqrt(2))) < 1e-9
    same = comparison.paired_delong(df, "a", "a", "y").first()
    assert same.z is None and abs(same.cov - same.var_a) < 1e-12
    assert comparison.paired_delong(df.where("y = 1"), "a", "b", "y").first().cov is None


def brute_nearest(x, y, own):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    if own:
        np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


def test_nearest_neighbours_and_what_pruning_saves(spark):
    from tidemark.operators import neighbours

    rng = np.random.default_rng(7)
    train, test = rng.random((4000, 2)) * [1, 3] + 1e6, rng.random((600, 2)) * [1.2, 3] + 1e6
    train[:40] = train[40:80]  # some twice
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(4)
    a, b = frame(train), frame(test)
    got = {tuple(r.x): r for r in neighbours.nearest(b, a).collect()}
    want = brute_nearest(test, train, False)
    assert len(got) == 600 and all(abs(got[tuple(v)].distance - w) < 1e-9 for v, w in zip(test.tolist(), want))
    assert sum(r.compared for r in got.values()) < 0.1 * 4000 * 600
    own = {tuple(r.x): r.distance for r in neighbours.apart(a).collect()}
    want = brute_nearest(train, train, True)
    assert all(abs(own[tuple(v)] - w) < 1e-9 for v, w in zip(train.tolist(), want))
    e = neighbours.extrapolation(a, b).first()
    limit = np.quantile(want, 0.95)
    beyond = int((brute_nearest(test, train, False) > limit).sum())
    assert abs(e.limit - limit) < 1e-9 and e.beyond == beyond and e.n == 600 and abs(e.z - (beyond - 30) / math.sqrt(600 * 0.05 * 0.95)) < 1e-9


def test_neighbours_of_few_equal_and_no_points(spark):
    from tidemark.operators import neighbours

    frame = lambda x: spark.createDataFrame([(v,) for v in x], "x array<double>")
    assert [r.distance for r in neighbours.nearest(frame([[1.0, 2.0]]), frame([])).collect()] == [None]
    assert [r.distance for r in neighbours.nearest(frame([[1.0, 2.0], None]), frame([[1.0, 2.0]] * 3)).collect()] == [0.0]
    assert [r.distance for r in neighbours.apart(frame([[1.0, 2.0]])).collect()] == [None] and [r.distance for r in neighbours.apart(frame([[1.0, 2.0]] * 2)).collect()] == [0.0]
    e = neighbours.extrapolation(frame([[1.0]]), frame([[5.0]])).first()
    assert e.limit is None and e.z is None and e.beyond is None
    e = neighbours.extrapolation(frame([[1.0], [2.0]]), frame([])).first()
    assert e.n == 0 and e.z is None


def test_groups_are_dealt_evenly_and_into_one_fold_each(spark):
    from tidemark.operators import folds

    rng, rows = random.Random(3), []
    for g in range(300):
        n = rng.choice([1, 1, 1, 2, 5, 20]) if g else 400  # one group holds a part of all rows
        rows += [(f"g{g}" if g != 7 else None, int(rng.random() < rng.choice([0.1, 0.9]))) for _ in range(n)]
    rows += [("no label", None)] * 3
    df = spark.createDataFrame(rows, "g string, y int").repartition(4)
    got = folds.stratified_groups(df, "g", "y", 4).collect()
    fold = {r.g: r.fold for r in got}
    assert len(got) == len(fold) == len({g for g, _ in rows}) and set(fold.values()) == set(range(4))
    sizes, ones = [0] * 4, [0] * 4
    for g, y in rows:
        sizes[fold[g]] += 1
        ones[fold[g]] += y == 1
    rest = sorted(sizes)[:3]  # the fold of the large group is as large as that group at least
    assert max(rest) - min(rest) <= 40 and max(ones) <= max(400, 0.4 * sum(ones))
    assert folds.stratified_groups(df.limit(0), "g", "y", 4).count() == 0


def test_a_column_is_permuted_over_all_rows(spark):
    from tidemark.functions.hashing import uniform
    from tidemark.operators import folds

    df = spark.range(500).selectExpr("id", "id * 7 as x").repartition(5)
    got = {r.id: r.value for r in folds.permuted(df, "id", "x", 3).collect()}
    assert sorted(got.values()) == [7 * k for k in range(500)] and sum(v == 7 * k for k, v in got.items()) < 20
    order = lambda s: [r.id for r in df.orderBy(uniform(F.lit(s), F.col("id"))).collect()]
    assert all(got[a] == 7 * b for a, b in zip(order(3), order(4)))


def test_conditional_columns_follow_the_others(spark):
    from tidemark.operators import folds

    rng = np.random.default_rng(2)
    a, noise = rng.random(600), rng.normal(0, 0.02, 600)
    df = spark.createDataFrame([(i, float(x), float(2 * x + e), float(z)) for i, (x, e, z) in enumerate(zip(a, noise, rng.random(600)))], "id int, a double, b double, z double")
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    rows = folds.conditional(train, test, "id", ["a", "b", "z"], "b", 2, 5).join(test, "id").collect()
    assert len(rows) == 400 and {r.round for r in rows} == {0, 1}
    told, true, x = (np.array([getattr(r, n) for r in rows]) for n in ("value", "b", "a"))
    assert np.corrcoef(told, x)[0, 1] > 0.9 and not np.allclose(told, true)
    low, high = train.agg(F.min("b"), F.max("b")).first()
    assert told.min() >= low and told.max() <= high


def test_models_without_a_group_are_those_of_the_rest(spark):
    from tidemark.operators import folds

    rng = random.Random(9)
    rows = [(rng.choice("abcd"), rng.randrange(2), rng.random(), rng.random()) for _ in range(200)] + [("e", 1, 0.5, 0.5)]
    df = spark.createDataFrame([(g, y, u + y * 0.3, v) for g, y, u, v in rows], "g string, y int, u double, v double")
    got = {r.g: r.auc for r in folds.leave_one_group_out(df, "g", ["u", "v"], "y", 0.2).collect()}
    x = df.toPandas()
    for g in "abcd":
        train, test = x[x.g != g], x[x.g == g]
        odds = np.log((train.y == 1).sum() / (train.y == 0).sum()) + np.zeros(len(test))
        for f in ("u", "v"):
            for k, sign in ((0, 1), (1, -1)):
                mine = train[train.y == k][f]
                var = 0.8 * mine.var(ddof=0) + 0.2 * train[f].var(ddof=0)
                odds = odds + sign * ((test[f] - mine.mean()) ** 2 / (2 * var) + np.log(var) / 2)
        one, zero = odds[test.y == 1].to_numpy(), odds[test.y == 0].to_numpy()
        assert abs(got[g] - ((one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean())) < 1e-6
    assert got["e"] is None


def test_conditional_importance_computes_its_rows_once(spark):
    from tidemark.operators import folds

    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for r in rows:
            seen.add(1)
            k = r[0]
            yield k, k % 2, float(k * 7 % 31), float(k * 3 % 17 + k % 2)

    df = spark.createDataFrame(spark.range(200).rdd.map(tuple).mapPartitions(told), "id bigint, y int, a double, b double")
    rows = folds.conditional_importance(df.where("id >= 60"), df.where("id < 60"), "id", ["a", "b"], "y", 2, 5, 0.1).collect()
    assert {r.feature for r in rows} == {"a", "b"}
    assert seen.value == 2 * 200  # once for train and once for test
