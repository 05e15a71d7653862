"""Tree learners against plain recursion over the same rows, bins and hashes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.plans import models, trees


def rows_of(n=400, seed=1, missing=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.choice([0.5, 1.5, 2.5]), rng.randint(0, 4)
        y = 10 * a - 7 * b + (30 if c > 2 else 0) + rng.randint(-5, 5)
        out.append((i, None if rng.random() < missing else float(a), float("nan") if rng.random() < missing else b, float(c), float(y)))
    return out


SCHEMA = "row_id long, a double, `b.x` double, c double, y double"
COLUMNS = ["a", "b.x", "c"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def keys_of(spark, rows):
    return {r["row_id"]: r["k"] for r in spark.createDataFrame(rows, SCHEMA).select("row_id", F.xxhash64("row_id").alias("k")).collect()}


def plain_tree(rows, times, grads, rule, depth, tree, rate, bounds, where=0):
    """A tree by recursion: (feature, threshold, missing_left, left, right) or a leaf's value."""
    n, g = sum(times), sum(t * v for t, v in zip(times, grads))

    def strength(g, n):
        g = math.copysign(max(abs(g) - rule.reg_alpha, 0), g)
        return g * g / (n + rule.reg_lambda) if n + rule.reg_lambda > 0 else 0.0

    leaf = rate * trees.weight(g, n, rule)
    if depth == 0 or n < rule.min_split:
        return leaf
    best = None
    for f in range(3):
        there = sorted({r[f] for r, t in zip(rows, times) if t and r[f] is not None})
        cuts = bounds[f]
        if rule.kind == "random":
            if not there:
                continue
            at = there[0] + float(trees.uniform(rule.seed, 2, tree, where, f)) * (there[-1] - there[0])
            cuts = [max([v for v in bounds[f] if v <= at], default=bounds[f][0])]
        for cut in cuts:
            for missing_left in (True, False):
                left = [missing_left if r[f] is None else r[f] <= cut for r in rows]
                ln, lg = sum(t for t, s in zip(times, left) if s), sum(t * v for t, v, s in zip(times, grads, left) if s)
                if ln < rule.least_weight or n - ln < rule.least_weight:
                    continue
                gain = 0.5 * (strength(lg, ln) + strength(g - lg, n - ln) - strength(g, n)) - rule.gamma
                if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                    best = (gain, f, cut, missing_left, left)
    if best is None or best[0] <= 0:
        return leaf
    _, f, cut, missing_left, left = best
    halves = []
    for side, turn in ((True, 1), (False, 2)):
        own = [i for i, s in enumerate(left) if s == side]
        step = int(trees.hashed(where, turn).view(np.int64))
        halves.append(plain_tree([rows[i] for i in own], [times[i] for i in own], [grads[i] for i in own], rule, depth - 1, tree, rate, bounds, step))
    return (f, cut, missing_left, *halves)


def as_plain(model, at):
    t = model.trees
    if t.feature[at] < 0:
        return t.value[at]
    return (t.feature[at], model.bounds[t.feature[at]][t.bin[at]], t.missing_left[at], as_plain(model, t.left[at]), as_plain(model, t.right[at]))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b, abs=1e-6)
    return a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4])


def run_down(tree, row):
    while isinstance(tree, tuple):
        f, cut, missing_left, left, right = tree
        tree = left if (missing_left if row[f] is None else row[f] <= cut) else right
    return tree


def tidy(rows):
    return [tuple(None if v is None or v != v else v for v in r[1:4]) for r in rows]


ROOT = 0


@pytest.mark.parametrize("subsample, refresh", [(1.0, 16), (0.6, 2)])
def test_boosting_equals_plain_recursion(spark, monkeypatch, subsample, refresh):
    monkeypatch.setattr(trees, "REFRESH", refresh)
    rows = rows_of(300)
    keys, xs = keys_of(spark, rows), tidy(rows)
    model = trees.boosted_trees(frame(spark, rows), COLUMNS, "y", rounds=4, max_depth=3, rate=0.3, subsample=subsample, seed=7)
    rule = trees.Rule("best", 10.0, 1.0, 0.0, 4.0, 2, 1.0, 7)
    margins = [0.5] * len(rows)
    key = np.array([keys[r[0]] for r in rows])
    root = int(trees.hashed(0, 0).view(np.int64))
    for t in range(4):
        times = [1] * len(rows) if subsample == 1 else (trees.uniform(7, 4, t, key) < subsample).astype(int).tolist()
        want = plain_tree(xs, times, [m - r[4] for m, r in zip(margins, rows)], rule, 3, t, 0.3, model.bounds, root)
        assert same(as_plain(model, model.trees.roots[t]), want), t
        margins = [m + run_down(want, x) for m, x in zip(margins, xs)]
    got = {r["row_id"]: r["prediction"] for r in model.transform(frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(margins, abs=1e-6)
    shares = model.importances()
    assert sum(shares) == pytest.approx(1) and shares[0] == max(shares)
    assert model.split_table(spark).count() == len(model.trees.feature)


@pytest.mark.parametrize("kind", ["random", "best"])
def test_forests_equal_plain_recursion_and_out_of_bag(spark, kind):
    rows = rows_of(250, 2)
    keys, xs = keys_of(spark, rows), tidy(rows)
    fit = trees.extra_trees if kind == "random" else trees.bagged_forest
    model = fit(frame(spark, rows), COLUMNS, "y", trees=5, max_depth=4, seed=3)
    key, mean = np.array([keys[r[0]] for r in rows]), sum(r[4] for r in rows) / len(rows)
    root, plain, times = int(trees.hashed(0, 0).view(np.int64)), [], []
    for t in range(5):
        times.append(trees.bag_counts(key, t, 3).tolist())
        plain.append(plain_tree(xs, times[-1], [mean - r[4] for r in rows], trees.Rule(kind, seed=3), 4, t, 1.0, model.bounds, root))
        assert same(as_plain(model, model.trees.roots[t]), plain[-1]), t
    got = {r["row_id"]: r for r in model.out_of_bag(frame(spark, rows), "y", "row_id").collect()}
    for i, (r, x) in enumerate(zip(rows, xs)):
        unseen = [run_down(plain[t], x) for t in range(5) if times[t][i] == 0]
        assert got[r[0]]["n_trees"] == len(unseen)
        assert got[r[0]]["estimate"] is None if not unseen else got[r[0]]["estimate"] == pytest.approx(mean + sum(unseen) / len(unseen), abs=1e-6)


@pytest.mark.parametrize("fit", [trees.extra_trees, trees.bagged_forest])
def test_the_same_trees_whatever_the_partitions(spark, monkeypatch, fit):
    rows = rows_of(200, 4)
    one = fit(frame(spark, rows, 1), COLUMNS, "y", trees=3, max_depth=5, features=0.7)
    monkeypatch.setattr(trees, "CELLS", 1000)  # a few nodes a pass
    other = fit(frame(spark, rows[::-1], 7), COLUMNS, "y", trees=3, max_depth=5, features=0.7)
    assert [as_plain(one, r) for r in one.trees.roots] == [as_plain(other, r) for r in other.trees.roots]


def test_bag_counts_are_poisson():
    counts = trees.bag_counts(np.arange(200_000), 3, 1)
    assert counts.mean() == pytest.approx(1, abs=0.02) and (counts == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)


def test_odd_tables(spark):
    """No rows: the base alone.  Rows without a target are left out; a feature without values splits nothing."""
    rows = rows_of(60, 5)
    empty = trees.boosted_trees(frame(spark, rows).limit(0), COLUMNS, "y", rounds=2, max_depth=2)
    assert {r["prediction"] for r in empty.transform(frame(spark, rows)).collect()} == {0.5}
    assert trees.bagged_forest(frame(spark, rows).limit(0), COLUMNS, "y", trees=2, max_depth=2).transform(frame(spark, rows)).count() == 60
    bare = frame(spark, [(i, None, 1.0, None, None if i % 2 else y) for i, *_, y in rows])
    model = trees.boosted_trees(bare, COLUMNS, "y", rounds=1, max_depth=3, subsample=1.0)
    assert model.trees.feature == [-1] and model.trees.rows == [30]


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), F.when(F.col("id") < 1700, 1.0).otherwise(5.0).alias("y"))
    model = trees.boosted_trees(df, ["x"], "y", rounds=1, max_depth=1, subsample=1.0, reg_lambda=0.0, reg_alpha=0.0, rate=1.0, bins=32)
    assert len(model.bounds[0]) == 32 and abs(model.bounds[0][model.trees.bin[0]] - 1700) < 5000 / 32 + 10


def test_cross_validation_takes_the_learners(spark):
    df = frame(spark, [r for r in rows_of(120, 6, missing=0.0)])
    found, scores = models.cross_validate(df, COLUMNS, "y", lambda t, f, y: models.MODELS["extra_trees"](t, f, y, trees=4, max_depth=4), folds=2)
    assert found.count() == 120 and min(r["r2"] for r in scores.collect()) > 0.3


def test_too_many_nodes_are_an_error(spark):
    with pytest.raises(ValueError):
        rows, bounds, stats = trees._prepared(frame(spark, rows_of(100)), COLUMNS, "y", "row_id", 16)
        trees.grow(rows, trees.Trees(), [0], bounds, trees.Rule(), 6, 1.0, lambda k, t: np.ones(len(k), int), lambda y, m, a, s, b: -y, 0, most_nodes=3)
