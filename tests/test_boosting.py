"""Boosting against a plain grower, its tables, scores and attributions."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import boosting, learning, trees

FEATURES = ["a", "b", "c"]


def made(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 4 + 3 * x[:, 1], -1 + x[:, 2]) + rng.normal(size=n) * 0.3
    return x, np.round(y, 3)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").repartition(3)


def plain_quantile(r, alpha):
    return float(np.sort(r)[int(alpha * (len(r) - 1))])


def plain_tree(bins, r, alpha, leaves, least):
    """Best-first growth one leaf at a time: (feature, bin) by node in the order of splits, and each row's leaf."""
    up = r > 0
    size = lambda rows: (alpha * up[rows].sum() - (1 - alpha) * (~up[rows]).sum()) ** 2 / max(len(rows), 1)

    def best(rows):
        found = (1e-9, None)
        for f in range(bins.shape[1]):
            for b in range(int(bins[:, f].max())):
                go = bins[rows, f] <= b
                left, right = rows[go], rows[~go]
                if len(left) >= least and len(right) >= least:
                    gain = size(left) + size(right) - size(rows)
                    if gain > found[0]:
                        found = (gain, (f, b, left, right))
        return found

    nodes, splits, heap = {0: np.arange(len(r))}, {}, []
    g = best(nodes[0])
    if g[1]:
        heapq.heappush(heap, (-g[0], 0, g[1]))
    while heap and len(nodes) - len(splits) < leaves:
        _, node, (f, b, left, right) = heapq.heappop(heap)
        at = len(nodes)
        splits[node], nodes[at], nodes[at + 1] = (f, b, at, at + 1), left, right
        for child in (at, at + 1):
            g = best(nodes[child])
            if g[1]:
                heapq.heappush(heap, (-g[0], child, g[1]))
    return splits, {n: rows for n, rows in nodes.items() if n not in splits}


@pytest.mark.parametrize("alpha", [0.5, 0.05, 0.95])
def test_trees_are_those_of_a_plain_grower(spark, alpha):
    x, y = made()
    growth = boosting.Growth(rounds=3, leaves=7, rate=0.5, least=20, bins=16, linear=False, feature_share=1.0, bag=1.1)
    found = boosting.fit(frame(spark, x, y), FEATURES, "y", [boosting.Spec(0, alpha, F.lit(True))], growth).orderBy("tree").collect()
    assert len(found) == 3 and abs(found[0].start - plain_quantile(y, alpha)) < 1e-4
    quantiles = [i / 16 for i in range(1, 16)]
    cuts = [np.array(sorted(set(np.sort(x[:, j])[np.maximum(np.ceil(np.array(quantiles) * len(x)).astype(int) - 1, 0)]))) for j in range(3)]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    said = np.full(len(y), found[0].start)
    for t in found:
        splits, leaves = plain_tree(bins, y - said, alpha, 7, 20)
        assert {n: (f, c) for n, (f, c) in enumerate(zip(t.feature, t.cut, strict=True)) if f >= 0} == {n: (f, cuts[f][b]) for n, (f, b, _, _) in splits.items()}
        for n, rows in leaves.items():
            assert t.cover[n] == len(rows) and abs(t.value[n] - plain_quantile((y - said)[rows], alpha)) < 1e-4
            said[rows] += 0.5 * t.value[n]


def test_linear_leaves_go_on_beyond_the_data(spark):
    x, y = made(900, 1)
    y = 4 + 3 * x[:, 0]
    growth = boosting.Growth(rounds=1, leaves=2, rate=1.0, least=20, bins=64, feature_share=1.0, bag=1.1)
    found = boosting.fit(frame(spark, x, y), FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], growth)
    beyond = spark.createDataFrame([(10.0, 0.0, 0.0), (-10.0, 0.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r.p for r in trees.score_fold_mean(beyond, found, {None: "p"}).collect()]
    assert abs(got[0] - 34) < 0.01 and abs(got[1] + 26) < 0.01 and np.isfinite(got[2])


def test_early_stopping_keeps_the_best_round(spark):
    x, y = made(400, 2)
    noise = np.random.default_rng(3).normal(size=400)
    df = frame(spark, x, noise)
    growth = boosting.Growth(rounds=12, patience=2, leaves=4, least=10, rate=1.0, bins=16, linear=False)
    own = F.col("id") % 2 == 0
    found = boosting.fit(df, FEATURES, "y", [boosting.Spec(0, 0.5, own, ~own), boosting.Spec(1, 0.5, own)], growth).collect()
    stopped, free = (sum(len(r.feature) > 1 for r in found if r.fold == f) for f in (0, 1))
    assert stopped < 10 <= free
    # The model is cut at the round whose loss on the left-out rows is least.
    losses = []
    rows = [r for r in found if r.fold == 1]
    for k in range(stopped + 2):
        forest = trees.Forest.of(rows[:k] or [rows[0]])
        p = forest.predict(x)[:, 0] if k else np.full(400, rows[0].start)
        losses.append(np.abs(noise - p)[1::2].mean())
    assert int(np.argmin(losses)) == stopped


def test_two_hundred_rounds_have_a_constant_plan(spark, monkeypatch):
    x, y = made(200, 4)
    seen = []
    collect = boosting._Rows.sums

    def sums(self, live, task):
        seen.append(max(map(len, self.recent)))
        return collect(self, live, task)

    monkeypatch.setattr(boosting._Rows, "sums", sums)
    growth = boosting.Growth(rounds=40, leaves=2, least=5, rate=0.1, bins=8, linear=False)
    found = boosting.fit(frame(spark, x, y).coalesce(1), FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], growth)
    assert found.count() == 40 and max(seen) < boosting.STATE_TREES


def test_empty_and_constant_targets(spark):
    df = spark.createDataFrame([], "a double, b double, c double, y double")
    assert boosting.fit(df, FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], boosting.Growth(rounds=2)).count() == 1
    x, _ = made(100)
    one = boosting.fit(frame(spark, x, np.full(100, 2.5)).withColumn("y", F.when(F.col("id") > 5, F.col("y"))), FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], boosting.Growth(rounds=2))
    assert {r.p for r in trees.score_fold_mean(frame(spark, x, np.zeros(100)), one, {None: "p"}).collect()} == {2.5}


def stored(fold, alpha, tree, start=1.0):
    return ("m", 42, fold, alpha, tree, ["a", "b", "c"], 0.5, start, [0.0, 0.0, 0.0], [0, -1, 1, -1, -1], [0.0, 0.0, 1.0 + tree, 0.0, 0.0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [0.0, -1.0, 0.0, 2.0, float(fold + 3)], [10, 4, 6, 2, 4], [0.0] * 15)


def test_saved_models_score_as_before(spark, tmp_path):
    table = spark.createDataFrame([stored(f, a, t) for f in (0, 1) for a in (0.05, 0.5) for t in (0, 1)], trees.SCHEMA)
    path = str(tmp_path / "models")
    trees.save(table, path)
    trees.save(table.withColumn("model", F.lit("other")), path)
    x, y = made(50)
    df = frame(spark, x, y)
    again = trees.load(spark, path, "m")
    one, two = ([tuple(r) for r in trees.score_fold_mean(df, t, {0.05: "lo", 0.5: "mid"}).orderBy("id").collect()] for t in (table, again))
    assert one == two and len(one) == 50
    leaf = lambda r, f, t: -1.0 if r[0] <= 0 else 2.0 if r[1] <= 1 + t else f + 3.0
    for (i, *_, lo, _), r in zip(one, x, strict=True):
        assert abs(lo - np.mean([1 + 0.5 * (leaf(r, f, 0) + leaf(r, f, 1)) for f in (0, 1)])) < 1e-12
    with pytest.raises(LookupError):
        trees.load(spark, path, "m", seed=7)
    with pytest.raises(LookupError):
        trees.load(spark, path, "m", folds=[0, 5])
    with pytest.raises(LookupError):
        trees.score_fold_mean(df, again, {0.95: "hi"})


def test_large_forests_are_scored_in_passes(spark, monkeypatch):
    table = spark.createDataFrame([stored(f, None, t) for f in (0, 1, 2) for t in range(4)], trees.SCHEMA)
    x, y = made(40)
    df = frame(spark, x, y)
    ask = lambda: [(r.id, round(r.p, 9)) for r in trees.score_fold_mean(df, table, {None: "p"}).orderBy("id").collect()]
    whole = ask()
    monkeypatch.setattr(trees, "MOST_NODES", 12)
    assert ask() == whole


def enumerated(forest, tree, x):
    """Shapley values by all coalitions, with expectations that follow the training rows where a feature is unknown."""
    n = x.shape[1]

    def value(known, node):
        f = forest.feature[node]
        if f < 0:
            return forest.value[node]
        left, right = int(forest.left[node]), int(forest.right[node])
        if f in known:
            return value(known, left if row[f] <= forest.cut[node] else right)
        return sum(forest.cover[c] / forest.cover[node] * value(known, c) for c in (left, right))

    out = np.zeros(x.shape)
    root = int(forest.root[tree])
    for i, row in enumerate(x):
        for j in range(n):
            rest = [k for k in range(n) if k != j]
            for k in range(n):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                out[i, j] += w * sum(value({*s, j}, root) - value(set(s), root) for s in itertools.combinations(rest, k))
    return out


def test_attributions_are_those_of_all_coalitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 6))
    y = x[:, 0] * (x[:, 1] > 0) + np.abs(x[:, 2]) + 0.5 * x[:, 3] * x[:, 4]
    names = [f"f{j}" for j in range(6)]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double")
    growth = boosting.Growth(rounds=3, leaves=12, least=20, rate=0.5, bins=16, linear=False, bag=0.8)
    found = boosting.fit(df, names, "y", [boosting.Spec(f, 0.5, F.col("id") % 3 != f) for f in (0, 1)], growth)
    forest = trees.Forest.of(found.collect())
    few = x[:12]
    for t in range(len(forest.root)):
        assert np.allclose(trees.path_attribution(forest, t, few), enumerated(forest, t, few))
    phi, base = trees.attribute(forest, few)
    assert np.allclose(phi.sum(axis=2) + base[:, None], forest.predict(few).T)
    table = trees.attributions(df.where("id < 12"), found, ["id"]).orderBy("id").collect()
    assert np.allclose([[r[c] for c in names] for r in table], np.abs(phi).mean(axis=0))


def test_slopes_are_credited_to_their_features(spark):
    x, y = made(500, 6)
    found = boosting.fit(frame(spark, x, y), FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], boosting.Growth(rounds=3, leaves=5, least=30, rate=0.5, bins=16))
    forest = trees.Forest.of(found.collect())
    assert forest.coef is not None
    phi, base = trees.attribute(forest, x)
    assert np.allclose(phi.sum(axis=2) + base[:, None], forest.predict(x).T)


def test_repeated_rows_are_read_once_and_weigh_as_often(spark, monkeypatch):
    x, y = made(400, 8)
    times = np.random.default_rng(9).integers(1, 6, 400)
    x, y = np.repeat(x, times, axis=0), np.repeat(y, times)
    df = frame(spark, x, y)
    read, blocks = [], boosting._blocks

    def seen(counts, *rest):
        read.append(counts.count())
        return blocks(counts, *rest)

    monkeypatch.setattr(boosting, "_blocks", seen)
    growth = boosting.Growth(rounds=2, leaves=6, rate=0.5, least=40, bins=16, linear=False, feature_share=1.0, bag=1.1)
    found = boosting.fit(df, FEATURES, "y", [boosting.Spec(0, 0.5, F.lit(True))], growth).orderBy("tree").collect()
    assert read == [len({(*r, v) for r, v in zip(x.tolist(), y.tolist(), strict=True)})] and read[0] < len(y) / 2
    cuts = [np.array(sorted(set(np.sort(x[:, j])[np.ceil(np.arange(1, 16) / 16 * len(x)).astype(int) - 1]))) for j in range(3)]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    said = np.full(len(y), found[0].start)
    for t in found:
        splits, leaves = plain_tree(bins, y - said, 0.5, 6, 40)
        assert {n: (f, c) for n, (f, c) in enumerate(zip(t.feature, t.cut, strict=True)) if f >= 0} == {n: (f, cuts[f][b]) for n, (f, b, _, _) in splits.items()}
        for n, rows in leaves.items():
            assert t.cover[n] == len(rows) and abs(t.value[n] - plain_quantile((y - said)[rows], 0.5)) < 1e-4
            said[rows] += 0.5 * t.value[n]


def test_trees_grown_on_combinations_of_bins_are_those_of_passes(spark, monkeypatch):
    x, y = made(500, 10)
    df, own = frame(spark, x, y), (F.col("id") % 3 > 0, F.col("id") % 3 == 0)
    growth = boosting.Growth(rounds=3, leaves=6, least=20, rate=0.5, bins=16)
    ask = lambda: [(r.alpha, r.tree, r.feature, r.cut, r.cover) for r in boosting.fit(df, FEATURES, "y", [boosting.Spec(0, a, *own, a) for a in (0.1, 0.5)], growth).orderBy("alpha", "tree").collect()]
    passes, sums = [], boosting._Rows.sums
    monkeypatch.setattr(boosting._Rows, "sums", lambda self, live, task: passes.append(1) or sums(self, live, task))
    one = ask()
    few = len(passes)
    monkeypatch.setattr(boosting, "CELLS", 0)
    assert one == ask() and len(passes) - few > few


def test_keys_of_sums():
    parts = (np.array([0, 1023]), np.array([-1, 131070]), np.array([0, 16383]), np.array([0, 4194303]))
    assert all((a == b).all() for a, b in zip(parts, boosting._Sums.parts(boosting._Sums.key(*parts)), strict=True))
    with pytest.raises(ValueError):
        boosting._Sums.key(0, 0, 16384, 0)


def test_counts_by_model_and_rows_without_a_target(spark):
    rows = [(1.0, 2.0, 0)] * 3 + [(1.0, 2.0, 1), (float("nan"), 2.0, 1), (None, 2.0, 0), (1.0, None, 1), (1.0, float("nan"), 0)]
    df = spark.createDataFrame(rows, "a double, y double, fold int")
    fold = F.col("fold")
    counts = boosting.counted(df, ["a"], "y", [boosting.Spec(0, 0.5, fold != 0, fold == 0), boosting.Spec(1, 0.5, fold != 1), boosting.Spec(2, 0.5, fold >= 0, fold == 1)])
    assert {tuple(r[:3]): (r["_learn"], r["_held"]) for r in counts.collect()} == {(1.0, 2.0, 4): ([1, 3, 4], [3, 0, 0]), (None, 2.0, 2): ([1, 1, 2], [1, 0, 0]), (1.0, None, 2): ([1, 1, 2], [1, 0, 0])}
    many = spark.createDataFrame([(1.0, 200_000), (2.0, 65_536), (3.0, 1)], "a double, _rows long")
    assert {tuple(r) for r in boosting._each_row(many, ["a"]).groupBy("a").count().collect()} == {(1.0, 200_000), (2.0, 65_536), (3.0, 1)}


def test_weighted_metrics_are_those_of_repeated_rows(spark):
    rows = spark.createDataFrame([(i % 2, float(40 + i % 11), float(40 + i * 7 % 13), 1 + i % 4) for i in range(60)] + [(0, None, 41.0, 5)], "k int, y double, p double, w long")
    again = rows.select("k", "y", "p", F.explode(F.sequence(F.lit(1), F.col("w"))))
    asked = lambda df, w: df.groupBy("k").agg(learning.pinball("y", "p", 0.05, w).alias("a"), learning.coverage("y", "p", "p", w).alias("b")).join(learning.regression_metrics(df, ["k"], "y", "p", 45.0, w), "k").orderBy("k").collect()
    for one, two in zip(asked(rows, "w"), asked(again, None), strict=True):
        assert tuple(one) == pytest.approx(tuple(two), rel=1e-12)
