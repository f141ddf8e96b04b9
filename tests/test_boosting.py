"""Boosting, explanations and linear models against brute force, and training that stops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.ml import boosting, models, prep, trees
from sparkrisk.ml.boosting import Bins, Booster, Params, Tree, best_split, grow

G = np.random.default_rng(4)
LOOSE = Params(least_rows=1, l1=0.0, l2=0.0, category_smooth=0.0, rate=1.0)


def sums(n):
    c = G.integers(0, 40, n).astype(float)
    return np.where(c > 0, G.normal(size=n) * c, 0.0), c * 0.2, c


def worth(g, h, p):
    t = math.copysign(max(abs(g) - p.l1, 0.0), g)
    return t * t / (h + p.l2) if h + p.l2 > 0 else 0.0


def gain_of(left, g, h, p):
    a, b, c = g[left].sum(), h[left].sum(), g.sum()
    return worth(a, b, p) + worth(c - a, h.sum() - b, p) - worth(c, h.sum(), p)


@pytest.mark.parametrize("p", [LOOSE, Params(least_rows=20), Params(least_rows=1, l1=3.0, l2=5.0)])
def test_number_split_is_the_best_of_all_cuts_and_both_ways(p):
    for _ in range(60):
        g, h, n = sums(12)
        want = None
        for cut in range(1, 11):
            for missing in (False, True):
                left = np.zeros(12, bool)
                left[1:cut + 1] = True
                left[0] = missing
                if min(n[left].sum(), n[~left].sum()) >= p.least_rows and min(h[left].sum(), h[~left].sum()) >= 1e-3:
                    want = max(want or 0, gain_of(left, g, h, p))
        got = best_split(g, h, n, False, p)
        assert (got["gain"] if got else 0) == pytest.approx(want or 0, abs=1e-9)
        if got:
            assert gain_of(got["left_bins"], g, h, p) == pytest.approx(got["gain"])


def test_category_split_is_the_best_of_all_subsets():
    for _ in range(40):
        g, h, n = sums(8)
        seen = np.flatnonzero(n > 0)
        want = max((gain_of(np.isin(np.arange(8), c), g, h, LOOSE) for k in range(1, len(seen)) for c in itertools.combinations(seen, k)), default=0)
        got = best_split(g, h, n, True, LOOSE)
        assert (got["gain"] if got else 0) == pytest.approx(want, abs=1e-9)


def test_missing_values_nobody_saw_go_with_the_larger_side():
    g, h, n = np.array([0, -5, 8, 1.0]), np.array([0, 3, 1, 1.0]), np.array([0, 30, 5, 5.0])
    assert best_split(g, h, n, False, LOOSE)["left_bins"][0]
    assert not best_split(g[[0, 2, 3, 1]], h[[0, 2, 3, 1]], n[[0, 2, 3, 1]], False, LOOSE)["left_bins"][0]


def data(rows=600, features=3, size=9):
    b = G.integers(0, size, (rows, features)).astype(np.uint16)
    y = ((b[:, 0] > 4) ^ (b[:, 1] % 3 == 1) ^ (G.random(rows) < 0.1)).astype(float)
    return b, y


def in_memory(b, y, p, asked_log=None):
    q = np.full(len(y), y.mean())
    g, h = q - y, q * (1 - q)

    def candidates(tree, asked):
        if asked_log is not None:
            asked_log.append(list(asked))
        at, out = tree.nodes(b), {}
        for node in asked:
            mine = at == node
            for f in range(b.shape[1]):
                s = [np.bincount(b[mine, f], w[mine], minlength=9) for w in (g, h, np.ones(len(y)))]
                best = best_split(*s, f == 1, p)
                if best and (node not in out or best["gain"] > out[node]["gain"]):
                    out[node] = {**best, "feature": f}
        return out
    return candidates


@pytest.mark.parametrize("leaves", [2, 5, 13, 31])
def test_leaves_are_split_in_order_of_gain(leaves):
    p = Params(leaves=leaves, least_rows=8)
    for _ in range(5):
        b, y = data()
        candidates = in_memory(b, y, p)
        tree, open_ = Tree(), {0: candidates(Tree(), [0]).get(0)}
        while len(open_) < leaves and any(open_.values()):
            node = max((k for k in open_ if open_[k]), key=lambda k: open_[k]["gain"])
            new = tree.split(node, open_.pop(node))
            found = candidates(tree, list(new))
            open_ |= {k: found.get(k) for k in new}
        log = []
        got = grow(in_memory(b, y, p, log), p)
        assert (got.feature, got.left, got.value) == (tree.feature, tree.left, tree.value)
        assert len(log) <= max(3, leaves - 1)


# ---- training --------------------------------------------------------------------------------

def table(spark, n=1500):
    scattered = {"b", "e", "h", "k"}
    rows = []
    for i in range(n):
        c, x = "abcdefghijkl"[int(G.integers(12))], float(G.normal())
        y = int((c in scattered) if i % 2 else (x > 0.3))
        rows.append((i, None if i % 2 else x, c if i % 2 else None, y, "train" if i % 5 else "val"))
    return spark.createDataFrame(rows, "id long, x double, c string, label int, split string").repartition(4)


def test_scattered_categories_and_missing_values_are_separated(spark):
    df = table(spark)
    made = models.train_boosted_trees(df.where("split = 'train'"), df.where("split = 'val'"), "id", ["x"], ["c"], rounds=8, leaves=4, rate=0.5,
                                      least_rows=5, row_share=1.0, feature_share=1.0, patience=3)
    scored = made.score(df, ["id", "label"]).toPandas()
    assert scored.loc[scored.label == 1, "score"].min() > scored.loc[scored.label == 0, "score"].max() - 0.2
    nodes = made.node_table(spark).collect()
    assert any(set(r.categories or []) in ({"b", "e", "h", "k"}, set("acdfgijl")) for r in nodes)
    assert made.importance(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    odd = spark.createDataFrame([(1, None, None), (2, float("nan"), "new"), (3, 9.0, "b")], "id long, x double, c string")
    assert all(0 < r.score < 1 for r in made.score(odd, ["id"]).collect())
    assert made.score(odd.limit(0), ["id"]).count() == 0


def test_training_stops(spark):
    """Labels of pure noise: no later round is trained once the best is three rounds behind."""
    rows = [(i, float(G.normal()), int(G.random() < 0.3), "train" if i % 3 else "val") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, label int, split string")
    falling = lambda staged: staged.groupBy("stage").agg((-F.abs(F.col("stage") - 2)).cast("double").alias("value"))
    made = models.train_boosted_trees(df.where("split = 'train'"), df.where("split = 'val'"), "id", ["x"], rounds=60, leaves=3, least_rows=5, patience=3, metric=falling)
    assert made.trained == 6 and len(made.trees) == 2
    assert [r.stage for r in made.history.where("chosen").collect()] == [2]


def test_margins_kept_between_steps_change_nothing(spark, monkeypatch):
    df = table(spark, 700)
    parts = df.where("split = 'train'"), df.where("split = 'val'")
    scores = []
    for step in (2, 50):
        monkeypatch.setattr(boosting, "ROUNDS_A_STEP", step)
        made = models.train_boosted_trees(*parts, "id", ["x"], ["c"], rounds=6, leaves=4, least_rows=5)
        scores.append({r.id: r.score for r in made.score(df, ["id"]).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


# ---- explanations ----------------------------------------------------------------------------

def random_tree(depth, features, size=6):
    t = Tree(cover=[1000.0])

    def down(node, d):
        if d == 0 or t.cover[node] < 2:
            t.value[node] = float(G.normal())
            return
        share = G.uniform(0.1, 0.9)
        marks = G.random(size) < 0.5
        t.split(node, {"feature": int(G.integers(features)), "left_bins": marks, "gain": 1.0, "left_value": 0.0, "right_value": 0.0,
                       "left_rows": t.cover[node] * share, "right_rows": t.cover[node] * (1 - share)})
        left, right = t.left[node], t.right[node]
        down(left, d - 1)
        down(right, d - 1)
    down(0, depth)
    return t


def value_of(t, row, known, node=0):
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    if f in known:
        return value_of(t, row, known, t.left[node] if t.left_bins[node][row[f]] else t.right[node])
    return sum(t.cover[k] / t.cover[node] * value_of(t, row, known, k) for k in (t.left[node], t.right[node]))


@pytest.mark.parametrize("depth,features", [(1, 1), (3, 2), (4, 5)])
def test_contributions_equal_the_sum_over_all_coalitions(depth, features):
    t = random_tree(depth, features)
    rows = G.integers(0, 6, (20, features)).astype(np.uint16)
    phi = np.zeros((20, features))
    trees.tree_shap(t, rows, phi)
    for i, row in enumerate(rows):
        for f in range(features):
            others = [k for k in range(features) if k != f]
            want = sum(math.factorial(len(s)) * math.factorial(features - 1 - len(s)) / math.factorial(features)
                       * (value_of(t, row, {*s, f}) - value_of(t, row, set(s))) for k in range(features) for s in itertools.combinations(others, k))
            assert phi[i, f] == pytest.approx(want, abs=1e-9)
    assert trees.expected_value(t) == pytest.approx(value_of(t, rows[0], set()))


def test_deep_trees_are_explained():
    t = Tree(cover=[2.0 ** 21])
    node = 0
    for d in range(20):  # a chain: every feature once
        share = 0.5
        t.split(node, {"feature": d, "left_bins": np.arange(6) < 3, "gain": 1.0, "left_value": 0.0, "right_value": float(d + 1),
                       "left_rows": t.cover[node] * share, "right_rows": t.cover[node] * share})
        node = t.left[node]
    t.value[node] = -4.0
    rows = G.integers(0, 6, (300, 20)).astype(np.uint16)
    rows[0] = 0
    phi = np.zeros((300, 20))
    trees.tree_shap(t, rows, phi)
    assert np.allclose(phi.sum(1) + trees.expected_value(t), t.margins(rows), atol=1e-9)


def test_only_the_largest_contributions_leave(spark):
    bins = Bins(("a", "b", "c"), (), {"a": [0.0, 1.0], "b": [0.0], "c": []}, {})
    t = Tree(cover=[10.0])
    t.split(0, {"feature": 1, "left_bins": np.array([False, True, False]), "gain": 2.0, "left_value": 1.0, "right_value": -1.0, "left_rows": 4.0, "right_rows": 6.0})
    df = spark.createDataFrame([(1, 0.5, -1.0, None), (2, None, None, 1.0)], "id long, a double, b double, c double")
    got = trees.shap_contributions(df, Booster(bins, [t], 0.25), ["id"], top=2).orderBy("id").collect()
    assert [[(c.feature, round(c.contribution, 9)) for c in r.contributions] for r in got] == [[("b", 1.2), ("a", 0.0)], [("b", -0.8), ("a", 0.0)]]
    assert [r.margin for r in got] == [1.25, -0.75] and all(abs(r.base_value - 0.05) < 1e-12 for r in got)


# ---- linear models ---------------------------------------------------------------------------

def test_logistic_equals_newton(spark):
    x = G.normal(size=(400, 3))
    y = (G.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] - 0.7)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int")
    ready = prep.linear_prep(df, ["a", "b", "c"], []).transform(df)
    fitted = models.train_logistic(ready, "id", reg=0.0, max_iter=200, tol=1e-12)
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(4)
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]), z.T @ (y - q))
    base = fitted.stages[0]
    assert np.allclose([base.intercept, *base.coefficients], w, atol=1e-4)
    # calibration: a sigmoid of margins that the folds' models gave to rows they hadn't seen
    fold = np.array([r.f for r in df.orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(3)).alias("f")).collect()])
    margin = np.zeros(400)
    for k in range(3):
        v = np.zeros(4)
        for _ in range(30):
            q = 1 / (1 + np.exp(-z[fold != k] @ v))
            v += np.linalg.solve(z[fold != k].T @ (z[fold != k] * (q * (1 - q))[:, None]), z[fold != k].T @ (y[fold != k] - q))
        margin[fold == k] = z[fold == k] @ v
    a, m = np.zeros(2), np.column_stack([np.ones(400), margin])
    for _ in range(30):
        q = 1 / (1 + np.exp(-m @ a))
        a += np.linalg.solve(m.T @ (m * (q * (1 - q))[:, None]), m.T @ (y - q))
    want = 1 / (1 + np.exp(-(a[0] + a[1] * (z @ w))))
    got = {r.id: r.score for r in models.score_rows(fitted, ready).select("id", "score").collect()}
    assert np.allclose([got[i] for i in range(400)], want, atol=2e-3)
