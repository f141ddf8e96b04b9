import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkrisk.functions.expressions import DecisionPolicy, decide
from sparkrisk.functions.ordering import asc, exact_quantiles, global_rank, keys_at_ranks
from sparkrisk.operators import compare, policy, ranking


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores))], "id long, label int, score double")


def test_confusion(spark):
    r = ranking.threshold_metrics(scored(spark, [1, 1, 1, 0, 0, 0], [.9, .8, .1, .7, .2, .3]), [0.5]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2)


def test_perfect_ranking_and_single_class(spark):
    r = ranking.ranking_metrics(scored(spark, [0, 0, 0, 1, 1], [.1, .2, .3, .8, .9])).first()
    assert r["average_precision"] == 1 and r["roc_auc"] == 1
    with pytest.raises(Exception, match="both classes"):
        ranking.ranking_metrics(scored(spark, [0, 0], [.1, .2])).collect()
    assert ranking.ranking_metrics(scored(spark, [0, 0], [.1, .2]), strict=False).first()["roc_auc"] is None


def brute(labels, scores):
    pairs = [(p > n) + 0.5 * (p == n) for (y1, p), (y2, n) in itertools.product(zip(labels, scores), repeat=2) if y1 == 1 and y2 == 0]
    auc = sum(pairs) / len(pairs)
    ap, last = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        flagged = [y for y, s in zip(labels, scores) if s >= t]
        recall = sum(flagged) / sum(labels)
        ap += (recall - last) * sum(flagged) / len(flagged)
        last = recall
    return ap, auc


@pytest.mark.parametrize("levels", [3, 1000])
def test_metrics_equal_brute_force(spark, levels):
    rnd = random.Random(levels)
    labels = [int(rnd.random() < 0.3) for _ in range(200)]
    scores = [rnd.randrange(levels) / levels for _ in range(200)]
    r = ranking.ranking_metrics(scored(spark, labels, scores)).first()
    ap, auc = brute(labels, scores)
    assert r["average_precision"] == pytest.approx(ap) and r["roc_auc"] == pytest.approx(auc)


def test_top_fraction(spark):
    df = scored(spark, [0] * 10, range(1, 11))
    assert ranking.score_at_top_fraction(df, "score", "id", 0.2).first()[0] == 9
    tied = scored(spark, [0] * 10, [1] * 10)
    assert sorted(r["id"] for r in ranking.top_fraction(tied, "score", "id", 0.25).collect()) == [7, 8, 9]
    assert ranking.top_fraction(tied, "score", "id", 0.25, direct_rows=0).count() == 3
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            ranking.top_fraction(df, "score", "id", bad)


def test_heavy_ties_use_every_partition_and_stay_exact(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") < 900, 0.5).otherwise(F.col("id") / 2000.0).alias("score"))
    want = sorted([(r["score"], r["id"]) for r in df.collect()], reverse=True)
    for direct in (10_000, 0):
        got = ranking.top_fraction(df, "score", "id", 0.6, direct_rows=direct).collect()
        assert sorted([(r["score"], r["id"]) for r in got], reverse=True) == want[:1200]
    ranked = global_rank(df, [asc("score"), asc("id")], keep=["id"])
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [i for _, i in sorted(want)]


def test_keys_at_ranks_edges(spark):
    df = spark.range(10).select("id", F.lit(1.0).alias("v"))
    n, keys = keys_at_ranks(df, [asc("v"), asc("id")], lambda n: [0, 1, n, n + 1])
    assert n == 10 and keys[0] is None and keys[3] is None and keys[1]["id"] == 0 and keys[2]["id"] == 9
    assert keys_at_ranks(df.where("id < 0"), [asc("id")], lambda n: [1])[1] == [None]


def test_quantiles_equal_numpy(spark):
    import numpy as np
    values = np.random.default_rng(1).gamma(2, 50, 501).round(1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", [0, .1, .33, .5, 1]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p))


def test_policy_boundaries(spark):
    df = scored(spark, [0] * 5, [0.1, 0.2, 0.3, 0.6, 0.9])
    got = [r["d"] for r in df.select(decide(F.col("score"), 0.2, 0.6).alias("d"), "id").orderBy("id").collect()]
    assert got == ["APPROVE", "REVIEW", "REVIEW", "BLOCK", "BLOCK"]
    equal = [r["d"] for r in df.select(decide(F.col("score"), 0.3, 0.3).alias("d"), "id").orderBy("id").collect()]
    assert equal == ["APPROVE", "APPROVE", "BLOCK", "BLOCK", "BLOCK"]
    with pytest.raises(Exception):
        df.select(decide(F.lit(float("nan")), 0.2, 0.6)).collect()
    for a, b in ((0.5, 0.4), (-0.1, 0.5), (0.1, 1.1), (float("nan"), 0.5), ("x", 0.5)):
        with pytest.raises(ValueError):
            DecisionPolicy(a, b)
    assert DecisionPolicy.from_dict(DecisionPolicy(0.2, 0.6, "p").to_dict()) == DecisionPolicy(0.2, 0.6, "p")


def test_block_scan(spark):
    df = scored(spark, [0] * 95 + [1] * 5, range(100))
    r = policy.block_fraction_scan(df, 0.10, 1.0, 0.01).first()
    assert r["target_achieved"] and r["block_fraction"] <= 0.05 + 1e-12 and r["achieved_precision"] == 1
    none = policy.block_fraction_scan(scored(spark, [1] + [0] * 99, range(100)), 0.10, 0.9, 0.01).first()
    assert not none["target_achieved"] and none["block_fraction"] == pytest.approx(0.01)


def test_derived_policy_respects_capacity(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    y = (rng.random(2000) < 0.05).astype(int)
    s = np.clip(rng.random(2000) + 0.5 * y, 0, 1)
    row = policy.derive_policies(scored(spark, y.tolist(), s.tolist()), [("p", 0.05, 0.5)]).first()
    assert 0 <= row["approve_threshold"] <= row["block_threshold"] <= 1
    assert (s >= row["approve_threshold"]).mean() <= 0.06


def test_overlap_and_union(spark):
    a, b = [10, 9, 1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 20, 19, 6, 7, 8]
    y = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, y[i], float(a[i]), float(b[i])) for i in range(10)], "id long, label int, a double, b double")
    o = compare.topk_overlap(df, "a", "b", 0.2).first()
    assert (o["n_both"], o["pos_only_a"], o["pos_only_b"]) == (0, 1, 1)
    u = compare.topk_union(df, "a", "b", 0.2).first()
    assert (u["n_union"], u["pos_union"], u["recall_union"]) == (4, 2, 1)


def test_correlation_p_value(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5), (7, 7)]], "a double, b double")
    r = ranking.score_correlation(df, "a", "b").first()
    assert r["spearman_rho"] == pytest.approx(r["pearson_r"])
    assert r["pearson_p"] == pytest.approx(0.006807, abs=1e-5)


def test_score_parity(spark):
    off = spark.createDataFrame([(1, .5), (2, .8), (3, .1)], "id long, score double")
    on = spark.createDataFrame([(1, .5000001), (2, .8), (3, .15)], "id long, score double")
    r = compare.score_parity(on, off, "id").first()
    assert r["n_mismatches"] == 1 and r["max_abs_diff"] == pytest.approx(.05)
    extra = on.unionByName(spark.createDataFrame([(9, .5)], "id long, score double"))
    r = compare.score_parity(extra, off, "id").first()
    assert r["n_compared"] == 4 and r["n_mismatches"] == 2


def test_decision_and_feature_parity(spark):
    off = spark.createDataFrame([(1, "A"), (2, "B"), (3, "R")], "id long, decision string")
    on = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "A")], "id long, decision string")
    r = compare.decision_parity(on, off, "id").first()
    assert (r["n_compared"], r["n_matching"]) == (3, 2)
    a = spark.createDataFrame([(1, 10.0, None), (2, 1.0, 2.0), (7, 1.0, 1.0)], "id long, f double, g double")
    b = spark.createDataFrame([(1, 999.0, None), (2, 1.0, 2.0)], "id long, f double, g double")
    r = compare.feature_parity(a, b, "id", ["f", "g"]).first()
    assert (r["n_rows_compared"], r["n_features_compared"], r["n_rows_matching"], r["n_mismatches"], r["max_abs_diff"]) == (3, 4, 1, 2, 989)


def test_attach_features_checks(spark):
    base = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError, match="without"):
        compare.attach_features(base, spark.createDataFrame([(1, 1.0)], "id long, f double"), "id")
    with pytest.raises(ValueError, match="repeated"):
        compare.attach_features(base, spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0)], "id long, f double"), "id")
    with pytest.raises(ValueError):
        compare.join_one_to_one(base, spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, f double"), "id")


def gates(spark, **over):
    row = dict(model_id="c", average_precision=0.5, roc_auc=0.9, champion_average_precision=0.5, champion_roc_auc=0.9,
               delta_ap=0.0, delta_negatives_blocked=0.0, schema_version="s", policy_version="p")
    row.update(over)
    meta = [("champion", "s", "p"), ("c", row.pop("schema_version"), row.pop("policy_version"))]
    schema = "model_id string, " + ", ".join(f"{k} double" for k in row if k != "model_id")
    comparison = spark.createDataFrame([tuple(row.values())], schema)
    return compare.promotion_gates(comparison, spark.createDataFrame(meta, "model_id string, schema_version string, policy_version string"), "champion").first()["recommendation"]


def test_promotion_gates(spark):
    assert gates(spark) == "PROMOTE"
    assert gates(spark, delta_ap=-0.005) == "PROMOTE"
    assert gates(spark, delta_ap=0.48 - 0.50) == "REQUIRES_REVIEW"
    assert gates(spark, delta_ap=-0.021) == "REJECT"
    assert gates(spark, average_precision=0.29) == "REJECT"
    assert gates(spark, average_precision=None) == "REJECT"
    assert gates(spark, schema_version="t") == "REJECT"
    assert gates(spark, policy_version="q") == "REQUIRES_REVIEW"
    assert gates(spark, delta_negatives_blocked=None) == "REQUIRES_REVIEW"
    assert gates(spark, delta_negatives_blocked=0.0051) == "REQUIRES_REVIEW"


@pytest.mark.parametrize("cell_rows", [0, 1_000_000])
@pytest.mark.parametrize("curve", [False, True])
def test_many_ranks_of_many_groups(spark, cell_rows, curve, monkeypatch):
    """Without a curve no table is ordered unless a cell is over the limit; ties, negative scores and a group without a name."""
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        g = rnd.choice(["a", "a", "a", "b", None])
        s = {0: 0.5, 1: 0.0, 2: -3.0}.get(rnd.randrange(6), rnd.uniform(-1, 1) ** 5)
        rows.append((i, g, int(rnd.random() < 0.2), None if rnd.random() < 0.05 else s))
    df = spark.createDataFrame(rows, "id long, g string, label int, score double").repartition(5)
    budgets = [0.001, 0.02, 0.1, 0.35, 0.36, 0.5, 0.77, 1.0]
    order = ranking.score_curve(df, by=["g"]) if curve else None
    if cell_rows and not curve:
        monkeypatch.setattr(ranking, "running_totals", lambda *a, **k: pytest.fail("ordered"))
        monkeypatch.setattr(ranking, "global_rank", lambda *a, **k: pytest.fail("ordered"))
    got = {(r["g"], r["budget"]): (r["n_rows"], r["n_reviewed"], r["captured"], r["n_positive"], r["cutoff_score"])
           for r in ranking.budget_table(df, budgets, by=["g"], curve=order, cell_rows=cell_rows).collect()}
    want = {}
    for g in ("a", "b", None):
        mine = sorted(((s, i, y) for i, h, y, s in rows if h == g and s is not None), reverse=True)
        for b in budgets:
            k = ranking.selection_size(len(mine), b)
            want[g, b] = (len(mine), k, sum(y for *_, y in mine[:k]), sum(y for *_, y in mine), mine[k - 1][0])
    assert got == want


def test_cells_never_fall_as_scores_rise(spark):
    rnd = random.Random(2)
    values = sorted([rnd.uniform(-1, 1) * 10 ** rnd.randrange(-300, 300) for _ in range(400)] + [0.0, -0.0, 5e-324, -5e-324, 1e308, float("inf"), float("-inf"), 1.0, 1 - 2 ** -53, 1 + 2 ** -52])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r[1] for r in df.select("i", ranking.score_cell(F.col("v"))).orderBy("i").collect()]
    assert cells == sorted(cells)
    assert ranking.budget_table(spark.createDataFrame([], "id long, label int, score double"), [0.1]).count() == 0
