import itertools
import math

import numpy as np
import pytest

from sparkrisk.functions.expressions import exact_kolmogorov_p
from sparkrisk.operators import drift


def long(spark, values, feature="x"):
    return spark.createDataFrame([(feature, None if v is None else float(v)) for v in values], "feature string, value double")


def bins_of(spark, ref):
    return drift.numeric_profile(long(spark, ref))[0]


def psi(spark, bins, cur, **kw):
    return drift.numeric_psi(bins, long(spark, cur), **{"medians": False, **kw}).first()


def brute_psi(ref, cur):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = np.histogram(ref, edges)[0] / len(ref), np.histogram(cur, edges)[0] / len(cur)
    r, c = np.clip(r, 1e-4, None), np.clip(c, 1e-4, None)
    return float(np.sum((c - r) * np.log(c / r)))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.gamma(2, 50, 700), rng.gamma(2, 80, 300)
    r = psi(spark, bins_of(spark, ref), cur, medians=True)
    assert r["psi"] == pytest.approx(brute_psi(ref, cur)) and r["current_median"] == pytest.approx(np.median(cur))
    counts = rng.poisson(2, 500)  # repeated edges
    assert psi(spark, bins_of(spark, counts), counts[:100])["psi"] == pytest.approx(brute_psi(counts, counts[:100]))


def test_same_batch_has_no_drift_and_shifted_batch_has(spark):
    rng = np.random.default_rng(2)
    ref = rng.gamma(2, 50, 1000)
    bins = bins_of(spark, ref)
    assert psi(spark, bins, ref)["psi"] == pytest.approx(0)
    shifted = psi(spark, bins, rng.gamma(2, 500, 300))
    assert shifted["psi"] > 0.2 and shifted["severity"] in ("MODERATE_DRIFT", "HIGH_DRIFT")


def test_extremes_stay_finite(spark):
    bins = bins_of(spark, list(range(100)))
    assert np.isfinite(psi(spark, bins, [1e9] * 50)["psi"])
    empty = psi(spark, bins, [])
    assert np.isfinite(empty["psi"]) and empty["n_current"] == 0
    assert np.isfinite(psi(spark, bins, [None, None])["psi"])
    assert psi(spark, bins_of(spark, [5] * 20), [7] * 10)["psi"] == pytest.approx(0)  # a constant has one open bin


def test_severity_levels(spark):
    from pyspark.sql import functions as F
    from sparkrisk.functions.expressions import psi_severity
    df = spark.createDataFrame([(0.01,), (0.15,), (0.25,), (0.5,)], "p double")
    got = [r[0] for r in df.orderBy("p").select(psi_severity(F.col("p"))).collect()]
    assert got == ["NO_SIGNIFICANT_DRIFT", "LOW_DRIFT", "MODERATE_DRIFT", "HIGH_DRIFT"]


def test_categories(spark):
    ref = spark.createDataFrame([("c", v) for v in ["W"] * 600 + ["C"] * 395 + ["rare"] * 5], "feature string, category string")
    cats = drift.categorical_profile(ref)
    assert {r["category"]: r["grouped"] for r in cats.collect()} == {"W": "W", "C": "C", "rare": "__OTHER__"}
    cur = spark.createDataFrame([("c", v) for v in ["W"] * 50 + ["new"] * 50], "feature string, category string")
    r = drift.categorical_psi(cats, cur).first()
    assert (r["n_new_categories"], r["n_missing_categories"], r["n_current"]) == (1, 2, 100)
    ref_share, cur_share = np.array([.6, .395, .005]), np.array([.5, 1e-4, .5])
    assert r["psi"] == pytest.approx(float(np.sum((cur_share - ref_share) * np.log(cur_share / ref_share))))
    changes = {(x["category"], x["change"]) for x in drift.category_changes(cats, cur).collect()}
    assert changes == {("new", "new"), ("C", "missing"), ("rare", "missing")}


def test_ks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 200).round(1), rng.normal(0.5, 1, 150).round(1)
    r = drift.ks_two_sample(long(spark, a), long(spark, b)).first()
    grid = np.union1d(a, b)
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert r["ks_statistic"] == pytest.approx(d) and 0 <= r["ks_p_value"] < 0.01
    assert r["current_median"] == pytest.approx(np.median(b))
    assert drift.ks_two_sample(long(spark, a), long(spark, [1.0])).first()["ks_statistic"] is None


def test_report_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 400
    rows = [(i, float(v), "W" if i % 3 else "C", float(s), "APPROVE") for i, (v, s) in enumerate(zip(rng.gamma(2, 50, n), rng.beta(1, 20, n)))]
    schema = "id long, amt double, cat string, score double, decision string"
    ref = spark.createDataFrame(rows, schema)
    prof = drift.reference_profile(ref, ["amt", "absent"], ["cat"], "id")
    prof.save(str(tmp_path))
    prof = drift.ReferenceProfile.load(spark, str(tmp_path))
    assert prof.values.where("feature = 'amt'").agg({"r": "sum"}).first()[0] == ref.where("amt is not null").count()
    batch = spark.createDataFrame([(i, 5000.0 + i, "Z", 0.01, "BLOCK") for i in range(20)], schema)
    signals = drift.drift_signals(prof, batch, ["amt", "score"], ["cat"])
    r = drift.drift_report(signals, batch).first()
    assert r["overall_severity"] == "HIGH_DRIFT" and r["low_confidence"] and r["batch_rows"] == 20
    assert {"amt", "cat", "decision_distribution"} <= set(r["contributing_signals"].split(","))
    assert r["warnings"] == "cat: 1 new category value(s)"
    same = drift.drift_report(drift.drift_signals(prof, ref, ["amt", "score"], ["cat"]), ref).first()
    assert same["overall_severity"] == "NO_SIGNIFICANT_DRIFT" and not same["low_confidence"]


def test_exact_p_counts_all_orders():
    for n, m in ((1, 1), (3, 2), (4, 4), (5, 3), (7, 8), (8, 8)):
        gaps = []
        for first in itertools.combinations(range(n + m), n):
            i = j = top = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in first else (i, j + 1)
                top = max(top, abs(i * m - j * n))
            gaps.append(top)
        for h in set(gaps):
            assert abs(exact_kolmogorov_p(h / (n * m), n, m) - sum(g >= h for g in gaps) / math.comb(n + m, n)) < 1e-12


def test_exact_p_nears_the_limit():
    n, m = 4000, 3000
    for d in (0.02, 0.03, 0.05):
        lam = d * d * n * m / (n + m)
        limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam) for k in range(1, 60))
        assert abs(exact_kolmogorov_p(d, n, m) - limit) < 0.05 * max(limit, 1e-3)
    assert exact_kolmogorov_p(0.0, 5, 5) == 1.0 and 0 < exact_kolmogorov_p(1.0, 300, 300) < 1e-150
