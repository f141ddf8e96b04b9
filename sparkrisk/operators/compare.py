"""Attaching, parity, overlap and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import count_if, ratio, same_within
from ..functions.ordering import beside, join_on
from ..functions.session import materialized
from ..functions.roles import require_columns
from .policy import policy_summary
from .ranking import (BUDGETS, budget_table, ranking_metrics, score_curve, threshold_metrics,
                      top_flag)

# --- fixed values: promotion thresholds -----------------------------------------
MIN_AP = 0.30
AP_DROP_REVIEW = 0.005
AP_DROP_FAIL = 0.02
MAX_BLOCKED_RISE = 0.005
GATE_SLACK = 1e-9
# ---------------------------------------------------------------------------------


def lookup_encode(df: DataFrame, column: str, vocabulary: DataFrame, key: str, value: str, default,
                  alias: str, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Replace categories by fitted values; unseen ones get the default.

    The vocabulary is counted: a small one is broadcast, a larger one is joined by shuffle.
    """
    vocab = vocabulary.select(F.col(key).cast("string").alias("__key"), F.col(value).alias("__value"))
    if vocab.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        vocab = F.broadcast(vocab)
    return (df.join(vocab, F.col(column).cast("string") == F.col("__key"), "left")
            .withColumn(alias, F.coalesce("__value", F.lit(default))).drop("__key", "__value"))


def attach_features(base: DataFrame, features: DataFrame, on: str, check: bool = True) -> DataFrame:
    """Left join of feature columns by id (J1); with ``check`` a missing or repeated id raises."""
    require_columns(base, [on], "attach_features")
    require_columns(features, [on], "attach_features")
    if not check:
        return base.join(features, on, "left")
    features = materialized(features)  # read by both checks and the join
    per = features.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    if per.where(F.col("n") > 1).limit(1).count():
        raise ValueError(f"attach_features: '{on}' is repeated in the features")
    if base.select(on).join(per, on, "left_anti").limit(1).count():
        raise ValueError(f"attach_features: '{on}' without features")
    return base.join(features, on, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join that refuses repeated keys on either side."""
    for name, df in (("left", left), ("right", right)):
        if df.groupBy(on).count().where(F.col("count") > 1).limit(1).count():
            raise ValueError(f"join_one_to_one: repeated '{on}' on the {name}")
    return left.join(right, on, "left")


# ---- parity ---------------------------------------------------------------------

def _sides(online: DataFrame, offline: DataFrame, id_col: str, names: Sequence[str], tolerance: float) -> DataFrame:
    """Per online row the id and ``cells``: (feature, online, offline, match), one cell without a feature if absent offline."""
    b = offline.select(F.col(id_col).alias("__id"), F.lit(True).alias("__there"),
                       *[F.col(n).cast("double").alias(f"__off_{n}") for n in names])
    both = online.join(b, F.col(id_col) == F.col("__id"), "left")

    def cell(name, x, y, ok):
        return F.struct(F.lit(name).cast("string").alias("feature"), x.cast("double").alias("online"), y.cast("double").alias("offline"), ok.alias("match"))
    cells = F.array(*[cell(n, F.col(n), F.col(f"__off_{n}"), same_within(F.col(n).cast("double"), F.col(f"__off_{n}"), tolerance)) for n in names])
    absent = F.array(cell(None, F.lit(None), F.lit(None), F.lit(False)))
    return both.select(F.col(id_col), F.when(F.col("__there"), cells).otherwise(absent).alias("cells"))


def feature_pairs(online: DataFrame, offline: DataFrame, id_col: str, names: Sequence[str],
                  tolerance: float = 1e-6) -> DataFrame:
    """Long comparison (id, feature, online, offline, match); ids absent offline give one row."""
    return _sides(online, offline, id_col, names, tolerance).select(id_col, F.explode("cells").alias("c")).select(id_col, "c.*")


def feature_parity(online: DataFrame, offline: DataFrame, id_col: str, names: Sequence[str],
                   tolerance: float = 1e-6) -> DataFrame:
    """One row of parity counts (J3), counted inside each row before anything is gathered."""
    bad = F.filter("cells", lambda c: ~c["match"])
    per_row = _sides(online, offline, id_col, names, tolerance).select(
        F.size(F.filter("cells", lambda c: c["feature"].isNotNull())).alias("n"), F.size(bad).alias("bad"),
        F.array_max(F.transform(bad, lambda c: F.abs(c["online"] - c["offline"]))).alias("d"))
    return per_row.agg(F.count(F.lit(1)).alias("n_rows_compared"), F.sum("n").alias("n_features_compared"),
                       count_if(F.col("bad") == 0).alias("n_rows_matching"), F.sum("bad").alias("n_mismatches"),
                       F.coalesce(F.max("d"), F.lit(0.0)).alias("max_abs_diff"))


def parity_examples(pairs: DataFrame, id_col: str, n: int = 50) -> DataFrame:
    """The first mismatches in id order, for reading."""
    return pairs.where(~F.col("match")).orderBy(id_col, "feature").limit(n)


def score_parity(online: DataFrame, offline: DataFrame, id_col: str, score: str = "score",
                 tolerance: float = 1e-6) -> DataFrame:
    """Differences and correlation of two scorings of the same rows."""
    b = offline.select(F.col(id_col).alias("__id"), F.col(score).alias("__off"))
    both = online.join(b, F.col(id_col) == F.col("__id"), "left")
    d = F.abs(F.col(score) - F.col("__off"))
    return both.agg(
        F.count(F.lit(1)).alias("n_compared"), count_if(F.col("__id").isNull() | (d > tolerance)).alias("n_mismatches"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs_diff"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_abs_diff"),
        F.corr(score, "__off").alias("correlation"))


def decision_parity(online: DataFrame, offline: DataFrame, id_col: str, decision: str = "decision") -> DataFrame:
    """Equal decisions; ids absent offline are skipped."""
    b = offline.select(F.col(id_col).alias("__id"), F.col(decision).alias("__off"))
    both = online.join(b, F.col(id_col) == F.col("__id"))
    same = F.col(decision) == F.col("__off")
    return both.agg(F.count(F.lit(1)).alias("n_compared"), count_if(same).alias("n_matching"),
                    count_if(~same).alias("n_mismatches"), ratio(count_if(same), F.count(F.lit(1))).alias("share_matching"))


# ---- overlap of two scores --------------------------------------------------------

def _flags(df, a, b, label, id_col, k):
    flagged = top_flag(top_flag(df, a, id_col, k, "in_a"), b, id_col, k, "in_b")
    return flagged.select("in_a", "in_b", (F.col(label) == 1).alias("y"))


def topk_overlap(df: DataFrame, score_a: str, score_b: str, k: float, label="label", id_col="id") -> DataFrame:
    """Rows and positives in both top slices and in one only."""
    a, b, y = F.col("in_a"), F.col("in_b"), F.col("y")
    return _flags(df, score_a, score_b, label, id_col, k).agg(
        count_if(a).alias("n_each"), count_if(a & b).alias("n_both"), count_if(a & ~b).alias("n_only_a"),
        count_if(~a & b).alias("n_only_b"), count_if(a & y).alias("pos_a"), count_if(b & y).alias("pos_b"),
        count_if(a & b & y).alias("pos_both"), count_if(a & ~b & y).alias("pos_only_a"),
        count_if(~a & b & y).alias("pos_only_b"), count_if(y).alias("n_positive"),
        ratio(count_if(a & b), count_if(a)).alias("overlap_share"))


def topk_union(df: DataFrame, score_a: str, score_b: str, k: float, label="label", id_col="id") -> DataFrame:
    """Union of two top slices: size, effective budget, recall, gain over A alone (U4)."""
    a, y = F.col("in_a"), F.col("y")
    either = a | F.col("in_b")
    return _flags(df, score_a, score_b, label, id_col, k).agg(
        count_if(either).alias("n_union"), ratio(count_if(either), F.count(F.lit(1))).alias("effective_budget"),
        count_if(either & y).alias("pos_union"), ratio(count_if(either & y), count_if(y)).alias("recall_union"),
        count_if(a & y).alias("pos_a"), (count_if(either & y) - count_if(a & y)).alias("gain_over_a"))


# ---- reports over splits and models -------------------------------------------------

def split_report(df: DataFrame, by: Sequence[str], threshold: float, budgets: Sequence[float] = BUDGETS,
                 score="score", label="label", id_col="id") -> DataFrame:
    """Ranking, threshold and budget metrics for all groups as (by, metric, value).

    Only distinct scores are ordered; budgets look their ranks up in that curve, and read rows again where scores tie.
    """
    curve = score_curve(df, score, label, by)
    ranking = ranking_metrics(df, by=by, strict=False, curve=curve)
    at = threshold_metrics(df, [threshold], score, label, by)
    table = budget_table(df, budgets, score, label, id_col, by, curve)

    ranking_long = _long(ranking, by, ["average_precision", "roc_auc"])
    at_long = _long(at, by, ["tn", "fp", "fn", "tp", "precision", "recall", "f1", "fpr"])
    cells = F.array(*[F.struct(F.concat(F.lit(f"{m}_at_"), F.format_string("%.4f", F.col("budget"))).alias("metric"),
                               F.col(m).alias("value")) for m in ("recall", "precision")])
    table_long = table.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.value")
    return ranking_long.unionByName(at_long).unionByName(table_long)


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [F.col(b) for b in by], [F.col(n) for n in names], "metric", "value")


def select_by_validation(metrics: DataFrame, variant: str, position: str, metric: str = "average_precision") -> DataFrame:
    """The variant with the highest validation metric; ties keep the earliest position."""
    best = metrics.agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col(position)).alias("p"),
                                      F.col(variant).alias("v"))).alias("b"))
    return best.select(F.col("b.v").alias("selected"), F.col("b.m").alias(metric))


def metric_reproducibility(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Stored against recomputed values, matched by key columns (E17); both have ``value``."""
    a = stored.select(*keys, F.col("value").alias("stored"), F.lit(True).alias("in_stored"))
    b = recomputed.select(*keys, F.col("value").alias("recomputed"), F.lit(True).alias("in_recomputed"))
    both = a.join(b, list(keys), "full_outer")
    there = F.coalesce("in_stored", F.lit(False)) & F.coalesce("in_recomputed", F.lit(False))
    return both.select(*keys, "stored", "recomputed", F.abs(F.col("stored") - F.col("recomputed")).alias("abs_diff"),
                       (there & same_within(F.col("stored"), F.col("recomputed"), tolerance)).alias("reproduced"))


def compare_models(df: DataFrame, champion: str, approve: float, block: float, model_col="model_id", score="score",
                   label="label") -> DataFrame:
    """Every candidate against the champion on the same labelled rows, in one job."""
    ranking = ranking_metrics(df, score, label, [model_col], strict=False)
    policy = policy_summary(df, score, label, approve, block, [model_col])
    own = ranking.select(model_col, "average_precision", "roc_auc").join(policy, model_col).select(
        model_col, "average_precision", "roc_auc", "recall_review_block", "precision_block", "share_negatives_blocked",
        *[ratio(F.col(f"n_{d}"), F.col("n_rows")).alias(f"share_{d}") for d in ("approve", "review", "block")])
    # one row per model: the champion's values are spread by a window over these few rows
    models = Window.partitionBy(F.lit(0))
    both = own.select("*", *[F.max(F.when(F.col(model_col) == champion, F.col(c))).over(models).alias(f"champion_{c}") for c in (
        "average_precision", "roc_auc", "recall_review_block", "precision_block", "share_negatives_blocked")])
    both = both.where(F.col(model_col) != champion)
    return both.withColumns({
        "delta_ap": F.col("average_precision") - F.col("champion_average_precision"),
        "delta_roc_auc": F.col("roc_auc") - F.col("champion_roc_auc"),
        "delta_recall": F.col("recall_review_block") - F.col("champion_recall_review_block"),
        "delta_block_precision": F.col("precision_block") - F.col("champion_precision_block"),
        "delta_negatives_blocked": F.col("share_negatives_blocked") - F.col("champion_share_negatives_blocked")})


def promotion_gates(comparison: DataFrame, metadata: DataFrame, champion: str, model_col="model_id") -> DataFrame:
    """Six gates and a recommendation per candidate.

    ``metadata`` has one row per model: schema_version, policy_version. A missing policy
    evaluation asks for review; a missing ranking metric fails.
    """
    models = Window.partitionBy(F.lit(0))
    described = metadata.select(model_col, "schema_version", "policy_version", *[
        F.max(F.when(F.col(model_col) == champion, F.col(c))).over(models).alias(f"champion_{c}") for c in ("schema_version", "policy_version")])
    t = comparison.join(described, model_col, "left")
    ap, delta, rise = F.col("average_precision"), F.col("delta_ap"), F.col("delta_negatives_blocked")

    def gate(name, ok, otherwise):
        return F.struct(F.lit(name).alias("gate"), F.when(ok, "PASS").otherwise(otherwise).alias("result"))

    have = ap.isNotNull() & F.col("roc_auc").isNotNull() & F.col("champion_average_precision").isNotNull() & F.col(
        "champion_roc_auc").isNotNull()
    gates = F.array(
        gate("metrics_known", have, "FAIL"),
        gate("same_schema", F.col("schema_version").eqNullSafe(F.col("champion_schema_version")), "FAIL"),
        gate("precision_floor", ap >= MIN_AP, "FAIL"),
        gate("precision_held", delta >= -AP_DROP_REVIEW - GATE_SLACK,
             F.when(delta >= -AP_DROP_FAIL - GATE_SLACK, "REQUIRES_REVIEW").otherwise("FAIL")),
        gate("blocking_held", rise <= MAX_BLOCKED_RISE, "REQUIRES_REVIEW"),
        gate("same_policy", F.col("policy_version").eqNullSafe(F.col("champion_policy_version")), "REQUIRES_REVIEW"))

    def named(result):
        hits = F.filter("gates", lambda g: g["result"] == result)
        return F.array_join(F.transform(hits, lambda g: g["gate"]), ",")

    t = t.withColumn("gates", gates)
    failed = F.exists("gates", lambda g: g["result"] == "FAIL")
    review = F.exists("gates", lambda g: g["result"] == "REQUIRES_REVIEW")
    return t.select(model_col, named("PASS").alias("passed_gates"), named("REQUIRES_REVIEW").alias("review_gates"),
                    named("FAIL").alias("failed_gates"),
                    F.when(failed, "REJECT").when(review, "REQUIRES_REVIEW").otherwise("PROMOTE").alias("recommendation"))
