"""Deriving and evaluating three-way decision policies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import APPROVE, BLOCK, DECISIONS, REVIEW, DecisionPolicy, count_if, decide, ratio
from ..functions.ordering import join_on
from ..functions.session import materialized
from .ranking import _grouped, budget_table, rows_at_ranks


def policy_summary(df: DataFrame, score="score", label="label", approve=None, block=None,
                   by: Sequence[str] = (), decision: str | None = None) -> DataFrame:
    """One row per group: counts by decision, recall of REVIEW+BLOCK, precision, touched negatives.

    A single aggregation; the thresholds may be numbers or columns of the table.
    """
    d = F.col(decision) if decision else decide(F.col(score), approve, block)
    rows = df.select(*by, d.alias("__d"), (F.col(label) == 1).alias("__y"))
    cells = []
    for name in DECISIONS:
        hit = F.col("__d") == name
        cells += [count_if(hit).alias(f"n_{name.lower()}"), count_if(hit & F.col("__y")).alias(f"pos_{name.lower()}")]
    agg = _grouped(rows, by).agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("__y")).alias("n_positive"), *cells)
    c = F.col
    neg = c("n_rows") - c("n_positive")
    neg_review, neg_block = c("n_review") - c("pos_review"), c("n_block") - c("pos_block")
    return agg.select(
        *by, "n_rows", "n_positive", *[f"{k}_{n.lower()}" for n in DECISIONS for k in ("n", "pos")],
        (c("pos_review") + c("pos_block")).alias("captured"),
        ratio(c("pos_review") + c("pos_block"), c("n_positive")).alias("recall_review_block"),
        ratio(c("pos_review"), c("n_review")).alias("precision_review"),
        ratio(c("pos_block"), c("n_block")).alias("precision_block"),
        ratio(neg_review, neg).alias("share_negatives_reviewed"), ratio(neg_block, neg).alias("share_negatives_blocked"),
        ratio(neg_review + neg_block, neg).alias("share_negatives_touched"))


def policy_report(df: DataFrame, score="score", label="label", approve=None, block=None,
                  by: Sequence[str] = (), decision: str | None = None) -> DataFrame:
    """Three rows per group, one per decision, empty ones included."""
    s = policy_summary(df, score, label, approve, block, by, decision)
    rows = F.array(*[F.struct(F.lit(n).alias("decision"), F.col(f"n_{n.lower()}").alias("n"),
                              F.col(f"pos_{n.lower()}").alias("positives")) for n in DECISIONS])
    return s.select(*by, "n_rows", F.explode(rows).alias("d")).select(
        *by, "d.decision", "d.n", ratio(F.col("d.n"), F.col("n_rows")).alias("share"), "d.positives",
        (F.col("d.n") - F.col("d.positives")).alias("negatives"), ratio(F.col("d.positives"), F.col("d.n")).alias("positive_rate"))


def scan_grid(max_fraction: float, step: float = 0.0005) -> list[float]:
    """step, 2*step, ... up to max_fraction (inclusive within 1e-9)."""
    count = math.ceil((max_fraction + 1e-9 - step) / step)
    return [step + i * step for i in range(max(count, 1))]


def block_fraction_scan(df: DataFrame, max_fraction: float, target: float, step: float = 0.0005, score="score",
                        label="label", id_col="id", by: Sequence[str] = ()) -> DataFrame:
    """Largest top fraction of the grid whose precision meets the target, else the smallest."""
    grid = scan_grid(max_fraction, step)
    table = budget_table(df, grid, score, label, id_col, by)
    ok = F.col("precision") >= target
    pick = F.struct(F.col("budget").alias("f"), F.col("precision").alias("p"), F.col("cutoff_score").alias("s"))
    best = _grouped(table, by).agg(F.max(F.when(ok, pick)).alias("hit"), F.min(pick).alias("low"))
    chosen = F.coalesce("hit", "low")
    return best.select(*by, chosen["f"].alias("block_fraction"), chosen["p"].alias("achieved_precision"),
                       F.col("hit").isNotNull().alias("target_achieved"), chosen["s"].alias("block_threshold"))


def derive_policies(val: DataFrame, candidates: Sequence[tuple[str, float, float]], step: float = 0.0005,
                    score="score", label="label", id_col="id", by: Sequence[str] = ()) -> DataFrame:
    """Policies from validation rows: (name, review capacity, block precision target) each.

    One look-up of ranks serves all candidates and all groups; its few rows are written once.
    """
    table = materialized(budget_table(val, sorted({b for _, cap, _ in candidates for b in [cap, *scan_grid(cap, step)]}),
                                      score, label, id_col, by))
    out = None
    for name, capacity, target in candidates:
        grid = F.col("budget").isin(scan_grid(capacity, step))
        pick = F.struct(F.col("budget").alias("f"), F.col("precision").alias("p"), F.col("cutoff_score").alias("s"))
        best = _grouped(table, by).agg(
            F.max(F.when(F.col("budget") == capacity, F.col("cutoff_score"))).alias("approve_threshold"),
            F.max(F.when(grid & (F.col("precision") >= target), pick)).alias("hit"), F.min(F.when(grid, pick)).alias("low"))
        chosen = F.coalesce("hit", "low")
        guarded = F.when(chosen["s"] < F.col("approve_threshold"), F.raise_error(
            F.lit("derive_policies: block threshold below approve threshold")).cast("double")).otherwise(chosen["s"])
        part = best.select(
            *by, F.lit(name).alias("policy"), F.lit(float(capacity)).alias("review_capacity"),
            F.lit(float(target)).alias("block_precision_target"), "approve_threshold", guarded.alias("block_threshold"),
            chosen["f"].alias("block_fraction"), chosen["p"].alias("block_precision"),
            F.col("hit").isNotNull().alias("target_achieved"))
        out = part if out is None else out.unionByName(part)
    return out


def as_policy(row) -> DecisionPolicy:
    """A row of derive_policies as a policy object."""
    return DecisionPolicy(row["approve_threshold"], row["block_threshold"], row["policy"])


def policy_vs_budget(df: DataFrame, policy: DecisionPolicy, score="score", label="label", id_col="id",
                     by: Sequence[str] = ()) -> DataFrame:
    """The policy against plain ranking with the same number of interventions."""
    s = policy_summary(df, score, label, policy.approve_threshold, policy.block_threshold, by)
    fraction = ratio(F.col("n_review"), F.col("n_rows")) + ratio(F.col("n_block"), F.col("n_rows"))
    s = materialized(s.withColumn("matched_fraction", fraction).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.col("matched_fraction"))).cast("long")))
    at = lambda rank: lambda n: F.array(F.struct(F.lit(0.0).alias("tag"), rank.alias("rank")))
    if by:
        r = rows_at_ranks(df, at(F.col("asked")), score, label, id_col, by, beside=s.select(*by, F.col("rank").alias("asked")))
    else:
        r = rows_at_ranks(df, at(F.lit(s.first()["rank"] or 0)), score, label, id_col)  # one scalar
    both = join_on(s, r.select(*by, "rank", F.col("captured").alias("budget_captured")), [*by, "rank"])
    none = F.col("matched_fraction") <= 0
    budget_recall = ratio(F.col("budget_captured"), F.col("n_positive"))
    return both.select(
        *by, "matched_fraction", (F.col("n_review") + F.col("n_block")).alias("n_intervened"),
        F.col("captured").alias("policy_captured"), F.col("recall_review_block").alias("policy_recall"),
        "precision_block", "precision_review", F.when(~none, F.col("rank")).alias("budget_reviewed"),
        F.when(~none, F.col("budget_captured")).alias("budget_captured"),
        F.when(~none, budget_recall).alias("budget_recall"),
        F.when(~none, F.col("recall_review_block") - budget_recall).alias("recall_delta"))
