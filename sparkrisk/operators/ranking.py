"""Ranking metrics, curves and review budgets.

Every operator takes ``by`` columns (split, model_id, ...) and evaluates all groups in one job.
Equal scores are counted before anything is ordered; ordering goes through running_totals, which
spreads any group, however large, over all partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import count_if, ratio, unit_bin
from ..functions.ordering import (DIRECT_SORT_ROWS, asc, at_or_before, beside, desc, global_rank, join_on,
                                  keys_at_ranks, running_totals)
from ..functions.session import materialized

# --- fixed values -------------------------------------------------------------
BUDGETS = (0.01, 0.02, 0.05)
F1_EPSILON = 1e-12
# -----------------------------------------------------------------------------


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Cells of scores for each factor of e, rows of one cell that one task may order, picked ranks that may be broadcast.
CELLS_PER_E, CELL_ROWS, FEW_PICKS = 4096, 1_000_000, 100_000


def budget_grid(points: int = 40, low: float = 0.005, high: float = 0.20) -> list[float]:
    """Evenly spaced budgets for the budget curve."""
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def selection_size(n: int, k: float) -> int:
    if not 0 < k <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    return max(1, math.ceil(n * k)) if n else 0


# ---- top slices ------------------------------------------------------------------

def top_cutoff(df: DataFrame, score: str, id_col: str, k: float, direct_rows: int = DIRECT_SORT_ROWS):
    """(n_rows, last selected key) of the top fraction; ties at the cut-off keep the higher id."""
    order = [desc(score), desc(id_col)]
    n, keys = keys_at_ranks(df.where(F.col(score).isNotNull()), order, lambda n: [selection_size(n, k)], direct_rows)
    return n, keys[0]


def top_flag(df: DataFrame, score: str, id_col: str, k: float, flag: str = "selected",
             direct_rows: int = DIRECT_SORT_ROWS) -> DataFrame:
    """Add a boolean for the top fraction: a comparison with one key, the rows are not moved."""
    _, key = top_cutoff(df, score, id_col, k, direct_rows)
    cond = at_or_before([desc(score), desc(id_col)], key) if key else F.lit(False)
    return df.withColumn(flag, F.coalesce(cond, F.lit(False)))


def top_fraction(df: DataFrame, score: str, id_col: str, k: float, direct_rows: int = DIRECT_SORT_ROWS) -> DataFrame:
    """The rows of the top slice: max(1, ceil(n*k)) highest scores."""
    return top_flag(df, score, id_col, k, "__sel", direct_rows).where("__sel").drop("__sel")


def score_at_top_fraction(df: DataFrame, score: str, id_col: str, k: float) -> DataFrame:
    """Lowest score inside the top slice (T3), one row."""
    return top_fraction(df, score, id_col, k).agg(F.min(score).alias("cutoff_score"))


def top_per_group(df: DataFrame, group: Sequence[str], magnitude: str, k: int, tiebreak: str) -> DataFrame:
    """The k rows of largest absolute value per group (T4).

    Up to the engine's limit for it, a task keeps only its own k best rows of a group before they are shuffled. Beyond,
    a group's rows are first ranked in shares whose number follows from the rows there are.
    """
    big_first = [F.abs(F.col(magnitude)).desc(), F.col(tiebreak).asc()]
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        share = F.pmod(F.xxhash64(tiebreak), F.lit(max(1, math.ceil(df.count() / (8 * k)))))
        df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group, share).orderBy(*big_first))).where(F.col("__r") <= k).drop("__r")
    w = Window.partitionBy(*group).orderBy(*big_first)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42, direct_rows: int = DIRECT_SORT_ROWS) -> DataFrame:
    """Repeatable sample of n rows without replacement: the n smallest digests of seed and id (T5).

    Only the boundary is looked up; the rows are compared with it where they are, however many n is.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    keyed = df.withColumns({"__h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), "__i": F.col(id_col)})
    order = [asc("__h"), asc("__i")]
    size, keys = keys_at_ranks(keyed, order, lambda rows: [min(n, rows)], direct_rows)
    kept = keyed.where(at_or_before(order, keys[0])) if keys[0] is not None else keyed.where(F.lit(False))
    return kept.drop("__h", "__i")


# ---- curves -----------------------------------------------------------------------

def score_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, descending: rows and positives at it, and running totals."""
    counts = (df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("threshold"))
              .agg(F.count(F.lit(1)).alias("n"), count_if(F.col(label) == 1).alias("p")))
    return running_totals(counts, [desc("threshold")], {"n": F.col("n"), "p": F.col("p")}, by, ["threshold"])


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (),
                    strict: bool = True, curve: DataFrame | None = None) -> DataFrame:
    """Step-wise average precision and ROC AUC per group.

    A group with only one class is an error when strict, otherwise its metrics are NULL.
    """
    c = curve if curve is not None else score_curve(df, score, label, by)
    neg = F.col("n") - F.col("p")
    out = _grouped(c, by).agg(
        F.max("total_n").alias("n_rows"), F.max("total_p").alias("n_positive"),
        F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")).alias("ap_sum"),
        F.sum(neg * (F.col("cum_p") - F.col("p") / 2.0)).alias("auc_sum"))
    pos, negs = F.col("n_positive"), F.col("n_rows") - F.col("n_positive")
    both = (pos > 0) & (negs > 0)
    error = F.raise_error(F.lit("ranking_metrics: both classes must be present")).cast("double") if strict else F.lit(None).cast("double")
    return out.select(
        *by, "n_rows", "n_positive",
        F.when(both, ratio(F.col("ap_sum"), pos)).otherwise(error).alias("average_precision"),
        F.when(both, ratio(F.col("auc_sum"), pos.cast("double") * negs)).otherwise(error).alias("roc_auc"))


def average_precision(df: DataFrame, score="score", label="label", by=()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "average_precision")


def roc_auc(df: DataFrame, score="score", label="label", by=()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "roc_auc")


def pr_curve(df: DataFrame, score="score", label="label", by: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every threshold, plus the end point (NULL threshold: 1, 0)."""
    c = curve if curve is not None else score_curve(df, score, label, by)
    points = c.select(*by, "threshold", ratio(F.col("cum_p"), F.col("cum_n")).alias("precision"),
                      F.coalesce(ratio(F.col("cum_p"), F.col("total_p")), F.lit(1.0)).alias("recall"))
    end = c.select(*by).distinct() if by else c.agg(F.count(F.lit(1)).alias("__c")).drop("__c")
    return points.unionByName(end.select(*by, F.lit(None).cast("double").alias("threshold"),
                                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def roc_curve(df: DataFrame, score="score", label="label", by: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """False and true positive rate at every threshold, plus the origin (NULL threshold)."""
    c = curve if curve is not None else score_curve(df, score, label, by)
    points = c.select(*by, "threshold",
                      ratio(F.col("cum_n") - F.col("cum_p"), F.col("total_n") - F.col("total_p")).alias("fpr"),
                      ratio(F.col("cum_p"), F.col("total_p")).alias("tpr"))
    end = c.select(*by).distinct() if by else c.agg(F.count(F.lit(1)).alias("__c")).drop("__c")
    return points.unionByName(end.select(*by, F.lit(None).cast("double").alias("threshold"),
                                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def _confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"),
            F.coalesce(ratio(2.0 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
            ratio(fp, fp + tn).alias("fpr"), (tp + fp).alias("n_flagged")]


def threshold_metrics(df: DataFrame, thresholds: Sequence[float], score="score", label="label",
                      by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates for ``score >= threshold``, all thresholds in one pass."""
    y, s = F.col(label), F.col(score)
    cells = []
    for t in thresholds:
        flag = s >= float(t)
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), count_if(flag & (y == 1)).alias("tp"),
                              count_if(flag & (y == 0)).alias("fp"), count_if(~flag & (y == 1)).alias("fn"),
                              count_if(~flag & (y == 0)).alias("tn")))
    rows = _grouped(df, by).agg(F.array(*cells).alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")
    return rows.select(*by, "threshold", "tn", "fp", "fn", "tp",
                       *_confusion(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_f1_threshold(df: DataFrame, score="score", label="label", by: Sequence[str] = (),
                      curve: DataFrame | None = None) -> DataFrame:
    """Threshold of the highest F1; ties keep the lowest threshold; no row at all gives 0.5 (E5)."""
    c = curve if curve is not None else score_curve(df, score, label, by)
    precision = F.col("cum_p") / F.col("cum_n")
    recall = F.coalesce(ratio(F.col("cum_p"), F.col("total_p")), F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall + F1_EPSILON)).otherwise(0.0)
    best = _grouped(c, by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"),
                       F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


# ---- review budgets ----------------------------------------------------------------

def score_cell(score: Column) -> Column:
    """Whole number that never falls as the score rises: CELLS_PER_E cells for each factor of e, on both sides of zero.

    The logarithm is semi-monotonic, so rounding can't put two scores into the wrong order.
    """
    s = score.cast("double")
    size = lambda x: F.floor(F.least(F.log(x) * CELLS_PER_E, F.lit(2.0 ** 30))) + F.lit(1 << 32)
    return F.when(F.isnan(s), F.lit(1 << 40)).when(s > 0, size(s)).when(s < 0, -size(-s)).otherwise(F.lit(0)).cast("long")


def _counted(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Rows and positives by cell, and running totals from the highest cell down; one row per (group, cell) that occurs."""
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, score_cell(F.col(score)).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(label) == 1).alias("p"), F.min(score).alias("low"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # the number of cells is bounded, however many rows there are
    down = group.orderBy(F.desc("cell"))
    cells = materialized(cells)
    return cells.select("*", *[F.sum(c).over(down).alias(f"cum_{c}") for c in "np"], *[F.sum(c).over(group).alias(f"total_{c}") for c in "np"])


def rows_at_ranks(df: DataFrame, wanted: Callable[[Column], Column], score="score", label="label", id_col="id", by: Sequence[str] = (),
                  curve: DataFrame | None = None, beside: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows at many ranks of many groups (descending score, id), without ordering the table.

    ``wanted`` maps a group's number of rows to an array of (tag, rank); columns of ``beside`` (one row per group) may be
    used in it. Counts by cell tell which cell holds a rank; a cell that is taken whole needs no order, and of the others only the
    rows in them are read again and ordered. With a ``curve`` its scores are the cells. Returns
    ``by, tag, rank, n_rows, n_positive, captured, cutoff_score``.
    """
    by = list(by)
    if curve is None:
        cells, cell = _counted(df, score, label, by), score_cell(F.col(score))
    else:
        cells = curve.select(*by, F.col("threshold").alias("cell"), F.col("threshold").alias("low"), "n", "p", "cum_n", "cum_p", "total_n", "total_p")
        cell = F.col(score).cast("double")
    if beside is not None:
        cells = join_on(cells, beside, by)
    here = F.filter(wanted(F.col("total_n")), lambda w: w["rank"].between(F.col("cum_n") - F.col("n") + 1, F.col("cum_n")))
    picks = cells.withColumn("w", F.explode(here)).select(
        *by, "cell", "w.tag", "w.rank", "low", "n", "p", "cum_n", "cum_p", F.col("total_n").alias("n_rows"), F.col("total_p").alias("n_positive"))
    picks = materialized(picks)
    result = [*by, "tag", "rank", "n_rows", "n_positive", "captured", "cutoff_score"]
    whole = picks.where("rank = cum_n").withColumns({"captured": F.col("cum_p"), "cutoff_score": F.col("low")}).select(*result)
    part = picks.where("rank < cum_n").withColumn("inner", F.col("rank") - F.col("cum_n") + F.col("n"))
    k, largest = part.agg(F.count(F.lit(1)), F.max("n")).first()
    if not k:
        return whole
    keys = part.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("picked"))
    rows = df.where(F.col(score).isNotNull()).select(*by, cell.alias("cell"), F.col(score).alias("__s"), F.col(id_col).alias("__id"), (F.col(label) == 1).cast("long").alias("__y"))
    rows = join_on(rows, F.broadcast(keys) if k <= FEW_PICKS else keys, [*by, "cell"]).drop("picked")
    if largest <= cell_rows:
        order = Window.partitionBy(*by, "cell").orderBy(F.desc("__s"), F.desc("__id"))
        ranked = rows.select("*", F.row_number().over(order).cast("long").alias("inner"), F.sum(F.coalesce("__y", F.lit(0))).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("before"))
    else:
        ranked = global_rank(rows, [desc("__s"), desc("__id")], [*by, "cell"], ["__s"], {"y": F.col("__y")}).withColumnsRenamed({"rank": "inner", "cum_y": "before"})
    ranked = ranked.select(*by, "cell", "inner", "before", F.col("__s").alias("cutoff_score"))
    found = join_on(ranked, F.broadcast(part) if k <= FEW_PICKS else part, [*by, "cell", "inner"])
    return whole.unionByName(found.withColumn("captured", F.col("cum_p") - F.col("p") + F.col("before")).select(*result))


def budget_table(df: DataFrame, budgets: Sequence[float] = BUDGETS, score="score", label="label", id_col="id",
                 by: Sequence[str] = (), curve: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Captured positives, recall, precision and cut-off score for each budget (E6-E8), by ``rows_at_ranks``."""
    for b in budgets:
        selection_size(1, b)
    every = F.array(*[F.lit(float(b)) for b in budgets])
    size = lambda n, b: F.greatest(F.lit(1), F.ceil(n * b)).cast("long")
    got = rows_at_ranks(df, lambda n: F.transform(every, lambda b: F.struct(b.alias("tag"), size(n, b).alias("rank"))), score, label, id_col, by, curve, cell_rows=cell_rows)
    return got.select(*by, F.col("tag").alias("budget"), "n_rows", F.col("rank").alias("n_reviewed"), "captured", "n_positive",
                      ratio(F.col("captured"), F.col("n_positive")).alias("recall"),
                      ratio(F.col("captured"), F.col("rank")).alias("precision"), "cutoff_score")


def recall_at_k(df, k: float, **kw) -> DataFrame:
    return budget_table(df, [k], **kw).select(*kw.get("by", ()), "budget", "recall")


def precision_at_k(df, k: float, **kw) -> DataFrame:
    return budget_table(df, [k], **kw).select(*kw.get("by", ()), "budget", "precision")


def fixed_budget_report(df, budget: float, **kw) -> DataFrame:
    return budget_table(df, [budget], **kw).drop("cutoff_score")


def score_bins(df: DataFrame, score="score", label="label", bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positive rate per equal-width score bin; without ``by`` empty bins are listed too."""
    filled = df.groupBy(*by, unit_bin(F.col(score), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col(label) == 1).cast("double")).alias("positive_rate"))
    if by:
        return filled
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "positive_rate")


# ---- correlation -------------------------------------------------------------------

def _mid_ranks(pairs: DataFrame, c: str) -> DataFrame:
    counts = pairs.groupBy(c).agg(F.sum("__n").alias("__c"))
    runs = running_totals(counts, [asc(c)], {"__c": F.col("__c")}, (), [c])
    return runs.select(F.col(c), (F.col("cum___c") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(f"__rank_{c}"))


def score_correlation(df: DataFrame, score_a: str, score_b: str) -> DataFrame:
    """Pearson r and Spearman rho (average ranks for ties) with two-sided p-values.

    Equal pairs are counted first. Ranks are joined back by score value; a value shared by very
    many distinct pairs is split by adaptive skew handling, the rank side has one row per value.
    """
    clean = df.where(F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    pairs = materialized(clean.groupBy(F.col(score_a).cast("double").alias("a"), F.col(score_b).cast("double").alias("b")).agg(
        F.count(F.lit(1)).alias("__n")))
    ranked = materialized(pairs.join(_mid_ranks(pairs, "a"), "a").join(_mid_ranks(pairs, "b"), "b"))
    total = ranked.agg(F.sum("__n").alias("n")).first()["n"]
    center = ((total or 0) + 1) / 2.0  # mean of all mid ranks
    ra, rb, w = F.col("__rank_a") - center, F.col("__rank_b") - center, F.col("__n")
    rho = ranked.agg(ratio(F.sum(w * ra * rb), F.sqrt(F.sum(w * ra * ra)) * F.sqrt(F.sum(w * rb * rb))).alias("spearman_rho"))
    r = clean.agg(F.corr(score_a, score_b).alias("pearson_r"), F.count(F.lit(1)).alias("n"))
    out = beside(r, rho)
    return out.select("n", "pearson_r", correlation_p("pearson_r", "n").alias("pearson_p"),
                      "spearman_rho", correlation_p("spearman_rho", "n").alias("spearman_p"))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation: t statistic with n-2 degrees of freedom."""
    return pd.Series([_t_two_sided(a, b) for a, b in zip(r, n)])


def _t_two_sided(r, n):
    if r is None or pd.isna(r) or n is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    return _incomplete_beta(dof / 2.0, 0.5, 1 - r * r)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h
