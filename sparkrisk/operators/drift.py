"""Distribution drift of batches against a reference profile.

Signals are kept in long form (feature, value), so all features and all batches are one grouped
job. A profile is a handful of tables: bins, stats, categories, decisions, and the
reference values with their counts, from which distances of distributions are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import (DECISIONS, EXACT_KS_ROWS, MISSING, OTHER, PSI_FLOOR, SEVERITIES, count_if, two_sample_p,
                                     psi_severity, ratio, severity_rank)
from ..functions.ordering import asc, beside, exact_quantiles, join_on, running_totals
from ..functions.session import materialized

# --- fixed values ----------------------------------------------------------------
N_BINS = 10
RARE_SHARE = 0.01
MIN_BATCH_ROWS = 30
# ---------------------------------------------------------------------------------

DECILES = [i / N_BINS for i in range(N_BINS + 1)]


@dataclass(frozen=True)
class ReferenceProfile:
    """Tables of a reference distribution; all but ``values`` are bounded by features x bins or categories."""

    bins: DataFrame        # feature, interior (array of inner edges), bin, ref_count, ref_share
    stats: DataFrame       # feature, kind, n, null_share, mean, median, std, min, max
    categories: DataFrame  # feature, category, n, freq, grouped
    decisions: DataFrame   # feature='decision_distribution', category, n, freq, grouped
    values: DataFrame      # feature, value, r (how often), of every reference row

    def save(self, path: str) -> None:
        for name in self.__dataclass_fields__:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ReferenceProfile":
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in cls.__dataclass_fields__})


def melt_numeric(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value) of the monitored numeric columns that exist."""
    present = [f for f in features if f in df.columns]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in present])
    return df.select(*by, F.explode(cells).alias("c")).select(*by, "c.feature", "c.value")


def melt_categorical(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, category); NULL is a category of its own."""
    present = [f for f in features if f in df.columns]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias(
        "category")) for f in present])
    return df.select(*by, F.explode(cells).alias("c")).select(*by, "c.feature", "c.category")


def melt_decisions(df: DataFrame, decision: str = "decision", by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, category) of the decision column."""
    return melt_categorical(df.withColumn("decision_distribution", F.col(decision)), ["decision_distribution"], by)


# ---- reference side -------------------------------------------------------------------

def _bin_index(value: Column, interior: Column) -> Column:
    """Left-closed bin from sorted inner edges; plain comparisons stay in generated code."""
    hits = [F.coalesce((value >= F.get(interior, F.lit(i))).cast("int"), F.lit(0)) for i in range(N_BINS - 1)]
    return sum(hits[1:], hits[0])


def bin_edges(long: DataFrame) -> DataFrame:
    """(feature, interior, median): inner edges from exact deciles, duplicates removed; outer bins
    are open. Eleven quantiles per feature from one ordering."""
    q = exact_quantiles(long, "value", DECILES, by=["feature"])
    edges = q.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("e"),
                                     F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"))
    return edges.select("feature", F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("interior"), "median")


def numeric_profile(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bins, stats) of a (feature, value) table."""
    n = F.count(F.lit(1))
    plain = long.groupBy("feature").agg(
        F.count("value").alias("n"), ratio(n - F.count("value"), n).alias("null_share"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # one row per feature: kept, so that the rows are not ordered again for every use
    known = materialized(plain.join(bin_edges(long), "feature", "left"))
    stats = known.select("feature", "n", "null_share", "mean", "median", "std", "min", "max")
    edges = known.select("feature", F.coalesce("interior", F.array().cast("array<double>")).alias("interior"))
    counts = numeric_bin_counts(long, edges, [])
    bins = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.size("interior")))).join(
        counts, ["feature", "bin"], "left").join(stats.select("feature", "n"), "feature")
    bins = bins.select("feature", "interior", "bin", F.coalesce("cnt", F.lit(0)).alias("ref_count"),
                       F.coalesce(ratio(F.coalesce("cnt", F.lit(0)), F.col("n")), F.lit(0.0)).alias("ref_share"))
    return materialized(bins), stats


def numeric_bin_counts(long: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (by, feature, bin); the edge table has one row per monitored feature."""
    binned = long.where(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")
    return binned.groupBy(*by, "feature", _bin_index(F.col("value"), F.col("interior")).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"))


def categorical_profile(long: DataFrame, rare: float = RARE_SHARE) -> DataFrame:
    """Share of each category; those under the rare share are grouped, none is dropped (R2)."""
    counts = long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    freq = F.col("n") / F.col("total")
    return counts.join(totals, "feature").select(
        "feature", "category", "n", freq.alias("freq"),
        F.when(freq >= rare, F.col("category")).otherwise(OTHER).alias("grouped"))


def decision_profile(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Shares of the three decisions, absent ones with 0."""
    cells = F.array(*[F.struct(F.lit("decision_distribution").alias("feature"), F.lit(d).alias("category"),
                               count_if(F.col(decision) == d).alias("n")) for d in DECISIONS])
    one = df.agg(F.count(F.lit(1)).alias("total"), cells.alias("c"))
    return one.select("total", F.explode("c").alias("c")).select(
        "c.feature", "c.category", "c.n",
        F.coalesce(ratio(F.col("c.n"), F.col("total")), F.lit(0.0)).alias("freq"), F.col("c.category").alias("grouped"))


def reference_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], id_col: str,
                      score: str | None = "score", decision: str | None = "decision",
                      behavioral: Sequence[str] = ()) -> ReferenceProfile:
    """Profile of validation rows: numeric, behavioral and score bins, categories, decisions, values.

    Each table is written once, so that what uses it several times doesn't read the rows again.
    """
    signals = [*numeric, *behavioral] + ([score] if score else [])
    long = melt_numeric(df, signals)
    bins, stats = numeric_profile(long)  # the rows are ordered once, for edges and medians
    kind = F.when(F.col("feature").isin(list(behavioral)), "behavioral").when(F.col("feature") == score, "score").otherwise("numeric")
    values = materialized(_value_counts(long, [], "r"))
    cats = materialized(categorical_profile(melt_categorical(df, categorical)))
    decisions = materialized(decision_profile(df, decision)) if decision and decision in df.columns else cats.limit(0)
    return ReferenceProfile(bins, stats.withColumn("kind", kind), cats, decisions, values)


# ---- current side --------------------------------------------------------------------

def _psi_term(cur: Column, ref: Column) -> Column:
    c, r = F.greatest(cur, F.lit(PSI_FLOOR)), F.greatest(ref, F.lit(PSI_FLOOR))
    return (c - r) * F.ln(c / r)


def numeric_psi(bins: DataFrame, current: DataFrame, by: Sequence[str] = (), medians: bool = True) -> DataFrame:
    """PSI per (by, feature) with the current mean, median and count."""
    edges = bins.select("feature", "interior").distinct()
    totals = current.groupBy(*by, "feature").agg(F.count("value").alias("n_current"), F.avg("value").alias("current_mean"))
    counts = numeric_bin_counts(current, edges, by)
    ref = bins.select("feature", "bin", "ref_share")
    grid = totals.join(ref, "feature") if by else ref.join(totals, "feature", "left")
    full = join_on(grid, counts, [*by, "feature", "bin"], "left")
    share = F.coalesce(ratio(F.coalesce("cnt", F.lit(0)), F.col("n_current")), F.lit(0.0))
    psi = full.groupBy(*by, "feature").agg(
        F.sum(_psi_term(share, F.col("ref_share"))).alias("psi"),
        F.coalesce(F.max("n_current"), F.lit(0)).alias("n_current"), F.max("current_mean").alias("current_mean"))
    if medians:
        q = exact_quantiles(current, "value", [0.5], by=[*by, "feature"]).select(
            *by, "feature", F.col("quantile").alias("current_median"))
        psi = join_on(psi, q, [*by, "feature"], "left")
    return psi.withColumn("severity", psi_severity(F.col("psi")))


def _known(categories: DataFrame) -> DataFrame:
    # with a rare share above 0 at most 1 / share categories per feature; a plain join lets the size decide
    return categories.where(F.col("grouped") == F.col("category")).select("feature", "category", "grouped")


def categorical_psi(categories: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PSI per (by, feature) over the reference's grouped categories, with new and missing counts."""
    raw = current.groupBy(*by, "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = raw.groupBy(*by, "feature").agg(F.sum("n").alias("n_current"))
    mapped = raw.join(_known(categories), ["feature", "category"], "left")
    cur = mapped.groupBy(*by, "feature", F.coalesce("grouped", F.lit(OTHER)).alias("grouped")).agg(F.sum("n").alias("n"))
    ref = categories.groupBy("feature", "grouped").agg(F.sum("freq").alias("r"))
    ref_rows = (totals.join(ref, "feature") if by else ref.join(totals, "feature", "left")).select(
        *by, "feature", "grouped", F.col("r"), F.lit(0).cast("long").alias("n"))
    cur_rows = cur.join(F.broadcast(ref.select("feature").distinct()), "feature").select(
        *by, "feature", "grouped", F.lit(0.0).alias("r"), "n")
    cells = ref_rows.unionByName(cur_rows).groupBy(*by, "feature", "grouped").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    cells = join_on(cells, totals, [*by, "feature"], "left")
    share = F.coalesce(ratio(F.col("n"), F.col("n_current")), F.lit(0.0))
    psi = cells.groupBy(*by, "feature").agg(F.sum(_psi_term(share, F.col("r"))).alias("psi"),
                                            F.coalesce(F.max("n_current"), F.lit(0)).alias("n_current"))
    # how many are new or missing follows from how many are shared; no batch meets every reference category
    shared = raw.join(categories.select("feature", "category", F.lit(1).alias("in_ref")), ["feature", "category"], "left")
    changed = shared.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n_seen"), F.count("in_ref").alias("n_shared"))
    sizes = categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n_ref"))
    psi = join_on(psi, changed, [*by, "feature"], "left").join(sizes, "feature", "left")
    psi = psi.withColumns({"n_new": F.col("n_seen") - F.col("n_shared"), "n_missing": F.col("n_ref") - F.coalesce("n_shared", F.lit(0))})
    return psi.select(*by, "feature", "psi", "n_current", F.coalesce("n_new", F.lit(0)).alias("n_new_categories"),
                      F.coalesce("n_missing", F.lit(0)).alias("n_missing_categories"), psi_severity(F.col("psi")).alias("severity"))


def category_changes(categories: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Categories that are new or missing, on the full sets: rows (by, feature, category, change)."""
    ref = categories.select("feature", "category").distinct()
    cur = current.select(*by, "feature", "category").distinct()
    known_features = ref.select("feature").distinct()
    new = cur.join(known_features, "feature", "left_semi").join(ref, ["feature", "category"], "left_anti")
    groups = cur.select(*by, "feature").distinct()
    expected = groups.join(ref, "feature") if by else ref
    missing = expected.join(cur, [*by, "feature", "category"], "left_anti")
    cols = [*by, "feature", "category"]
    return new.select(*cols, F.lit("new").alias("change")).unionByName(missing.select(*cols, F.lit("missing").alias("change")))


def _value_counts(long: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """How often each value occurs per (by, feature), as column ``name``."""
    return long.where(F.col("value").isNotNull()).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias(name))


def ecdf_runs(reference: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct current values per (by, feature) with the running counts of both sides.

    ``reference`` holds rows (feature, value) or counted values (feature, value, r). It is ordered once
    for all batches, with the values that batches look up in it, and never repeated per batch.
    """
    r = reference if "r" in reference.columns else _value_counts(reference, [], "r")
    c = materialized(_value_counts(current, by, "c"))
    asked = c.select("feature", "value").distinct().select("feature", "value", F.lit(0).cast("long").alias("r"))
    both = r.select("feature", "value", "r").unionByName(asked).groupBy("feature", "value").agg(F.sum("r").alias("r"))
    known = running_totals(both, [asc("value")], {"r": F.col("r")}, ["feature"], ["value"])
    mine = running_totals(c, [asc("value")], {"c": F.col("c")}, [*by, "feature"], ["value"])
    return mine.join(known, ["feature", "value"])


def ks_two_sample(reference: DataFrame, current: DataFrame, by: Sequence[str] = (),
                  runs: DataFrame | None = None, exact_rows: int = EXACT_KS_ROWS) -> DataFrame:
    """Largest ECDF gap per (by, feature), its p-value and the current median.

    The p-value is exact (for samples without ties) where both have at most ``exact_rows`` rows, asymptotic beyond.

    The gap is largest at a current value or just before one, so the exact statistic needs nothing else.
    """
    runs = runs if runs is not None else ecdf_runs(reference, current, by)
    r, c = F.nullif(F.col("total_r"), F.lit(0)), F.col("total_c")
    gap = F.greatest(F.abs(F.col("cum_r") / r - F.col("cum_c") / c),
                     F.abs((F.col("cum_r") - F.col("r")) / r - (F.col("cum_c") - F.col("c")) / c))

    def at(index):  # the current value at a 0-based position
        return F.max(F.when(index.between(F.col("cum_c") - F.col("c"), F.col("cum_c") - 1), F.col("value")))

    middle = (F.col("total_c") - 1) / 2.0
    d = runs.groupBy(*by, "feature").agg(
        F.max("total_r").alias("n_reference"), F.max("total_c").alias("n_current"), F.max(gap).alias("d"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2.0).alias("current_median"))
    enough = (F.col("n_reference") > 1) & (F.col("n_current") > 1)
    return d.select(*by, "feature", "n_reference", "n_current", F.when(enough, F.col("d")).alias("ks_statistic"),
                    F.when(enough, two_sample_p(F.col("d"), F.col("n_reference"), F.col("n_current"), exact_rows)).alias("ks_p_value"),
                    "current_median")


# ---- reports -------------------------------------------------------------------------

def drift_signals(profile: ReferenceProfile, batch: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  by: Sequence[str] = (), decision: str | None = "decision", ks: bool = True,
                  medians: bool = False, exact_rows: int = EXACT_KS_ROWS) -> DataFrame:
    """One row per (by, signal): PSI, severity and what goes with it.

    Current medians come with ``ks``, or alone with ``medians``; without either the batches aren't ordered.
    """
    long = melt_numeric(batch, numeric, by)
    num = numeric_psi(profile.bins, long, by, medians=medians and not ks)
    ref = profile.stats.select("feature", "kind", F.col("mean").alias("reference_mean"), F.col("median").alias("reference_median"))
    num = num.join(F.broadcast(ref), "feature")
    if ks:
        num = join_on(num, ks_two_sample(profile.values, long, by, exact_rows=exact_rows).drop("n_reference", "n_current"), [*by, "feature"], "left")
    num = num.withColumnRenamed("feature", "signal")
    out = num
    if categorical:
        cat = categorical_psi(profile.categories, melt_categorical(batch, categorical, by), by)
        out = out.unionByName(cat.withColumnRenamed("feature", "signal").withColumn("kind", F.lit("categorical")),
                              allowMissingColumns=True)
    if decision and decision in batch.columns:
        dec = categorical_psi(profile.decisions, melt_decisions(batch, decision, by), by)
        out = out.unionByName(dec.withColumnRenamed("feature", "signal").withColumn("kind", F.lit("decision")),
                              allowMissingColumns=True)
    return out


def drift_report(signals: DataFrame, batch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per batch: worst severity, the signals behind it, low-confidence flag, warnings."""
    sizes = (batch.groupBy(*by) if by else batch.groupBy()).agg(F.count(F.lit(1)).alias("batch_rows"))
    rank = severity_rank(F.col("severity"))
    new_cats = F.when(F.coalesce("n_new_categories", F.lit(0)) > 0, F.concat(
        F.col("signal"), F.lit(": "), F.col("n_new_categories").cast("string"), F.lit(" new category value(s)")))
    grouped = signals.groupBy(*by) if by else signals.groupBy()
    # one row per monitored signal: these lists are as long as the feature list
    worst = grouped.agg(F.max(rank).alias("w"), F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("signal").alias("s")))).alias("all"),
                        F.array_join(F.sort_array(F.collect_list(new_cats)), "; ").alias("warnings"))
    names = F.array_join(F.transform(F.filter("all", lambda x: x["r"] == F.col("w")), lambda x: x["s"]), ",")
    worst = worst.select(*by, F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce("w", F.lit(0)).cast("int")).alias("overall_severity"),
                         names.alias("contributing_signals"), "warnings")
    if by:
        out = join_on(sizes, worst, by, "left")
    else:
        out = beside(sizes, worst)
    return out.select(*by, "batch_rows", (F.col("batch_rows") < MIN_BATCH_ROWS).alias("low_confidence"),
                      F.coalesce("overall_severity", F.lit(SEVERITIES[0])).alias("overall_severity"),
                      F.coalesce("contributing_signals", F.lit("")).alias("contributing_signals"),
                      F.coalesce("warnings", F.lit("")).alias("warnings"))


def drift_history(reports: DataFrame, time: str) -> DataFrame:
    """Batches analysed, count per severity and the latest status (R9), one row."""
    return reports.agg(
        F.count(F.lit(1)).alias("batches_analysed"),
        *[count_if(F.col("overall_severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
        F.max_by("overall_severity", time).alias("latest_status"))
