"""Column expressions shared by batch and stream."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values: names and limits that downstream users rely on -----------
APPROVE, REVIEW, BLOCK = "APPROVE", "REVIEW", "BLOCK"
DECISIONS = [APPROVE, REVIEW, BLOCK]
SEVERITIES = ["NO_SIGNIFICANT_DRIFT", "LOW_DRIFT", "MODERATE_DRIFT", "HIGH_DRIFT"]
PSI_LOW, PSI_MODERATE, PSI_HIGH = 0.10, 0.20, 0.30
PSI_FLOOR = 1e-4
MISSING, UNSEEN, OTHER = "__missing__", "__unseen__", "__OTHER__"
# -----------------------------------------------------------------------------

MICROS = 1_000_000


def ratio(a, b) -> Column:
    """a / b as double; NULL when b is 0 or either side is NULL (ANSI mode would raise)."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number and lets it spoil averages; use NULL instead."""
    return F.when(~F.isnan(c), c)


def as_number(c: Column) -> Column:
    """Double, or NULL when the text is not a number."""
    return c.try_cast("double")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def time_axis(df: DataFrame, name: str) -> tuple[Column, int]:
    """A numeric time column and its units per second.

    Timestamps become long microseconds since the epoch (wall clock for NTZ values, whatever
    the session time zone), fractional seconds become long microseconds, whole numbers are taken
    as seconds, unchanged. Whole units keep every window bound exact.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT"):
            c = F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
        return F.unix_micros(c.cast("timestamp")), MICROS
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), MICROS
    if isinstance(dtype, T.FractionalType):
        return F.round(c * MICROS).cast("long"), MICROS
    if isinstance(dtype, T.IntegralType):
        return c, 1
    raise ValueError(f"{name}: a time column must be numeric or a timestamp, not {dtype}")


@dataclass(frozen=True)
class DecisionPolicy:
    """score < approve -> APPROVE, < block -> REVIEW, else BLOCK (equal thresholds allowed)."""

    approve_threshold: float
    block_threshold: float
    name: str = "policy"

    def __post_init__(self):
        for v in (self.approve_threshold, self.block_threshold):
            if isinstance(v, bool) or not isinstance(v, (int, float)) or math.isnan(v):
                raise ValueError("thresholds must be numbers")
            if not 0 <= v <= 1:
                raise ValueError("thresholds must lie in [0, 1]")
        if self.approve_threshold > self.block_threshold:
            raise ValueError("approve_threshold must not exceed block_threshold")

    def to_dict(self) -> dict:
        return {"approve_threshold": self.approve_threshold,
                "block_threshold": self.block_threshold, "name": self.name}

    @classmethod
    def from_dict(cls, d: dict) -> "DecisionPolicy":
        return cls(d["approve_threshold"], d["block_threshold"], d.get("name", "policy"))


def decide(score: Column, approve, block) -> Column:
    """Three-way decision; a missing score is an error, never a silent approval."""
    approve = approve if isinstance(approve, Column) else F.lit(float(approve))
    block = block if isinstance(block, Column) else F.lit(float(block))
    bad = score.isNull() | F.isnan(score)
    return (F.when(bad, F.raise_error(F.lit("decide: score is NULL or NaN")))
            .when(score < approve, F.lit(APPROVE))
            .when(score < block, F.lit(REVIEW))
            .otherwise(F.lit(BLOCK)))


def psi_severity(psi: Column) -> Column:
    return (F.when(psi < PSI_LOW, SEVERITIES[0]).when(psi < PSI_MODERATE, SEVERITIES[1])
            .when(psi < PSI_HIGH, SEVERITIES[2]).otherwise(SEVERITIES[3]))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def unit_bin(score: Column, bins: int) -> Column:
    """Equal-width bin of [0, 1]; 1.0 falls into the last bin."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def bin_label(index: Column, bins: int = 10) -> Column:
    return F.format_string("%.1f-%.1f", index / F.lit(float(bins)), (index + 1) / F.lit(float(bins)))


def same_within(a: Column, b: Column, tolerance: float) -> Column:
    """NULL equals NULL, NULL differs from a value, numbers match up to the tolerance."""
    return (F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False)
            .otherwise(F.abs(a - b) <= tolerance))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    lam2 = d * d * ratio(n.cast("double") * m, n + m)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)),
                        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(d <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


#: Rows of the larger sample up to which the two-sample p-value is exact.
EXACT_KS_ROWS = 10_000


def exact_kolmogorov_p(d: float, n: int, m: int) -> float:
    """Chance that two samples of one distribution without ties lie at least ``d`` apart.

    A random order of both samples is a random way over a lattice; what leaves the band |i/n - j/m| < d is added up where it
    leaves, so small values keep their digits. One step for each of the n + m values, over the width of the band.
    """
    h = round(d * n * m)
    if h <= 0:
        return 1.0
    held, out, low = np.array([1.0]), 0.0, 0  # chances of the places i = low, low + 1, … after k steps
    for k in range(n + m):
        i = np.arange(low, low + len(held))
        left = n + m - k
        new = np.zeros(len(held) + 1)
        new[:-1] += held * (m - (k - i)) / left
        new[1:] += held * (n - i) / left
        i = np.arange(low, low + len(new))
        inside = np.abs(i * m - (k + 1 - i) * n) < h
        out += float(new[~inside].sum())
        if not inside.any():
            break
        first, last = int(inside.argmax()), len(inside) - int(inside[::-1].argmax())
        held, low = new[first:last], low + first
    return min(1.0, out)


@F.pandas_udf(T.DoubleType())
def _exact_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else exact_kolmogorov_p(float(x), int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")


def two_sample_p(d: Column, n: Column, m: Column, exact_rows: int = EXACT_KS_ROWS) -> Column:
    """Exact p-value where neither sample has more than ``exact_rows`` rows, asymptotic beyond. One value per batch and feature."""
    small = F.greatest(n, m) <= exact_rows
    return F.when(small, _exact_p(F.when(small, d), n, m)).otherwise(kolmogorov_p(d, n, m)) if exact_rows else kolmogorov_p(d, n, m)
