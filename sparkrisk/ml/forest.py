"""Isolation forest: trees grown from small hash samples in parallel, all rows scored (M7)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.session import materialized

EULER = 0.5772156649015329
NODE_FIELDS = "tree int, node int, feature int, threshold double, left int, right int, size int"


def expected_path(n) -> np.ndarray:
    """Average unsuccessful search length of a binary tree over n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def train_isolation_forest(df: DataFrame, id_col: str, features_col: str = "features", n_trees: int = 100,
                           sample_rows: int = 256, feature_share: float = 1.0, seed: int = 42) -> DataFrame:
    """Node table of the forest; ``features_col`` is an array of numbers without NULLs.

    Every tree draws its rows by hash, so a tree's group holds about ``sample_rows`` rows
    whatever the size of the table; one scan feeds all trees.
    """
    n = df.count()
    if n == 0:
        raise ValueError("train_isolation_forest: no rows")
    share = min(1.0, (sample_rows + 8.0 * math.sqrt(sample_rows)) / n)
    width = len(df.select(features_col).first()[0])
    bound = 2 ** 53

    def draw(t):
        return F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(bound))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < F.lit(int(share * bound)))
    drawn = df.select(F.col(id_col), F.col(features_col).cast("array<double>").alias("x"), F.explode(trees).alias("tree"))
    drawn = drawn.select("tree", "x", draw(F.col("tree")).alias("h"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("h", ignore_index=True).head(sample_rows)
        x = np.stack(pdf["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        allowed = np.sort(rng.choice(width, max(1, int(feature_share * width)), replace=False))
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes = []

        def split(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append(None)
            spread = x[rows][:, allowed]
            usable = allowed[spread.max(axis=0) > spread.min(axis=0)]
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                nodes[me] = (tree, me, -1, 0.0, -1, -1, len(rows))
                return me
            f = int(rng.choice(usable))
            v = x[rows, f]
            t = float(rng.uniform(v.min(), v.max()))
            right = v > t
            if not right.any():
                right = v >= v.max()
            nodes[me] = (tree, me, f, t if (v[~right] <= t).all() else float(v[~right].max()),
                         split(rows[~right], depth + 1), split(rows[right], depth + 1), len(rows))
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, NODE_FIELDS)


def anomaly_score(df: DataFrame, forest: DataFrame, keep: Sequence[str], features_col: str = "features",
                  score: str = "anomaly_score", sample_rows: int = 256) -> DataFrame:
    """2^(-mean path / c(sample)): near 1 is anomalous. The forest is trees x 2 x sample rows."""
    keep = list(keep)
    nodes = forest.orderBy("tree", "node").toPandas()
    trees = [{c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size")} for _, g in nodes.groupby("tree")]
    norm = float(expected_path(max(int(t["size"][0]) for t in trees)))
    source = df.select(*keep, F.col(features_col).cast("array<double>").alias("__x"))

    def run(batches):
        for pdf in batches:
            total = np.zeros(len(pdf))
            if len(pdf):
                x = np.stack(pdf["__x"].to_numpy())
                rows = np.arange(len(x))
                for t in trees:
                    at, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
                    while True:
                        f = t["feature"][at]
                        inner = f >= 0
                        if not inner.any():
                            break
                        left = x[rows, np.maximum(f, 0)] <= t["threshold"][at]
                        at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
                        depth += inner
                    total += depth + expected_path(t["size"][at])
            out = pdf[keep].copy()
            out[score] = np.power(2.0, -total / len(trees) / norm) if norm > 0 else np.full(len(pdf), 0.5)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return source.mapInPandas(run, f"{fields}, {score} double")


def choose_forest(train: DataFrame, val: DataFrame, id_col: str, configurations: Sequence[dict], label: str = "label",
                  features_col: str = "features") -> tuple[DataFrame, list]:
    """The forest of the configuration with the best average precision on ``val`` (M7), and all their values.

    Configurations are keyword arguments of ``train_isolation_forest``; of equals the first is taken.
    """
    from ..operators.ranking import ranking_metrics
    tried = []
    for options in configurations:
        grown = materialized(train_isolation_forest(train, id_col, features_col, **options))
        scored = anomaly_score(val, grown, [id_col, label], features_col)
        value = ranking_metrics(scored, "anomaly_score", label, strict=False).first()["average_precision"]
        tried.append((grown, options, value))
    best = max(tried, key=lambda t: -1.0 if t[2] is None else t[2])
    return best[0], [(options, value) for _, options, value in tried]
