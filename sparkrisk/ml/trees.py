"""Exact TreeSHAP of boosted trees in polynomial time, on executors (M9).

A feature outside a coalition follows the training rows (path-dependent TreeSHAP, Lundberg et al.). On the way to
a leaf a feature j lets a share z_j of the rows through when it is unknown, and all (o_j = 1) or none (0) when it is
known. Coalitions of s known features then sum up to the coefficient of t^s in the product of (z_j + o_j t); leaving
one feature out is a division by its factor. So a leaf with d features costs d^2 steps a row, not 2^d.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Booster, Tree

#: Rows that are explained at a time.
ROWS = 2048


def _leaves(tree: Tree) -> list[tuple[int, list[tuple[int, bool]]]]:
    """Every leaf and its way from the root: (node, went left)."""
    out, held = [], [(0, [])]
    while held:
        node, way = held.pop()
        if tree.feature[node] < 0:
            out.append((node, way))
        else:
            held += [(tree.left[node], [*way, (node, True)]), (tree.right[node], [*way, (node, False)])]
    return out


def _shares(tree: Tree, way: list[tuple[int, bool]]) -> dict[int, float]:
    """Share of the training rows that each feature of a way lets through."""
    out: dict[int, float] = {}
    for node, left in way:
        child = tree.left[node] if left else tree.right[node]
        out[tree.feature[node]] = out.get(tree.feature[node], 1.0) * tree.cover[child] / tree.cover[node]
    return out


def expected_value(tree: Tree) -> float:
    return sum(tree.value[leaf] * math.prod(_shares(tree, way).values()) for leaf, way in _leaves(tree))


def tree_shap(tree: Tree, bins: np.ndarray, phi: np.ndarray) -> None:
    """Add each row's contributions by feature to ``phi``."""
    inner = [k for k, f in enumerate(tree.feature) if f >= 0]
    went = {k: tree.goes_left(k, bins) for k in inner}
    for leaf, way in _leaves(tree):
        shares = _shares(tree, way)
        if not shares or tree.value[leaf] == 0:
            continue
        known = {f: np.ones(len(bins), dtype=bool) for f in shares}
        for node, left in way:
            known[tree.feature[node]] &= went[node] == left
        d = len(shares)
        product = np.zeros((d + 1, len(bins)))
        product[0] = 1.0
        for k, (f, z) in enumerate(shares.items()):
            product[1:k + 2] = product[1:k + 2] * z + product[:k + 1] * known[f]
            product[0] *= z
        weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        for f, z in shares.items():
            o = known[f]
            # divided by (z + t) from the top where the feature is met, by z where it isn't
            total, rest = np.zeros(len(bins)), np.zeros(len(bins))
            for s in range(d - 1, -1, -1):
                rest = product[s + 1] - z * rest if s < d - 1 else product[d]
                total += weight[s] * np.where(o, rest, product[s] / z)
            phi[:, f] += tree.value[leaf] * (o - z) * total


def contributions(booster: Booster, bins: np.ndarray) -> np.ndarray:
    """Contributions (row, feature) of all trees."""
    phi = np.zeros((len(bins), len(booster.bins.names)))
    for a in range(0, len(bins), ROWS):
        for t in booster.trees:
            tree_shap(t, bins[a:a + ROWS], phi[a:a + ROWS])
    return phi


def top_of(phi: np.ndarray, names: Sequence[str], top: int) -> np.ndarray:
    """Places (row, top) of the largest contributions by absolute value, ties by name."""
    by_name = np.argsort(np.asarray(names))
    order = np.argsort(-np.abs(phi[:, by_name]), axis=1, kind="stable")[:, :top]
    return by_name[order]


def shap_contributions(df: DataFrame, booster: Booster, keep: Sequence[str], top: int = 5) -> DataFrame:
    """Per row: ``margin``, ``base_value``, ``total_contribution`` and the features of largest absolute contribution (M9).

    All contributions plus the base value add up to the margin; the score is never changed. Column ``contributions`` is an
    array of (feature, contribution), largest first; no others leave the worker.
    """
    names, n, bins = booster.bins.names, len(keep), booster.bins
    base = booster.start + sum(expected_value(t) for t in booster.trees)

    def run(batches):
        label = pa.array(names)
        for batch in batches:
            b = bins.of(batch, n)
            phi = contributions(booster, b)
            margin = booster.start + sum(t.margins(b) for t in booster.trees) if booster.trees else np.full(len(b), booster.start)
            best = top_of(phi, names, top)
            pairs = pa.StructArray.from_arrays([label.take(pa.array(best.ravel())), pa.array(np.take_along_axis(phi, best, axis=1).ravel())], names=["feature", "contribution"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * best.shape[1]), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(margin), pa.array(np.full(len(b), base)), pa.array(phi.sum(1)), lists],
                                             names=[*batch.schema.names[:n], "margin", "base_value", "total_contribution", "contributions"])
    booster = Booster(booster.bins, booster.trees, booster.start)  # without its table of rounds, which belongs to the driver
    source = df.select(*[F.col(f"`{c}`") for c in keep], *bins.columns())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
    return source.mapInArrow(run, f"{fields}, margin double, base_value double, total_contribution double, contributions array<struct<feature:string,contribution:double>>")


def top_contributions(phi, names: list[str], top: int):
    """The ``top`` largest by absolute value as an array of (feature, contribution) (T4)."""
    pairs = F.zip_with(F.array(*[F.lit(n) for n in names]), phi, lambda f, v: F.struct(
        (-F.abs(v)).alias("order"), f.alias("feature"), v.alias("contribution")))
    return F.transform(F.slice(F.array_sort(pairs), 1, top), lambda p: F.struct(
        p["feature"].alias("feature"), p["contribution"].alias("contribution")))
