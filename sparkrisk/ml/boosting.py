"""Gradient boosting on histograms (M5), with missing values and category subsets inside the split (M2).

Features become bins once: bin 0 is a missing value, numbers have the bins between their cut points, categories
one bin each and one for all others. Every boosting round grows one tree leaf by leaf. What a split needs are sums of
gradients and hessians by (node, feature, bin): tasks add up their own rows in arrays, one grouped aggregation adds up
the tasks, and each feature's best split is found where its sums arrive. Rows never move; the driver holds
trees, and one candidate per open node and feature.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.session import materialized
from ..operators.ranking import ranking_metrics

# --- fixed values: the reference's training parameters ---------------------------------------
LEARNING_RATE, LEAVES, LEAST_ROWS = 0.05, 31, 50
L1, L2, FEATURE_SHARE, ROW_SHARE = 0.1, 0.1, 0.8, 0.8
ROUNDS, PATIENCE = 1000, 50
# ---------------------------------------------------------------------------------------------
MAX_BINS, CATEGORY_SMOOTH, LEAST_HESSIAN = 255, 10.0, 1e-3
#: Rounds between two evaluations; their margins are kept in one column, and the next rounds begin there.
ROUNDS_A_STEP = 10


@dataclass(frozen=True)
class Params:
    rounds: int = ROUNDS
    leaves: int = LEAVES
    rate: float = LEARNING_RATE
    least_rows: int = LEAST_ROWS
    l1: float = L1
    l2: float = L2
    feature_share: float = FEATURE_SHARE
    row_share: float = ROW_SHARE
    category_smooth: float = CATEGORY_SMOOTH
    patience: int = PATIENCE
    seed: int = 42


# ---- bins ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Cut points of numbers (bin b holds cut[b-2] < x <= cut[b-1]) and categories (bin b is category b-1, the last bin any other)."""

    numeric: tuple
    categorical: tuple
    cuts: dict
    categories: dict

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def size(self, f: int) -> int:
        name = self.names[f]
        return len(self.cuts[name]) + 2 if name in self.cuts else len(self.categories[name]) + 2

    def columns(self) -> list:
        return [F.col(f"`{c}`").cast("double").alias(f"__n{i}") for i, c in enumerate(self.numeric)] + [
            F.col(f"`{c}`").cast("string").alias(f"__c{i}") for i, c in enumerate(self.categorical)]

    def of(self, batch: pa.RecordBatch, first: int) -> np.ndarray:
        """Bins (row, feature) of the feature columns of a batch, which begin at column ``first``."""
        out = np.zeros((batch.num_rows, len(self.names)), dtype=np.uint16)
        for k, name in enumerate(self.names):
            column = batch.column(first + k)
            if name in self.cuts:
                x = np.asarray(column.to_pandas(), dtype=float)
                found = np.searchsorted(np.asarray(self.cuts[name]), x, side="left") + 1
                out[:, k] = np.where(np.isnan(x), 0, found)
            else:
                place = {c: i + 1 for i, c in enumerate(self.categories[name])}
                other = len(place) + 1
                codes = column.dictionary_encode()
                known = np.array([place.get(c, other) for c in codes.dictionary.to_pylist()] + [0], dtype=np.uint16)
                out[:, k] = known[codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)]
        return out


def fit_bins(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), max_bins: int = MAX_BINS) -> Bins:
    """Cut points from the train rows: all distinct values where they are few, quantiles otherwise; of categories the
    most frequent ones, in sorted order. At most ``max_bins`` each, so the driver's share is bounded."""
    cuts = {c: [] for c in numeric}
    if numeric:
        probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        row = train.agg(*[a for i, c in enumerate(numeric) for a in (
            F.percentile_approx(x(c), probs, 20 * max_bins).alias(f"q{i}"), F.approx_count_distinct(x(c)).alias(f"d{i}"))]).first()
        few = [c for i, c in enumerate(numeric) if row[f"d{i}"] < max_bins * 0.8]
        exact = train.agg(*[F.array_sort(F.collect_set(x(c))).alias(f"s{i}") for i, c in enumerate(few)]).first() if few else None
        for i, c in enumerate(numeric):
            values = exact[f"s{few.index(c)}"] if c in few else sorted(set(row[f"q{i}"] or []))
            cuts[c] = values[:-1] if c in few else values  # nothing is above the largest value
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("string").alias("v")) for c in categorical])
    vocabulary: dict[str, list] = {c: [] for c in categorical}
    if categorical:
        counts = train.select(F.explode(cells).alias("c")).where("c.v is not null").groupBy("c.f", "c.v").agg(F.count("*").alias("n"))
        counts = materialized(counts)
        for c in categorical:
            top = counts.where(F.col("f") == c).orderBy(F.desc("n"), "v").limit(max_bins).collect()
            vocabulary[c] = sorted(r["v"] for r in top)
    return Bins(tuple(numeric), tuple(categorical), cuts, vocabulary)


# ---- trees -----------------------------------------------------------------------------------

@dataclass
class Tree:
    """Node arrays. An inner node sends a row left if its bin is marked in ``left_bins`` (missing values have bin 0)."""

    feature: list = field(default_factory=lambda: [-1])
    left_bins: list = field(default_factory=lambda: [None])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, best: dict) -> tuple[int, int]:
        self.feature[node], self.left_bins[node], self.gain[node] = best["feature"], best["left_bins"], best["gain"]
        for side in ("left", "right"):
            getattr(self, side)[node] = len(self.feature)
            for column, v in ((self.feature, -1), (self.left_bins, None), (self.left, -1), (self.right, -1),
                              (self.value, best[f"{side}_value"]), (self.cover, best[f"{side}_rows"]), (self.gain, 0.0)):
                column.append(v)
        return self.left[node], self.right[node]

    def goes_left(self, node: int, bins: np.ndarray) -> np.ndarray:
        marks, own = self.left_bins[node], bins[:, self.feature[node]].astype(np.int64)
        return marks[np.minimum(own, len(marks) - 1)]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; every node looks at its own rows only."""
        out = np.zeros(len(bins), dtype=np.int64)
        held = {0: np.arange(len(bins))}
        while held:
            node, rows = held.popitem()
            if self.feature[node] < 0:
                out[rows] = node
                continue
            left = self.goes_left(node, bins[rows])
            held[self.left[node]], held[self.right[node]] = rows[left], rows[~left]
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(bins)]


def _pull(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    return _pull(g, p.l1) ** 2 / (h + p.l2 + 1e-300)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, categorical: bool, p: Params) -> dict | None:
    """Best split of one node by one feature, from sums by bin (bin 0: missing); null if none gains.

    Numbers: every cut point, missing values tried on both sides (where a node has none, they go to the side with more
    rows). Categories: in the order of gradient over hessian, so the best subset is among the beginnings.
    """
    total = np.array([g.sum(), h.sum(), n.sum()])
    if categorical:
        order = np.flatnonzero(n > 0)
        order = order[np.argsort(g[order] / (h[order] + p.category_smooth), kind="stable")]
        lefts, cuts = [np.cumsum(np.stack([g, h, n])[:, order], axis=1)[:, :-1]], len(order) - 1
    else:
        order = np.arange(1, len(n))
        below = np.cumsum(np.stack([g, h, n])[:, order], axis=1)[:, :-1]
        lefts, cuts = [below] + ([below + np.array([[g[0]], [h[0]], [n[0]]])] if n[0] else []), below.shape[1]
    if cuts <= 0:
        return None
    best = None
    for missing_left, left in enumerate(lefts):
        right = total[:, None] - left
        fine = (np.minimum(left[2], right[2]) >= p.least_rows) & (np.minimum(left[1], right[1]) >= LEAST_HESSIAN)
        gain = np.where(fine, _worth(left[0], left[1], p) + _worth(right[0], right[1], p) - _worth(total[0], total[1], p), -np.inf)
        k = int(gain.argmax())
        if gain[k] > 1e-12 and (best is None or gain[k] > best["gain"]):
            marks = np.zeros(len(n), dtype=bool)
            marks[order[:k + 1]] = True
            if not categorical:
                marks[0] = missing_left if n[0] else left[2, k] > right[2, k]
            value = lambda s: float(-_pull(s[0], p.l1) / (s[1] + p.l2 + 1e-300) * p.rate)
            best = {"gain": float(gain[k]), "left_bins": marks, "left_value": value(left[:, k]), "right_value": value(right[:, k]),
                    "left_rows": float(left[2, k]), "right_rows": float(right[2, k])}
    return best


def grow(candidates: Callable[[Tree, list[int]], dict[int, dict]], p: Params) -> Tree:
    """One tree, leaf by leaf: always the leaf of the largest gain, until there are ``leaves``.

    ``candidates`` gives the best split of nodes of a tree that holds all splits known so far. Which node is next depends
    on the children of the last, so leaves are split on trial, as far as gains are known; new nodes
    that are reached so are asked for together, and when none is unknown the trial is the tree.
    """
    known: dict[tuple, dict | None] = {}

    def trial() -> tuple[Tree, dict[int, tuple], list[int]]:
        tree, path, leaves, last = Tree(), {0: ()}, {0}, set()
        while True:
            open_ = [k for k in leaves if known.get(path[k])]
            if len(leaves) >= p.leaves or not open_:
                # a leaf that the last possible split made comes too late to be split itself
                late = last if len(leaves) >= p.leaves else set()
                return tree, path, [k for k in sorted(leaves - late) if path[k] not in known]
            node = max(open_, key=lambda k: (known[path[k]]["gain"], -k))
            left, right = tree.split(node, known[path[node]])
            path[left], path[right] = (*path[node], 0), (*path[node], 1)
            leaves, last = leaves - {node} | {left, right}, {left, right}
    while True:
        tree, path, asked = trial()
        if not asked:
            return tree
        found = candidates(tree, asked)
        known |= {path[k]: found.get(k) for k in asked}


# ---- training --------------------------------------------------------------------------------

def _mixed(x: np.ndarray, r: int) -> np.ndarray:
    x = x.view(np.uint64) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(bins: Bins, tree: Tree, asked: list[int], features: list[int], recent: list[Tree], r: int, p: Params):
    """Sums by (node, feature, bin) of a task's train rows that this round samples."""
    sizes = [bins.size(f) for f in features]
    slot = np.full(len(tree.feature), -1)
    slot[asked] = np.arange(len(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, len(asked) * s)) for s in sizes]
        for batch in batches:
            key, y, w, margin = (np.asarray(batch.column(k)) for k in range(4))
            b = _packed(batch, 4, len(bins.names))
            use = w > 0
            if p.row_share < 1:
                use &= _mixed(key, r) < np.uint64(int(p.row_share * (1 << 64)))
            b, y, w, margin = b[use], y[use], w[use], margin[use].copy()
            at = slot[tree.nodes(b)]
            b, y, w, margin, at = (x[at >= 0] for x in (b, y, w, margin, at))
            for t in recent:
                margin += t.margins(b)
            q = 1 / (1 + np.exp(-margin))
            for s, f, size in zip(held, features, sizes):
                place = at * size + b[:, f]
                for k, weight in enumerate((w * (q - y), w * q * (1 - q), None)):
                    s[k] += np.bincount(place, weight, minlength=s.shape[1])
        rows = [(f, a, s[k].reshape(len(asked), size)[i].tolist()) for f, s, size in zip(features, held, sizes)
                for i, a in enumerate(asked) for k in range(3)]
        kinds = [k for _ in features for _ in asked for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array(kinds, pa.int32()),
                                          pa.array([x[2] for x in rows], pa.list_(pa.float64()))], names=["feature", "node", "kind", "sums"])
    return run


def _choose(bins: Bins, p: Params):
    """Best split of each node by one feature, from the tasks' sums."""
    n = len(bins.numeric)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        f = int(rows["feature"].iloc[0])
        for node, part in rows.groupby("node"):
            g, h, c = (np.sum(np.stack(part.loc[part["kind"] == k, "sums"].to_numpy()), axis=0) for k in range(3))
            best = best_split(g, h, c, f >= n, p)
            total = -_pull(g.sum(), p.l1) / (h.sum() + p.l2 + 1e-300) * p.rate
            out.append((int(node), f, best["gain"] if best else None, [bool(x) for x in best["left_bins"]] if best else None,
                        [best[k] for k in ("left_value", "right_value", "left_rows", "right_rows")] if best else None, float(total), float(c.sum())))
        return pd.DataFrame(out, columns=["node", "feature", "gain", "left_bins", "sides", "value", "rows"])
    return run


_SPLITS = "node int, feature int, gain double, left_bins array<boolean>, sides array<double>, value double, rows double"


@dataclass(frozen=True)
class Booster:
    """A trained model: bins, trees of the chosen rounds, the margin all rows begin with, and the table of rounds."""

    bins: Bins
    trees: list
    start: float
    history: DataFrame | None = None
    #: rounds that were trained at all, and the best round
    trained: int = 0

    def score(self, df: DataFrame, keep: Sequence[str], score: str = "score") -> DataFrame:
        """``keep`` columns and the probability of the positive class (M8)."""
        bins, trees, start, n = self.bins, self.trees, self.start, len(keep)

        def run(batches):
            for batch in batches:
                b = bins.of(batch, n)
                margin = np.full(len(b), start)
                for t in trees:
                    margin += t.margins(b)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(1 / (1 + np.exp(-margin)))], names=[*batch.schema.names[:n], score])
        source = df.select(*[F.col(f"`{c}`") for c in keep], *bins.columns())
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
        return source.mapInArrow(run, f"{fields}, `{score}` double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, gain, importance, rank): total gain of each feature's splits and its share (M6)."""
        gains = dict.fromkeys(self.bins.names, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.bins.names[f]] += g
        total = sum(gains.values()) or 1.0
        order = sorted(gains, key=lambda c: (-gains[c], c))
        rows = [(c, float(gains[c]), gains[c] / total, i + 1) for i, c in enumerate(order)]
        return spark.createDataFrame(rows, "feature string, gain double, importance double, rank int")

    def node_table(self, spark: SparkSession) -> DataFrame:
        """Every node: tree, node, feature, threshold (numbers), categories (on the left), missing_left, children, value, cover, gain."""
        rows = []
        for i, t in enumerate(self.trees):
            for k, f in enumerate(t.feature):
                name = self.bins.names[f] if f >= 0 else None
                marks = t.left_bins[k]
                number = f >= 0 and name in self.bins.cuts
                threshold = float(self.bins.cuts[name][int(np.flatnonzero(marks[1:]).max())]) if number else None
                left = [c for c, m in zip(self.bins.categories[name], marks[1:]) if m] if f >= 0 and not number else None
                rows.append((i, k, name, threshold, left, bool(marks[0]) if f >= 0 else None, t.left[k], t.right[k], t.value[k], t.cover[k], t.gain[k]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, categories array<string>, missing_left boolean, "
                                           "left int, right int, value double, cover double, gain double")


def _binned(df: DataFrame, bins: Bins, id_col: str, label: str, weight, start: float) -> DataFrame:
    """``key``, ``y``, ``w`` (0: validation), ``margin``, ``bins`` (two bytes a feature): all that training reads."""
    def run(batches):
        for batch in batches:
            b = np.ascontiguousarray(bins.of(batch, 3))
            width = 2 * b.shape[1]
            packed = pa.Array.from_buffers(pa.binary(width), len(b), [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(b), start)), packed], names=["key", "y", "w", "margin", "bins"])
    source = df.select(F.xxhash64(f"`{id_col}`").alias("key"), F.col(f"`{label}`").cast("double").alias("y"), weight.cast("double").alias("w"), *bins.columns())
    return source.mapInArrow(run, "key long, y double, w double, margin double, bins binary")


def _packed(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, width)


def _advanced(recent: list[Tree], width: int):
    """Margins after the recent trees."""
    def run(batches):
        for batch in batches:
            b, margin = _packed(batch, 4, width), np.asarray(batch.column(3)).copy()
            for t in recent:
                margin += t.margins(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin), batch.column(4)], names=batch.schema.names)
    return run


def _staged(recent: list[Tree], width: int, first: int):
    """A row per validation row and recent round: (stage, id, label, score)."""
    def run(batches):
        for batch in batches:
            b, margin = _packed(batch, 4, width), np.asarray(batch.column(3)).copy()
            for i, t in enumerate(recent):
                margin += t.margins(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), first + i, dtype=np.int32)), batch.column(0), batch.column(1).cast(pa.int32()),
                                                  pa.array(1 / (1 + np.exp(-margin)))], names=["stage", "id", "label", "score"])
    return run


def train(train_rows: DataFrame, val_rows: DataFrame, id_col: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label",
          positive_weight: float | None = None, params: Params = Params(), bins: Bins | None = None,
          metric: Callable[[DataFrame], DataFrame] | None = None) -> Booster:
    """Boosting rounds until validation average precision hasn't risen for ``patience`` rounds, or all are done (M5).

    Rows without a label aren't trained on. ``metric`` maps a table of (stage, id, label, score) to (stage, value), higher is better.
    Rounds are evaluated in steps of ROUNDS_A_STEP, or of ``patience`` if that is less, in one job each; after the step that
    shows the stop no further round is trained, and the trees after the best round are dropped.
    """
    spark, p = train_rows.sparkSession, params
    bins = bins or fit_bins(train_rows, numeric, categorical)
    names = [id_col, label, *dict.fromkeys([*numeric, *categorical])]
    weight = F.when(F.col(f"`{label}`") == 1, F.lit(float(positive_weight or 1.0))).otherwise(1.0)
    known = F.col(f"`{label}`").isNotNull()
    base = train_rows.where(known).agg(F.sum(F.when(F.col(f"`{label}`") == 1, weight).otherwise(0.0)).alias("p"), F.sum(weight).alias("n")).first()
    share = min(1 - 1e-9, max(1e-9, (base["p"] or 0.0) / (base["n"] or 1.0)))
    start = math.log(share / (1 - share))
    rows = materialized(_binned(train_rows.where(known).select(*names), bins, id_col, label, weight, start).unionByName(
        _binned(val_rows.where(known).select(*names), bins, id_col, label, F.lit(0.0), start)))
    width, step = len(bins.names), max(1, min(ROUNDS_A_STEP, p.patience))
    rng = np.random.default_rng(p.seed)
    trees, recent, values = [], [], {}
    best, best_value = 0, None
    for r in range(p.rounds):
        chosen = np.sort(rng.choice(width, max(1, math.ceil(p.feature_share * width)), replace=False)).tolist()
        root: dict = {}

        def candidates(tree: Tree, asked: list[int]) -> dict[int, dict]:
            sums = rows.where("w > 0").mapInArrow(_sums(bins, tree, asked, chosen, recent, r, p), "feature int, node int, kind int, sums array<double>")
            found = sums.groupBy("feature").applyInPandas(_choose(bins, p), _SPLITS).collect()  # one row per open node and feature
            out: dict[int, dict] = {}
            for row in sorted(found, key=lambda x: (x["node"], x["feature"])):
                if row["node"] == 0:
                    root.update(value=row["value"], rows=row["rows"])
                if row["gain"] is not None and (row["node"] not in out or row["gain"] > out[row["node"]]["gain"]):
                    out[row["node"]] = {"gain": row["gain"], "feature": row["feature"], "left_bins": np.array(row["left_bins"]),
                                        **dict(zip(("left_value", "right_value", "left_rows", "right_rows"), row["sides"]))}
            return out
        tree = grow(candidates, p)
        tree.value[0], tree.cover[0] = root.get("value", 0.0), root.get("rows", 0.0)
        trees.append(tree)
        recent.append(tree)
        if len(recent) < step and r < p.rounds - 1:
            continue
        staged = rows.where("w = 0").mapInArrow(_staged(recent, width, r + 2 - len(recent)), "stage int, id long, label int, score double")
        scored = metric(staged) if metric else ranking_metrics(staged, "score", "label", ["stage"], strict=False).select("stage", F.col("average_precision").alias("value"))
        for row in sorted(scored.collect(), key=lambda x: x["stage"]):  # one row per round of the step
            values[row["stage"]] = row["value"]
            if row["value"] is not None and (best_value is None or row["value"] > best_value) and (best_value is None or row["stage"] - best <= p.patience):
                best, best_value = row["stage"], row["value"]
        if best_value is not None and r + 1 - best >= p.patience:
            break
        if r < p.rounds - 1:
            rows, recent = materialized(rows.mapInArrow(_advanced(recent, width), rows.schema)), []
    best = best or len(trees)
    history = spark.createDataFrame([(s + 1, values.get(s + 1), s + 1 == best) for s in range(len(trees))], "stage int, value double, chosen boolean")
    return Booster(bins, trees[:best], start, history, len(trees))
