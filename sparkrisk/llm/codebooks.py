"""Vector code compression: product codebooks by Lloyd rounds over partition-local cover trees.

Vectors are whole numbers, cut into equal parts. Each block of vectors builds one cover tree per part, once. A node
has a centre, a radius that no point below it exceeds, and its points are a run of the tree's order, so their sum is a
difference of two cumulative sums. In a round, a node whose nearest entry is nearer than any other by more than
twice its radius gives its whole run to that entry (triangle inequality); other nodes pass the question to their
children, and what is left at the leaves is compared exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import materialized

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of one tree, and points below which a node has no children.
BLOCK_ROWS, LEAF = 2048, 8
_TREE = "part int, block long, points binary, rows binary, nodes binary"
#: first and last point (exclusive), position of the centre, first and last child (exclusive), radius
NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("centre", "<i4"), ("child", "<i4"), ("last", "<i4"), ("radius", "<f8")])


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component in double precision, or null: for a null vector, one that holds a null or
    non-finite component, and one whose squared distances might pass 63 bits."""
    most = F.lit(2.0 ** 29) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(scale * x.cast("double")) < most))
    return F.when(fine, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all others, exact in whole numbers."""
    out = np.zeros((len(points), len(others)), dtype=np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - others[None, :, k]) ** 2
    return out


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and the nodes. Children of a node of radius r have radius r / 2 at most, and their
    centres, taken from the points one by one, are more than r / 2 apart."""
    order = np.arange(len(points))
    nodes: list[list] = []

    def reach(a: int, b: int) -> float:
        far = points[order[a:b]] - points[order[a]]
        return float(np.sqrt((far * far).sum(1).max()))
    nodes.append([0, len(points), 0, 0, 0, reach(0, len(points))])
    at = 0
    while at < len(nodes):
        start, stop, _, _, _, radius = nodes[at]
        if stop - start > LEAF and radius > 0:
            rest = order[start:stop]  # its first point is the centre, and the first child's too
            runs = []
            while len(rest):
                far = points[rest] - points[rest[0]]
                near = np.sqrt((far * far).sum(1)) <= radius / 2
                runs.append(rest[near])
                rest = rest[~near]
            order[start:stop] = np.concatenate(runs)
            nodes[at][3:5] = len(nodes), len(nodes) + len(runs)
            for run in runs:
                nodes.append([start, start + len(run), start, 0, 0, reach(start, start + len(run))])
                start += len(run)
        at += 1
    return order, np.array([tuple(n) for n in nodes], dtype=NODE)


def _trees(parts: int):
    """Each block's trees, one row per part: points in the tree's order, their rows within the block, nodes."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.int64)
        at, width, out = rows["at"].to_numpy(np.int64), v.shape[1] // parts, []
        for p in range(parts):
            order, nodes = cover_tree(v[:, p * width:(p + 1) * width])
            out.append((p, int(rows["block"].iloc[0]), v[order, p * width:(p + 1) * width].tobytes(), at[order].tobytes(), nodes.tobytes()))
        return pd.DataFrame(out, columns=["part", "block", "points", "rows", "nodes"])
    return build


def nearest(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entry (ties: lowest index) of each point of a tree."""
    out = np.zeros(len(points), dtype=np.int64)
    ask = np.arange(min(1, len(nodes)))
    while len(ask):
        node = nodes[ask]
        far = np.sqrt(_squares(points[node["centre"]], entries).astype(float))
        best = far.argmin(1)
        two = np.partition(far, 1, axis=1)[:, 1] if far.shape[1] > 1 else np.full(len(ask), np.inf)
        one = far[np.arange(len(ask)), best]
        # room for the rounding of roots and of large squares; a close call is settled below
        sure = two - one > 2 * node["radius"] + 1e-6 + 1e-9 * (one + node["radius"])
        for start, stop, entry in zip(node["start"][sure], node["stop"][sure], best[sure]):
            out[start:stop] = entry
        open_ = node[~sure]
        leaf = open_[open_["child"] == open_["last"]]
        if len(leaf):
            at = np.concatenate([np.arange(a, b) for a, b in zip(leaf["start"], leaf["stop"])])
            out[at] = _squares(points[at], entries).argmin(1)
        inner = open_[open_["child"] < open_["last"]]
        ask = np.concatenate([np.arange(a, b) for a, b in zip(inner["child"], inner["last"])]) if len(inner) else ask[:0]
    return out


def _unpacked(rows: pd.DataFrame, width: int) -> Iterator[tuple]:
    for part, points, at, nodes in zip(rows["part"], rows["points"], rows["rows"], rows["nodes"]):
        yield part, np.frombuffer(points, dtype=np.int64).reshape(-1, width), np.frombuffer(at, dtype=np.int64), np.frombuffer(nodes, dtype=NODE)


def _sums(books: np.ndarray):
    """Of each tree, sum and number of each entry's points, from runs of the cumulative sums."""
    def run(batches):
        for rows in batches:
            out = []
            for part, points, _, nodes in _unpacked(rows, books.shape[2]):
                entry = nearest(points, nodes, books[part])
                total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
                edge = np.flatnonzero(np.diff(entry, prepend=-1))
                runs = total[np.append(edge[1:], len(entry))] - total[edge]
                for e in np.unique(entry[edge]):
                    mine = entry[edge] == e
                    out.append((part, int(e), int(np.append(edge[1:], len(entry))[mine].sum() - edge[mine].sum()), runs[mine].sum(0)))
            yield pd.DataFrame(out, columns=["part", "entry", "n", "sums"])
    return run


def _codes(books: np.ndarray):
    def run(batches):
        for rows in batches:
            for part, points, at, nodes in _unpacked(rows, books.shape[2]):
                entry = nearest(points, nodes, books[part])
                error = ((points - books[part][entry]) ** 2).sum(1)
                yield pd.DataFrame({"at": at, "part": part, "entry": entry, "error": error})
    return run


def train(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after some rounds; the driver sees one row per part and entry each time."""
    for _ in range(rounds):
        partial = trees.mapInPandas(_sums(books), "part int, entry int, n long, sums array<long>")
        # sums of very many components may pass 64 bits
        total = partial.select("part", "entry", "n", F.posexplode("sums").alias("c", "s")).groupBy("part", "entry", "c").agg(
            F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        books = books.copy()
        for r in total.collect():
            books[r["part"], r["entry"], r["c"]] = int(r["s"]) // r["n"]
    return books


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
               entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The id, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256`` of every vector that has whole numbers.

    Dropped are vectors that ``whole_numbers`` has none for, empty ones, those whose length isn't a multiple of the number of
    parts, and those of another length than the first one (the least id, nulls last). The codebooks begin as the
    ``entries`` first vectors, all of them if there are fewer; equal ids go by their components. Repeated rows count each.
    Labels may be of any type; nulls are one label. Trees are written once; every round reads them and nothing else.
    """
    v = whole_numbers(F.col(f"`{vector}`"))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    rows = materialized(rows.withColumn("at", F.monotonically_increasing_id()))
    order = [F.col("id").isNull(), F.col("id"), F.col("v")]
    head = rows.orderBy(*order).select("v").limit(1).collect()
    width = len(head[0]["v"]) if head else parts
    rows = rows.where(F.size("v") == width)
    first = rows.orderBy(*order).select("v").limit(entries).collect()  # that many rows, whatever the table holds
    books = np.array([[r["v"][p * width // parts:(p + 1) * width // parts] for r in first] for p in range(parts)], dtype=np.int64).reshape(parts, len(first), width // parts)
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select("at", "v", F.pmod(F.xxhash64("at"), F.lit(blocks)).alias("block"))
    trees = materialized(dealt.groupBy("block").applyInPandas(_trees(parts), _TREE))
    books = train(trees, books, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    found = trees.mapInPandas(_codes(books), "at long, part int, entry int, error long")
    codes = F.array_sort(F.collect_list(F.struct("part", "entry")))
    hexed = F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0"))), "")
    found = found.groupBy("at").agg(hexed.alias("code"), F.sum("error").alias("error"))
    coded = materialized(rows.select("at", "id", "label").join(found, "at"))
    by_label = materialized(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
