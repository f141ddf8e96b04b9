"""Near-duplicate vectors: an exact range join in a metric space, cell by cell.

Unit vectors with a cosine of at least c lie within the distance e = sqrt(2 - 2c). Pivots (a few of
each label's vectors) divide the vectors into cells of the nearest pivot. If y belongs to cell
B and x is within e of y, the triangle inequality gives d(x, B) - d(x, A) <= 2e for x's nearest pivot A,
so x is copied to every such B and all partners of a cell's vectors are in the cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.session import materialized
from .graph import components

COSINE = 0.93
#: Labels of more vectors have pivots: two at least, one for so many vectors, and so many at most; rows of one block.
LEAST_ROWS, ROWS_PER_PIVOT, MOST_PIVOTS, BLOCK_ROWS = 24, 2048, 64, 2048
#: Room for rounding in the distances that choose cells; pairs are decided by the cosine alone.
SLACK = 1e-6


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # very large and very small components would overflow or vanish when squared
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(reach: float):
    """For each vector of a block its cell, and a copy for every other cell that may hold partners."""
    def cells(part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c: [] for c in ("label", "width", "node", "copies", "v", "cell", "home")})
        centre = _unit(pivots.sort_values("k")["v"]) if len(pivots) else np.zeros((1, int(part["width"].iloc[0])))
        far = np.sqrt(np.maximum(0, 1 + (centre ** 2).sum(1)[None] - 2 * _unit(part["v"]) @ centre.T))
        home = far.argmin(1)
        near = far - far[np.arange(len(far)), home][:, None] <= 2 * reach + SLACK
        row, cell = np.nonzero(near)
        out = part.iloc[row][["label", "width", "node", "copies", "v"]].copy()
        out["cell"], out["home"] = cell, cell == home[row]
        return out
    return cells


def _compare(cosine: float):
    """Partners of a block of a cell's own vectors among one block of all that the cell holds."""
    def block(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "low": pd.Series(dtype="int64")})
        linked = _unit(own["v"]) @ _unit(held["v"]).T >= cosine
        a, b, copies = own["node"].to_numpy(), held["node"].to_numpy(), held["copies"].to_numpy()
        linked &= a[:, None] != b[None]
        partners = linked @ copies
        # labels spread over the links of this block until they rest, so each node needs one edge
        low_a, low_b, top = a.copy(), b.copy(), np.iinfo(np.int64).max
        while True:
            new_b = np.minimum(low_b, np.where(linked, low_a[:, None], top).min(0))
            new_a = np.minimum(low_a, np.where(linked, new_b[None], top).min(1))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        frames = [pd.DataFrame({"node": a, "n": partners, "low": low_a})[linked.any(1)],
                  pd.DataFrame({"node": b, "n": 0, "low": low_b})[linked.any(0)]]
        return pd.concat(frames)
    return block


def _placed(points: DataFrame, reach: float, block_rows: int) -> DataFrame:
    """``points`` with ``cell`` and ``home``: each one in its own cell, and copied to every other that may hold partners.

    Labels of more than LEAST_ROWS points have pivots, those of the least hash: a small table that meets each block of their
    points, so neither the driver nor a task holds those of all labels.
    """
    of = ["label", "width"]
    sizes = materialized(points.groupBy(*of).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows)))
    order = F.row_number().over(Window.partitionBy(*of).orderBy(F.xxhash64("v"), "node"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2), F.ceil(F.col("n") / ROWS_PER_PIVOT)))
    first = points.join(sizes.where(F.col("n") > LEAST_ROWS), of).withColumn("k", order).where(F.col("k") <= MOST_PIVOTS).where(F.col("k") <= wanted)
    pivots = materialized(first.select(*of, "k", "v", "blocks"))
    pivots = pivots.select(*of, "k", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    dealt = points.join(sizes, of).select(*[F.col(c).alias(c) for c in (*of, "node", "copies", "v")], F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    kind = points.schema["label"].dataType.simpleString()
    return dealt.groupBy(*of, "block").cogroup(pivots.groupBy(*of, "block")).applyInPandas(
        _assign(reach), f"label {kind}, width int, node long, copies long, v array<double>, cell int, home boolean")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, ``n_links`` (others linked directly), ``component_id``, ``kept``.

    Only vectors of one label (not null) and one length are compared, by cosine in double precision.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do
    rows without an id, which keep a null component. Equal vectors are one node with its number of rows,
    so copies cost nothing; repeated rows link with each other and stay repeated in the result.
    Cells are cut into blocks that meet pairwise, so a dense cell is many tasks of bounded memory.
    """
    v = F.col(f"`{vector}`")
    good = (F.col(f"`{label}`").isNotNull() & F.col(f"`{id}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = materialized(vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"),
                                       F.when(good, F.transform(v, lambda x: x.cast("double"))).alias("v")))
    points = (rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
              .withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    points = materialized(points)
    placed = materialized(_placed(points, float(np.sqrt(2 - 2 * cosine)), block_rows))
    cells = placed.groupBy("label", "width", "cell").agg(F.count_if("home").alias("own"), F.count("*").alias("all"))
    cells = materialized(cells.select("label", "width", "cell", F.ceil(F.col("own") / block_rows).alias("rows"), F.ceil(F.col("all") / block_rows).alias("columns")))
    cut = placed.join(cells, ["label", "width", "cell"])
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["label", "width", "cell", "i", "j"]
    fields = [F.col(c).alias(c) for c in ("label", "width", "cell", "node", "copies", "v")]  # aliases: the two sides come from one table
    own = cut.where("home").select(part(F.col("rows")).alias("i"), number("columns").alias("j"), *fields)
    held = cut.where("rows > 0").select(part(F.col("columns")).alias("j"), number("rows").alias("i"), *fields)
    found = materialized(own.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_compare(cosine), "node long, n long, low long"))
    groups = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = points.select("label", "v", "node", "copies", "first").join(counts, "node", "left").join(groups, "node", "left")
    named = materialized(named.select("label", "v", "first", F.coalesce("component", "node").alias("component"),
                                      (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lowest = materialized(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = materialized(named.join(lowest, "component").select("label", "v", "n_links", "component_id"))
    linked = rows.where("v is not null").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id), "n_links", F.col("component_id").cast("long").alias("component_id"),
                                      (F.col("id") == F.col("component_id")).alias("kept"))
