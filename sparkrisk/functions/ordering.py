"""Global order, running totals and exact order statistics without a single-task sort.

A window without PARTITION BY would pull every row into one task. Here rows are range
partitioned on the ordering keys, each partition adds up its own rows while Arrow batches stream
through, and the one-row-per-partition totals give every partition its offset. The keys should
end with a unique column, so that a value shared by a third of all rows is still spread.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .session import materialized, shuffle_partitions

DIRECT_SORT_ROWS = 20_000_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named columns in which NULL keys match each other."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side (a union of rows folded into one, no cross join)."""
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _running(columns: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    def add(batches):
        carry = {c: 0 for c in columns}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrays, names = list(batch.columns), list(batch.schema.names)
            for c in columns:
                cum = pc.add(pc.cumulative_sum(batch.column(names.index(c))), carry[c])
                carry[c] = cum[-1].as_py()
                arrays.append(cum)
            yield pa.RecordBatch.from_arrays(arrays, names=names + [f"cum_{c}" for c in columns])
    return add


def running_totals(df: DataFrame, order: Sequence[tuple[str, bool]], sums: dict[str, Column],
                   by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Inclusive running totals of non-negative ``sums`` in ``order`` inside each ``by`` group.

    Returns ``by + keep + name, cum_name, total_name`` for each sum. One range shuffle over the
    selected columns; the result is a written table, so ranks are the same whenever it is read.
    """
    by, keep, names = list(by), list(keep), list(sums)
    spark = df.sparkSession
    narrow = df.select(*by, *keep, *[F.coalesce(sums[n], F.lit(0)).alias(n) for n in names],
                       *[F.col(name).alias(f"__o{i}") for i, (name, _) in enumerate(order)])
    narrow = narrow.withColumns({n: F.col(n).cast("double" if isinstance(
        narrow.schema[n].dataType, T.FractionalType) else "long") for n in names})
    keys = [F.col(b) for b in by] + [
        F.col(f"__o{i}").desc() if down else F.col(f"__o{i}").asc() for i, (_, down) in enumerate(order)]
    ranged = (narrow.repartitionByRange(shuffle_partitions(spark), *keys)
              .sortWithinPartitions(*keys).drop(*[f"__o{i}" for i in range(len(order))]))
    schema = T.StructType(list(ranged.schema.fields) + [
        T.StructField(f"cum_{n}", ranged.schema[n].dataType) for n in names])
    local = materialized(ranged.mapInArrow(_running(names), schema).withColumn("__pid", F.spark_partition_id()))

    # one row per (partition, group) in it: at most partitions + groups rows, made in one pass
    marks = local.groupBy("__pid", *by).agg(
        *[F.min(F.col(f"cum_{n}") - F.col(n)).alias(f"__low_{n}") for n in names],
        *[F.max(f"cum_{n}").alias(f"__high_{n}") for n in names])
    if by:
        marks = materialized(marks)
    # a window over one row per partition is not a single-task sort of the data
    one, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("__pid")
    parts = (marks.groupBy("__pid").agg(*[F.max(f"__high_{n}").alias(f"__t_{n}") for n in names])
             .select("__pid",
                     *[(F.sum(f"__t_{n}").over(upto) - F.col(f"__t_{n}")).alias(f"__off_{n}") for n in names],
                     *[F.sum(f"__t_{n}").over(one).alias(f"total_{n}") for n in names]))
    out = local.join(F.broadcast(parts), "__pid")
    out = out.withColumns({f"cum_{n}": F.col(f"cum_{n}") + F.col(f"__off_{n}") for n in names})
    if by:
        out = out.drop(*[f"total_{n}" for n in names])
        placed = marks.join(F.broadcast(parts), "__pid")
        groups = placed.groupBy(*by).agg(
            *[F.min(F.col(f"__low_{n}") + F.col(f"__off_{n}")).alias(f"__start_{n}") for n in names],
            *[F.max(F.col(f"__high_{n}") + F.col(f"__off_{n}")).alias(f"__end_{n}") for n in names])
        out = join_on(out, groups, by)
        out = out.withColumns({f"cum_{n}": F.col(f"cum_{n}") - F.col(f"__start_{n}") for n in names})
        out = out.withColumns({f"total_{n}": F.col(f"__end_{n}") - F.col(f"__start_{n}") for n in names})
    return out.select(*by, *keep, *[c for n in names for c in (n, f"cum_{n}", f"total_{n}")])


def asc(name: str) -> tuple[str, bool]:
    return name, False


def desc(name: str) -> tuple[str, bool]:
    return name, True


def global_rank(df: DataFrame, order, by: Sequence[str] = (), keep: Sequence[str] = (),
                sums: dict[str, Column] | None = None) -> DataFrame:
    """1-based position of each row (``rank``) and the group size (``n_rows``)."""
    out = running_totals(df, order, {"__one": F.lit(1).cast("long"), **(sums or {})}, by, keep)
    return (out.withColumnRenamed("cum___one", "rank").withColumnRenamed("total___one", "n_rows")
            .drop("__one"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles: rows ``by, prob, quantile`` (NULL values ignored).

    Equal values are counted before anything is ordered, and only the two neighbours of each
    quantile leave the sorted partitions; no group is held in memory as ``percentile`` would.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")) \
        .agg(F.count(F.lit(1)).alias("__n"))
    runs = running_totals(counts, [asc("__v")], {"__n": F.col("__n")}, by, ["__v"])
    probs_lit = F.array(*[F.lit(float(p)) for p in probs])
    first, last = F.col("cum___n") - F.col("__n"), F.col("cum___n") - 1

    def hit(p):
        pos = p * (F.col("total___n") - 1)
        return (F.floor(pos).between(first, last)) | (F.ceil(pos).between(first, last))

    hits = (runs.withColumn("prob", F.explode(F.filter(probs_lit, hit)))
            .withColumn("__pos", F.col("prob") * (F.col("total___n") - 1)))
    ends = hits.groupBy(*by, "prob").agg(
        F.max("__pos").alias("__pos"),
        F.max(F.when(F.floor("__pos").between(first, last), F.col("__v"))).alias("__lo"),
        F.max(F.when(F.ceil("__pos").between(first, last), F.col("__v"))).alias("__hi"))
    frac = F.col("__pos") - F.floor("__pos")
    return ends.select(*by, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).alias("quantile"))


def keys_at_ranks(df: DataFrame, order, ranks_of: Callable[[int], Sequence[int]],
                  direct_rows: int = DIRECT_SORT_ROWS) -> tuple[int, list]:
    """Key rows at given 1-based ranks of a total order, as driver scalars.

    Rows whose first key is NULL have no rank and aren't counted, on either way. Returns ``(n_rows, [Row of the order columns or None])``, one entry per requested rank. Small
    inputs are ranked whole. Large ones are not sorted: an approximate quantile brackets each
    rank, exact counts verify the bracket, and only rows inside brackets are ranked.
    """
    names = [name for name, _ in order]
    narrow = df.select(*names).where(F.col(names[0]).isNotNull())
    n = narrow.count()
    ranks = [int(r) for r in ranks_of(n)]
    wanted = sorted({r for r in ranks if 1 <= r <= n})
    if not wanted:
        return n, [None] * len(ranks)
    if n <= direct_rows:
        hits = global_rank(narrow, order, keep=names).where(F.col("rank").isin(wanted)).collect()
        found = {h["rank"]: h for h in hits}
        return n, [found.get(r) for r in ranks]

    lead, down = order[0]
    accuracy = 100_000
    position = {r: (n - r + 1 if down else r) for r in wanted}
    probs = []
    for r in wanted:
        p = position[r] / n
        probs += [max(0.0, p - 3 / accuracy), min(1.0, p + 3 / accuracy)]
    edges = narrow.agg(F.percentile_approx(lead, F.array(*[F.lit(p) for p in probs]), accuracy).alias("e"),
                       F.min(lead).alias("lo"), F.max(lead).alias("hi")).first()
    brackets = {r: (edges["e"][2 * i], edges["e"][2 * i + 1]) for i, r in enumerate(wanted)}

    def before(lo, hi):
        return F.col(lead) > hi if down else F.col(lead) < lo

    def counts(spans):
        return narrow.agg(*[c for i, r in enumerate(wanted) for c in (
            F.count_if(before(*spans[r])).alias(f"b{i}"),
            F.count_if(F.col(lead).between(*spans[r])).alias(f"i{i}"))]).first()

    seen = counts(brackets)
    missed = [r for i, r in enumerate(wanted) if not seen[f"b{i}"] < r <= seen[f"b{i}"] + seen[f"i{i}"]]
    if missed:
        brackets.update({r: (edges["lo"], edges["hi"]) for r in missed})
        seen = counts(brackets)
    offsets = {r: seen[f"b{i}"] for i, r in enumerate(wanted)}
    members = F.filter(F.array(*[F.when(F.col(lead).between(*brackets[r]), F.lit(r)) for r in wanted]),
                       lambda r: r.isNotNull())
    inside = narrow.withColumn("__target", F.explode(members))
    ranked = global_rank(inside, order, by=["__target"], keep=names)
    target = functools.reduce(operator.or_, [
        (F.col("__target") == r) & (F.col("rank") == r - offsets[r]) for r in wanted])
    found = {h["__target"]: h for h in ranked.where(target).collect()}
    return n, [found.get(r) for r in ranks]


def at_or_before(order, key) -> Column:
    """Rows whose key is not after ``key`` in a total order of (name, descending) pairs."""
    cond = F.lit(True)
    for name, down in reversed(order):
        c, v = F.col(name), F.lit(key[name])
        strict = c > v if down else c < v
        cond = strict | ((c == v) & cond)
    return cond
