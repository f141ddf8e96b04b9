"""Registry of plans and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_TYPES = {"l": "bigint", "d": "double", "s": "varchar", "b": "boolean"}


def nudge(digits: int) -> float:
    """Added before rounding on both sides: exact decimal halves (hours, means of prices) would
    otherwise go up in one engine and down in the other on their last bit."""
    return 3.7 * 10.0 ** -(digits + 4)


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Comparable output: whole numbers as long, doubles rounded, -0.0 as 0.0."""
    def fix(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.FractionalType):
            return (F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        return c
    return df.select(*[fix(f) for f in df.schema.fields])


def tidy_sql(sql: str, columns: str, digits: int) -> str:
    out = []
    for item in columns.split():
        name, kind = item.rsplit(":", 1)
        cast = f"cast({name} as {SQL_TYPES[kind]})"
        out.append(f"round({cast} + {nudge(digits)!r}::double, {digits}) + 0.0::double as {name}" if kind == "d" else f"{cast} as {name}")
    return f"select {', '.join(out)} from ({sql}) as result"


def plan(name: str, columns: str | None = None, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)``; with ``sql`` also its oracle over ``columns`` (name:type)."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)
        run.__name__ = name
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = tidy_sql(sql, columns, digits)
        return fn
    return add
