"""Row-level projections and checks (P3-P12) that hold for batch and stream alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import MISSING, as_number, count_if, decide, ratio
from ..functions.ordering import exact_quantiles
from ..functions.roles import Roles, forbid_columns, require_columns


class FeatureSelector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Select used feature columns: NULL categories become ``__missing__``, numbers keep NULL.

    An ML stage, so it chains in a Pipeline; absent columns fail before anything runs.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    keep = Param(Params._dummy(), "keep", "columns passed through", TypeConverters.toListString)

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), keep: Sequence[str] = ()):
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), keep=list(keep))

    def _transform(self, df: DataFrame) -> DataFrame:
        numeric, cats, keep = (self.getOrDefault(p) for p in (self.numeric, self.categorical, self.keep))
        require_columns(df, [*numeric, *cats, *keep], "select_features")
        return df.select(*keep, *numeric,
                         *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cats])


def select_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    return FeatureSelector(numeric, categorical, keep).transform(df)


def cast_target(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("int"))


def leakage_guard(df: DataFrame, label: str, required: Sequence[str]) -> DataFrame:
    """Refuse an input that carries the label or lacks a required column (P5)."""
    forbid_columns(df, [label], "leakage_guard")
    require_columns(df, required, "leakage_guard")
    return df


def row_errors(df: DataFrame, roles: Roles, raw: str | None = None) -> DataFrame:
    """Add ``error_reason``: the code of the first failed check per row (``check:column``), or NULL.

    The order is fixed: label present, field absent or null, not a number, not finite, negative amount. A raw JSON
    column is parsed once, and its fields are read from the parsed value; then text that isn't a JSON object is
    ``malformed``, a key that isn't there ``field_absent``, one that holds null ``field_null``, and the label may not
    even be there as null.
    """
    required = [roles.id, roles.time, roles.amount, roles.entity]
    require_columns(df, [c for c in required if raw is None] + ([raw] if raw else []), "row_errors")
    names = df.columns
    if raw:
        df = df.withColumn("__json", F.try_parse_json(F.col(raw)))

    def part(name: str) -> Column:
        """The field as it stands in the message: no value at all if the key is absent."""
        return F.try_variant_get("__json", f"$.{name}", "variant")

    def field(name: str) -> Column:
        return F.try_variant_get("__json", f"$.{name}", "string") if raw else F.col(name)

    reason: Column | None = None

    def check(cond: Column, text: str):
        nonlocal reason
        reason = F.when(cond, F.lit(text)) if reason is None else reason.when(cond, F.lit(text))

    if raw:
        check(~F.coalesce(F.schema_of_variant("__json").startswith("OBJECT"), F.lit(False)), f"malformed:{raw}")
        check(part(roles.label).isNotNull(), f"label_present:{roles.label}")
        for c in required:
            check(part(c).isNull(), f"field_absent:{c}")
            check(F.is_variant_null(part(c)), f"field_null:{c}")
    elif roles.label in df.columns:
        check(F.col(roles.label).isNotNull(), f"label_present:{roles.label}")
    if not raw:
        for c in required:
            check(field(c).isNull(), f"field_null:{c}")
    for c in (roles.time, roles.amount):
        dtype = None if raw else df.schema[c].dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            continue
        number = as_number(field(c))
        check(number.isNull(), f"not_a_number:{c}")
        check(F.isnan(number) | F.abs(number).isin(float("inf")), f"not_finite:{c}")
        if c == roles.amount:
            check(number < 0, f"negative:{c}")
    return df.withColumn("error_reason", reason).select(*names, "error_reason")


def complete_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Expected columns in order, absent ones as typed NULLs, unexpected ones dropped."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as double, NULL where the text is no number."""
    return df.withColumns({c: as_number(F.col(c)) for c in columns})


def safe_amount(c: str) -> Column:
    return as_number(F.col(c))


def missing_optional_count(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Number of NULL fields per row outside the required ones."""
    optional = [c for c in df.columns if c not in required]
    total = sum((F.col(c).isNull().cast("int") for c in optional), F.lit(0))
    return df.withColumn("n_missing_optional", total)


def decided(df: DataFrame, score: str, approve, block) -> DataFrame:
    return df.withColumn("decision", decide(F.col(score), approve, block))


def segment_lift(df: DataFrame, score_a: str, score_b: str, low, high, label: str = "label") -> DataFrame:
    """Positive rate and lift of the rows with ``a < low AND b > high`` (P10), one aggregation."""
    hit = (F.col(score_a) < low) & (F.col(score_b) > high)
    y = F.col(label).cast("int")
    agg = df.agg(count_if(hit).alias("n_flagged"), count_if(hit & (y == 1)).alias("positives_flagged"),
                 F.count(F.lit(1)).alias("n_rows"), count_if(y == 1).alias("positives"))
    rate, overall = ratio(F.col("positives_flagged"), F.col("n_flagged")), ratio(F.col("positives"), F.col("n_rows"))
    return agg.select("n_flagged", "positives_flagged", rate.alias("rate_flagged"), overall.alias("overall_rate"),
                      ratio(rate, overall).alias("lift"))


def segment_thresholds(df: DataFrame, score_a: str, score_b: str, low_q: float = 0.5,
                       high_q: float = 0.9) -> DataFrame:
    """One row: exact quantile of score A and of score B on the given (validation) rows."""
    long = df.select(F.explode(F.array(
        F.struct(F.lit("a").alias("s"), F.col(score_a).cast("double").alias("v")),
        F.struct(F.lit("b").alias("s"), F.col(score_b).cast("double").alias("v")))).alias("x")).select("x.s", "x.v")
    q = exact_quantiles(long, "v", sorted({low_q, high_q}), by=["s"])
    return q.agg(F.max(F.when((F.col("s") == "a") & (F.col("prob") == low_q), F.col("quantile"))).alias("low"),
                 F.max(F.when((F.col("s") == "b") & (F.col("prob") == high_q), F.col("quantile"))).alias("high"))
