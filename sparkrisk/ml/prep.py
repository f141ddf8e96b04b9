"""Fit-on-train encoders (M1-M3). Fitted values are one row per column or per kept category."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import MISSING, UNSEEN
from ..functions.ordering import asc, exact_quantiles, global_rank
from ..functions.roles import require_columns
from ..functions.session import materialized
from ..operators.compare import lookup_encode
from ..operators.drift import melt_numeric


def fit_medians(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(feature, median) of the train rows, exact, NULLs ignored; all-NULL columns are absent."""
    return exact_quantiles(melt_numeric(train, numeric), "value", [0.5], by=["feature"]).select(
        "feature", F.col("quantile").alias("median"))


def fit_scaling(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(feature, median, mean, std) after median imputation; population standard deviation (M1)."""
    medians = {r["feature"]: r["median"] for r in fit_medians(train, numeric).collect()}  # one row per column
    aggs = [a for c in numeric for x in [F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0)))]
            for a in (F.avg(x).alias(f"mean|{c}"), F.stddev_pop(x).alias(f"std|{c}"))]
    row = train.agg(*aggs).first()
    rows = [(c, medians.get(c, 0.0), row[f"mean|{c}"], row[f"std|{c}"]) for c in numeric]
    return train.sparkSession.createDataFrame(rows, "feature string, median double, mean double, std double")


class ImputeScale(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """NULL -> train median, then (x - mean) / std; plain expressions in one projection."""

    inputs = Param(Params._dummy(), "inputs", "numeric columns", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "train medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "train means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "train deviations", TypeConverters.toListFloat)
    suffix = Param(Params._dummy(), "suffix", "output suffix", TypeConverters.toString)

    def __init__(self, inputs=(), medians=(), means=(), stds=(), suffix="_z"):
        super().__init__()
        self._set(inputs=list(inputs), medians=list(medians), means=list(means), stds=list(stds), suffix=suffix)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.inputs)
        require_columns(df, names, "impute_scale")
        parts = zip(names, *(self.getOrDefault(p) for p in (self.medians, self.means, self.stds)))
        end = self.getOrDefault(self.suffix)
        return df.withColumns({f"{c}{end}": (F.coalesce(F.col(c).cast("double"), F.lit(med)) - mu) / (sd if sd else 1.0)
                               for c, med, mu, sd in parts})


def category_vocabulary(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, category, code): sorted train categories, then the missing and unseen buckets (M2)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in categorical])
    seen = train.select(F.explode(cells).alias("c")).select("c.*").where(F.col("category").isNotNull()).distinct()
    # a vocabulary can be long, so its order is not left to one task
    ranked = global_rank(seen, [asc("category")], by=["feature"], keep=["category"])
    codes = ranked.select("feature", "category", (F.col("rank") - 1).cast("int").alias("code"))
    sizes = codes.groupBy("feature").agg(F.count(F.lit(1)).cast("int").alias("k"))
    extra = sizes.select("feature", F.explode(F.array(
        F.struct(F.lit(MISSING).alias("category"), F.col("k").alias("code")),
        F.struct(F.lit(UNSEEN).alias("category"), (F.col("k") + 1).alias("code")))).alias("e")).select("feature", "e.*")
    return codes.unionByName(extra)


def encode_categories(df: DataFrame, vocabulary: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Replace categories by codes; NULL and unseen values get their own codes."""
    out = df
    for c in categorical:
        vocab = vocabulary.where(F.col("feature") == c)
        unseen = vocab.where(F.col("category") == UNSEEN).first()
        if unseen is None:
            raise ValueError(f"encode_categories: '{c}' is not in the vocabulary")
        filled = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
        out = lookup_encode(filled, c, vocab, "category", "code", unseen["code"], f"{c}_code")
    return out


@dataclass(frozen=True)
class TreePrep:
    """What ``tree_prep`` fitted: the vocabulary of category codes, as a table, and the rest as a pipeline."""

    categorical: tuple
    vocabulary: DataFrame | None
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        out = encode_categories(df, self.vocabulary, self.categorical) if self.categorical else df
        return self.pipeline.transform(out)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.categorical:
            self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str, categorical: Sequence[str]) -> "TreePrep":
        vocabulary = spark.read.parquet(f"{path}/vocabulary") if categorical else None
        return cls(tuple(categorical), vocabulary, PipelineModel.load(f"{path}/pipeline"))


@dataclass(frozen=True)
class LinearPrep:
    """What ``linear_prep`` fitted: the vocabulary of category codes, as a table, and the rest as a pipeline."""

    categorical: tuple
    vocabulary: DataFrame | None
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        out = encode_categories(df, self.vocabulary, self.categorical) if self.categorical else df
        return self.pipeline.transform(out)


def linear_prep(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                features_col: str = "features") -> LinearPrep:
    """Imputed and standardised numbers, one-hot categories; a missing or unseen category is all zeros (M1).

    Codes come from joins with the vocabulary, which stays a table; the driver only learns how many categories a column has,
    and the blocks of the vector are sparse.
    """
    stats = {r["feature"]: r for r in fit_scaling(train, numeric).collect()} if numeric else {}
    stages = [ImputeScale(numeric, *[[float(stats[c][k]) for c in numeric] for k in ("median", "mean", "std")])]
    vocabulary, hot = None, []
    if categorical:
        vocabulary = materialized(category_vocabulary(train, categorical))
        size = {r["feature"]: r["code"] for r in vocabulary.where(F.col("category") == MISSING).collect()}  # one row per column
        codes, hot = [f"{c}_code" for c in categorical], [f"{c}_hot" for c in categorical]
        # codes of missing and unseen values lie beyond the last category: "keep" puts them last and dropLast makes them zeros
        last = train.sparkSession.createDataFrame([[float(size[c] - 1) for c in categorical]], ", ".join(f"`{c}` double" for c in codes))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep", dropLast=True).fit(last))
    stages.append(VectorAssembler(inputCols=[f"{c}_z" for c in numeric] + hot, outputCol=features_col))
    return LinearPrep(tuple(categorical), vocabulary, PipelineModel(stages=stages))


def tree_prep(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], sentinel: float = -1e9,
              features_col: str = "features") -> TreePrep:
    """Category codes and numbers for trees (M2).

    Spark's trees do not route NULLs: a sentinel far below all values plus an indicator column
    lets a split send missing values either way. Categories are their codes in sorted order, with a code
    for missing and another for unseen values; the vocabulary stays a table, however long it is.
    """
    vocabulary = materialized(category_vocabulary(train, categorical)) if categorical else None
    inputs = [f"{c}_f" for c in numeric] + [f"{c}_na" for c in numeric] + [f"{c}_code" for c in categorical]
    stages = [FillMissing(numeric, sentinel), VectorAssembler(inputCols=inputs, outputCol=features_col)]
    return TreePrep(tuple(categorical), vocabulary, PipelineModel(stages=stages))


class FillMissing(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    inputs = Param(Params._dummy(), "inputs", "numeric columns", TypeConverters.toListString)
    sentinel = Param(Params._dummy(), "sentinel", "value for NULL", TypeConverters.toFloat)

    def __init__(self, inputs=(), sentinel=-1e9):
        super().__init__()
        self._set(inputs=list(inputs), sentinel=sentinel)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.inputs)
        require_columns(df, names, "fill_missing")
        low = self.getOrDefault(self.sentinel)
        return df.withColumns({**{f"{c}_f": F.coalesce(F.col(c).cast("double"), F.lit(low)) for c in names},
                               **{f"{c}_na": F.col(c).isNull().cast("double") for c in names}})


def category_frequencies(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, category, freq) on train rows, NULL as its own category (M3)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(
        "category")) for c in categorical])
    counts = train.select(F.explode(cells).alias("c")).groupBy("c.feature", "c.category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    return counts.join(totals, "feature").select("feature", "category", (F.col("n") / F.col("t")).alias("freq"))


def anomaly_prep(df: DataFrame, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 keep: Sequence[str] = (), drop_prefix: str | None = "V") -> DataFrame:
    """Numbers with train medians, categories as train frequencies (unseen 0); no NULL left (M3).

    Columns of the opaque group (prefix + digits) are left out.
    """
    if drop_prefix:
        numeric = [c for c in numeric if not (c.startswith(drop_prefix) and c[len(drop_prefix):].isdigit())]
    medians = {r["feature"]: r["median"] for r in fit_medians(train, numeric).collect()}
    freqs = category_frequencies(train, categorical) if categorical else None
    out = df.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) for c in numeric},
                          **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}})
    for c in categorical:
        out = lookup_encode(out, c, freqs.where(F.col("feature") == c), "category", "freq", 0.0, f"{c}_freq")
    return out.select(*keep, *numeric, *[f"{c}_freq" for c in categorical])
