"""Mixing to target weights with soft membership.

A classifier trained on the labelled documents gives every document a posterior over domains. Rates r >= 0
are then fitted so that the expected tokens of each domain, sum over documents of rate * tokens * posterior,
match the targets in the least squares sense: projected gradient, each step one distributed sum. A step's
gradient is the same for all documents of one posterior, so the steps run over the posteriors that occur
(kept to three decimals) with their total tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import materialized
from .tables import whole_text

#: Share of the tokens that each language is to have.
TARGETS = {"en": 0.50, "fr": 0.20, "de": 0.20, "es": 0.10}
#: Labelled documents that the classifier may use at most (those of the least hash).
SAMPLE = 3000
FEATURES, GRID, STEPS, TOLERANCE = 1 << 11, 1000, 25, 1e-6


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def train(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text", domain: str = "lang",
          sample: int = SAMPLE) -> tuple[PipelineModel | None, list[str]]:
    """Classifier of the domains in ``targets``, fitted on at most ``sample`` documents whose ids are in ``labelled``;
    and the domains in the order of its posterior. None where labelled documents show fewer than two of them."""
    names = sorted(targets)
    picked = materialized(labelled.select(F.col(f"`{id}`").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample))
    number = F.coalesce(*[F.when(F.col(f"`{domain}`") == n, F.lit(float(k))) for k, n in enumerate(names)])
    rows = materialized(docs.select(F.col(f"`{id}`").alias("id"), _words(whole_text(text)).alias("words"), number.alias("label"))
                        .join(F.broadcast(picked), "id").where("label is not null").select("words", "label"))
    shown = [r["label"] for r in rows.select("label").distinct().collect()]  # as many as there are targets at most
    if len(shown) < 2:
        return None, names
    stages = [HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES), Normalizer(inputCol="counts", outputCol="features", p=1.0),
              LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, featuresCol="features", labelCol="label", probabilityCol="probability")]
    return Pipeline(stages=stages).fit(rows), names


def posterior(docs: DataFrame, model: PipelineModel | None, names: list[str], text: str = "text") -> DataFrame:
    """The documents with ``__tokens`` (words of the whole text) and ``__p``: posteriors in thousandths, as whole numbers.

    The caller's columns must not be named like the classifier's; ``rates`` and ``mix`` see to that. Without a classifier all domains are equally likely. Null and empty texts have no tokens and the prior's posterior.
    """
    words = _words(whole_text(text))
    if model is None:
        even = F.array(*[F.lit(round(GRID / len(names))) for _ in names])
        return docs.withColumn("__tokens", F.size(words).cast("long")).withColumn("__p", even)
    scored = model.transform(docs.withColumn("words", words))
    p = F.transform(vector_to_array("probability"), lambda x: F.round(x * GRID).cast("int"))
    missing = len(names) - int(model.stages[-1].numClasses)
    if missing:
        p = F.concat(p, F.array(*[F.lit(0)] * missing))
    return (scored.withColumn("__tokens", F.size("words").cast("long")).withColumn("__p", p)
            .drop("words", "counts", "features", "rawPrediction", "probability", "prediction"))


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate that projected steps lead to from 1: each takes off its slope and goes back to 0 from below."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    slopes = F.array(*[F.array(*[F.lit(float(x) / GRID) for x in s]) for s in steps])
    move = lambda r, s: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(F.col("__p"), s, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(slopes, rate, move)


def fit_rates(scored: DataFrame, targets: dict[str, float], names: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps for ``_rate``, the targets in tokens and the expected tokens reached.

    The budget is the largest for which no domain must lose: that of the domain most over its share. The
    gradient is preconditioned by the domains' token Gram matrix, halved while the squares don't shrink.
    """
    tokens = F.col("__tokens").cast("double")
    groups = materialized(scored.groupBy("__p").agg(F.sum("__tokens").alias("__tokens")).where("__tokens > 0"))
    d = len(names)
    part = lambda k: F.get("__p", F.lit(k)) / GRID
    sums = groups.agg(*[F.sum(tokens * part(i)) for i in range(d)], *[F.sum(tokens * part(i) * part(j)) for i in range(d) for j in range(d)]).first()
    got = np.array([x or 0.0 for x in sums[:d]])
    gram = np.array([x or 0.0 for x in sums[d:]]).reshape(d, d)
    share = np.array([targets[n] for n in names])
    share = share / share.sum()
    want = share * max((g / s for g, s in zip(got, share) if s > 0), default=0.0)
    if not got.sum():
        return [], want, got
    inverse = np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(d))

    def reached(steps: list[np.ndarray]) -> np.ndarray:
        row = groups.withColumn("r", _rate(steps)).agg(*[F.sum(tokens * part(k) * F.col("r")) for k in range(d)]).first()
        return np.array([x or 0.0 for x in row])

    steps: list[np.ndarray] = []
    scale, loss = 1.0, float(((got - want) ** 2).sum())
    for _ in range(STEPS):
        if np.abs(got - want).max() <= TOLERANCE * want.sum() or scale < 1e-3:
            break
        trial = [*steps, scale * inverse @ (got - want)]
        there = reached(trial)
        new = float(((there - want) ** 2).sum())
        if new < loss:
            steps, got, loss, scale = trial, there, new, min(1.0, 2 * scale)
        else:
            scale /= 2
    return steps, want, got


def _copies(rate: Column, key: Column, at_least: int) -> Column:
    """Whole copies of a document: the rate's whole part, and one more as often as its fraction says, by hash."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return F.greatest(F.lit(at_least), F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id: str = "doc_id", text: str = "text", domain: str = "lang",
          at_least: int = 0) -> DataFrame:
    """The id, ``tokens``, ``p_<domain>`` for each target, ``rate`` and ``copies``, one row per document.

    The domain column only serves to train: rows whose value is null or no target are left out there, and rated
    like any other. Empty documents have no tokens, so their rate moves nothing. Repeated rows are rated alike.
    """
    model, names = train(docs, labelled, targets, id, text, domain)
    rows = posterior(docs.select(F.col(f"`{id}`").alias("__id"), whole_text(text).alias("__text")), model, names, "__text")
    scored = materialized(rows.select("__id", "__tokens", "__p"))
    steps, _, _ = fit_rates(scored, targets, names)
    rated = scored.withColumn("rate", _rate(steps))
    return rated.select(F.col("__id").alias(id), F.col("__tokens").alias("tokens"), *[(F.get("__p", F.lit(k)) / GRID).alias(f"p_{n}") for k, n in enumerate(names)],
                        "rate", _copies(F.col("rate"), F.col("__id"), at_least).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id: str = "doc_id", text: str = "text", domain: str = "lang",
        at_least: int = 0) -> DataFrame:
    """The documents, each as many times as its copies; ``at_least=1`` keeps every document. Texts aren't shuffled:
    they are scored once for the rates and once more where they are written."""
    model, names = train(docs, labelled, targets, id, text, domain)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), whole_text(text).alias("__text"))
    rows = posterior(wrapped, model, names, "__text")
    steps, _, _ = fit_rates(materialized(rows.select("__tokens", "__p")), targets, names)
    copies = _copies(_rate(steps), F.coalesce(F.col(f"__row.`{id}`").cast("string"), F.lit("")), at_least)
    many = rows.select("__row", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy"))
    return many.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
