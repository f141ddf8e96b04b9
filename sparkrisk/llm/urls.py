"""URL filter: rules for hosts and paths first, else logistic regression on character n-grams.

The n-grams of host and path are hashed; the weights come from a small labelled table below, trained by
Spark ML on DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FEATURES, GRAMS, THRESHOLD = 1 << 13, (3, 4, 5), 0.5

#: (action, host and path); the longest that fits decides.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: The labelled table: words of host names and first parts of paths, unwanted and wanted.
UNWANTED = ("cheap-pills spam-farm casino-bonus free-viagra adult-cams xxx-videos porn-tube payday-loans replica-watches slot-jackpot "
            "poker-win bet-now hot-singles crack-keygen warez-download torrent-hub clickbait-daily lottery-winner weight-loss-pills "
            "get-rich-quick miracle-cure fake-followers link-farm seo-spam phishing-login escort-girls gambling-online pills-shop").split()
WANTED = ("news library university museum weather science history recipes gardening travel city-council school hospital docs "
          "encyclopedia journal archive music sports cinema theatre astronomy biology chemistry physics mathematics language books").split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: on to ``?``, ``#`` or the end.

    A url that is null or has no ``://`` has an empty host and path.
    """
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (action, rule) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path with marked ends; a text of n characters gives at most len(GRAMS) * n."""
    def of(text: Column, mark: str) -> Column:
        letters = F.split(F.concat(F.lit("^"), F.lower(text), F.lit("$")), "")
        def width(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(letters) - n + 1))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, n), "")))
        return F.concat(*[width(n) for n in GRAMS])
    return F.concat(of(host, "h"), of(path, "p"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url``, ``label`` (1: unwanted), one row for each word of the labelled table in a few usual forms."""
    words = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(y).alias("label")) for y, ws in ((1.0, UNWANTED), (0.0, WANTED)) for w in ws]))
    forms = ["http://{}.example.com/en/12", "https://www.{}.example.org/fr/345.html", "https://m.{}.example.net/de/67/", "https://{}.org/es/890?page=2",
             "https://www.site.com/{}/index.html"]
    word = spark.range(1, numPartitions=1).select(words.alias("r")).select("r.w", "r.label")
    put = F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("w"), F.lit(f.split("{}")[1])) for f in forms]))
    return word.select(put.alias("url"), "label")


def _with_grams(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return urls.withColumn("host", host).withColumn("path", path).withColumn("grams", grams(F.col("host"), F.col("path")))


def train(labelled: DataFrame) -> PipelineModel:
    """Logistic regression on hashed n-gram shares; ``labelled`` has ``url`` and ``label`` and is small."""
    stages = [HashingTF(inputCol="grams", outputCol="counts", numFeatures=FEATURES), Normalizer(inputCol="counts", outputCol="features", p=2.0),
              LogisticRegression(regParam=0.002, maxIter=60, featuresCol="features", labelCol="label", probabilityCol="probability")]
    return Pipeline(stages=stages).fit(_with_grams(labelled))


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str]] = RULES, id: str = "page_id", url: str = "url",
          threshold: float = THRESHOLD) -> DataFrame:
    """The id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``score`` (the model's, 0 to 1).

    A null or malformed url has an empty host and path, fits no rule and is judged by the model. Repeated
    rows are judged each. One pass over the two columns; no shuffle.
    """
    known = _with_grams(pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url")))
    scored = model.transform(known).withColumn("score", vector_to_array("probability")[1])
    named = scored.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.action"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return named.select(F.col("id").alias(id), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
