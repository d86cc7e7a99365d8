"""URL filter: rules first, else logistic regression on hashed n-grams.

Host and path are taken from the url by pattern functions.  A rule is a host
suffix with a path prefix; it fits its host and all subdomains if the url's
path starts with the rule's path, and the longest rule that fits wins.  Other
urls are judged by a logistic regression on hashed character n-grams of host
and path, trained from a small table of labelled urls (at most ``MOST_LABELS``,
the documented bound of the sample).  Everything runs in the JVM.

Cases: a null url or one without ``://`` has an empty host and path and is
judged by the model; equal urls get equal verdicts; without labelled urls of
both kinds the verdict is the only kind there is, or allow.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Most labelled urls that the model is fitted on.
MOST_LABELS = 20_000
GRAMS, FEATURES = (3, 4), 1 << 13

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.locate("://", F.col(url)) > 0,
                  F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("_rest"), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.col("_rest"), r"(?s)^[^/?#]*([^?#]*)", 1)
    return (df.withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", path).drop("_rest"))


def rule_of(rules: dict[str, str] = RULES):
    """The longest rule that fits columns host and path, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        suffix, slash, prefix = rule.partition("/")
        fits = (((F.col("host") == suffix) | F.col("host").endswith("." + suffix))
                & F.col("path").startswith(slash + prefix))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(df: DataFrame) -> DataFrame:
    """Characters of host and path, with marks at the ends."""
    return df.withColumn("_chars", F.split(F.concat(F.lit("^"), "host", F.lit(" "), "path", F.lit("$")), ""))


def fit(labelled: DataFrame):
    """A model from rows of host, path and label (1.0: block); None if one kind is missing.

    Distinct urls in the order of a hash, at most MOST_LABELS of them."""
    sample = (labelled.select("host", "path", "label").distinct()
              .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(MOST_LABELS))
    sample = sample.cache()
    try:
        kinds = [r[0] for r in sample.select("label").distinct().collect()]
        if len(kinds) < 2:
            return None, (kinds or [0.0])[0]
        stages, columns = [], []
        for n in GRAMS:
            stages += [NGram(n=n, inputCol="_chars", outputCol=f"_g{n}"),
                       HashingTF(numFeatures=FEATURES, binary=True, inputCol=f"_g{n}", outputCol=f"_f{n}")]
            columns.append(f"_f{n}")
        stages += [VectorAssembler(inputCols=columns, outputCol="_features"),
                   LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability",
                                      predictionCol="_prediction", rawPredictionCol="_raw",
                                      regParam=0.01, maxIter=20, standardization=False, aggregationDepth=2)]
        return Pipeline(stages=stages).fit(_grams(sample)), None
    finally:
        sample.unpersist()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES,
          labelled: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, block_score (the model's
    probability of block; null without a model).

    ``labelled`` (url, verdict) trains the model; by default the urls that a
    rule decides are the labelled table."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = with_parts(urls).withColumn("rule", rule_of(rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    decided = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    if labelled is None:
        known = rows.filter("rule IS NOT NULL").select("host", "path", (decided == "block").cast("double").alias("label"))
    else:
        known = with_parts(labelled).select("host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    model, only = fit(known.filter("label IS NOT NULL"))
    if model is None:
        scored = rows.withColumn("block_score", F.lit(None).cast("double"))
        other = F.lit("block" if only == 1.0 else "allow")
    else:
        scored = model.transform(_grams(rows)).withColumn("block_score", vector_to_array("_probability")[1])
        other = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.when(F.col("rule").isNotNull(), decided).otherwise(other).alias("verdict"), "block_score")
