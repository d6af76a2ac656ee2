"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

All steps are DataFrame functions and Spark ML; nothing runs in Python on the executors. The model is fitted to a small
labelled table of URLs (a parameter; ``LABELLED`` by default), its weights are one vector of ``SIZE`` numbers.

Defined results. A null url, or one without ``://``, has an empty host and path, which no rule with a host fits and
which the model judges by its intercept. Page ids are carried along: nulls and repeats give a row each. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, SHORTEST, LONGEST = 1 << 14, 3, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_BLOCKED = """casino-bonus.example.org/win/free-spins slots.luckyspin.example.net/jackpot poker-room.example.org/bonus/777
adult-cams.example.net/xxx/live hot-singles.example.org/dating/xxx xxx-videos.example.net/watch?v=1
cheap-pills.example.org/viagra/order pharmacy-discount.example.net/cialis/buy-now replica-watches.example.org/sale
free-download.example.net/crack/keygen.exe warez.example.org/serial/crack.zip torrent-proxy.example.net/crack/full.rar
click-ads.example.org/banner/track?id=9 adserver.example.net/popup/ads.js track.pixel.example.org/redirect?u=7
loan-fast.example.net/payday/apply forex-signal.example.org/earn-money bet-odds.example.net/bet/live
login-verify.example.org/account/update/secure phish.example.net/paypal/signin/confirm spam-links.example.org/seo/buy-links"""
_ALLOWED = """news.example.org/en/2024/article-12.html blog.example.net/de/beitrag/77 www.example.org/fr/article/381
m.example.net/en/20117 library.example.org/books/history science.example.net/papers/1204 docs.example.org/guide/install
www.example.net/en/35332/ city.example.org/de/39547.html school.example.net/courses/math recipes.example.org/es/sopa
weather.example.net/en/forecast museum.example.org/fr/collection/14 wiki.example.net/en/physics travel.example.org/de/berlin
forum.example.net/thread/8812 journal.example.org/en/issue/4 www.example.org/about archive.example.net/en/1999/03
health.example.org/en/advice/sleep garden.example.net/de/12440"""
#: (url, 1 for blocked): fixed examples.
LABELLED = [(f"https://{u}", 1) for u in _BLOCKED.split()] + [(f"https://{u}", 0) for u in _ALLOWED.split()]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def grams(text: Column) -> Column:
    """All character n-grams of three to five characters."""
    def of(n):
        last = F.length(text) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(SHORTEST, LONGEST + 1)])


def features(df: DataFrame) -> DataFrame:
    """Adds ``vector`` from ``host`` and ``path``."""
    df = df.withColumn("grams", grams(F.concat(F.lit("^"), F.col("host"), F.lower("path"), F.lit("$"))))
    return HashingTF(numFeatures=SIZE, binary=True, inputCol="grams", outputCol="vector").transform(df).drop("grams")


def labelled_table(spark: SparkSession, rows=LABELLED) -> DataFrame:
    both = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in rows])
    return spark.range(1).select(F.inline(both))


def fit(labelled: DataFrame):
    """Logistic regression on a table (url, label); the table is small, so one partition holds it."""
    rows = features(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")).coalesce(1)
    return LogisticRegression(featuresCol="vector", labelCol="label", regParam=0.01, maxIter=60, aggregationDepth=2).fit(rows)


def best_rule(host: Column, path: Column, rules) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for rule, verdict in rules:
        of, _, below = rule.partition("/")
        fit_host = (host == of) | host.endswith(f".{of}")
        fits.append(F.when(fit_host & path.startswith(f"/{below}"), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability that the url is unwanted)."""
    model = fit(labelled if labelled is not None else labelled_table(pages.sparkSession))
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    scored = model.transform(features(df)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "score")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null without a rule): ``judge`` without the model."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = best_rule(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("verdict"))
