"""URL filters: logistic regression on hashed character n-grams of host and path, in DataFrame functions only.

The model is trained from a small labelled table (``LABELLED``, or any of the same shape): its n-grams are hashed by the
same expression that scores urls, the regression is solved on the driver, and its weights become a literal array.
Rules come before the model: of the rules that fit a url the longest decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the model's bias; an
empty table gives an empty table; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAMS = 8192, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Names of hosts by label. Either label goes with the same prefixes, domains and plain paths, so only names and telling paths count.
BLOCKED = "cheap-pills casino-bonus spam-mail free-bets adult-cams ads-server click-track payday-loans replica-watches win-prizes xxx-tube viagra-shop slots-win poker-farm link-farm adult-x casino-win pills-online free-casino ads-track bet-win sexy-chat crack-keygen warez-down bonus-spins lottery-winner pharma-pills escort-adult popup-ads spam-farm".split()
ALLOWED = "library cabin mountain basin garden kitchen ocean history courses theatres habitat weather recipes science travel school docs essays open-data city-council gallery football-club hospital archive physics-notes cooking-class women-in-art dental-care bike-repair origin thin-air martin bulletin wild-birds heritage terrain domain latin maintain forest-hosts student thinking children".split()
PREFIXES, DOMAINS = ["https://", "http://www.", "https://m.", "https://blog."], ["example.org", "example.net", "example.com"]
PLAIN = ["/en/1204", "/de/77.html", "/fr/2020/", "/es/5", ""]
TELLING = {1: ["/win/bonus", "/buy-now/cheap", "/free/click"], 0: ["/about", "/article/history", "/contact"]}
LABELLED = [(f"{PREFIXES[i % 4]}{name}.{DOMAINS[i % 3]}{end}", label) for label, names in ((1, BLOCKED), (0, ALLOWED)) for i, name in enumerate(names) for end in (PLAIN[i % 5], PLAIN[(i + 2) % 5], TELLING[label][i % 3])]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(host_col: Column, path_col: Column) -> Column:
    """Distinct buckets of the n-grams of host and path; the two have separate grams."""

    def of(value: Column, mark: str) -> Column:
        chars = F.filter(F.split(F.concat(F.lit("^"), value, F.lit("$")), ""), lambda c: c != "")
        return F.flatten(F.transform(F.array(chars), lambda once: F.concat(*[_windows(once, n, mark) for n in GRAMS])))

    return F.array_distinct(F.transform(F.concat(of(host_col, "h"), of(path_col, "p")), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def _windows(chars: Column, n: int, mark: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - n + 1))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))


@dataclass
class UrlModel:
    """bias, fixed so that a url without known n-grams is allowed, and one weight a bucket."""

    bias: float
    weights: np.ndarray

    def score(self, host_col: Column, path_col: Column) -> Column:
        """Chance that a url is to be blocked."""
        table = F.array(*[F.lit(float(w)) for w in self.weights])
        grams = _grams(host_col, path_col)
        total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g)) / F.sqrt(F.size(grams).cast("double"))
        return 1 / (1 + F.exp(-(total + self.bias)))


def fit_urls(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, strength: float = 0.01, rounds: int = 800) -> UrlModel:
    """Fit on a small labelled table of (url, 1 block or 0 allow), kept on the driver."""
    rows = spark.createDataFrame(LABELLED if labelled is None else labelled, "url string, y int").select("y", _grams(host(F.col("url")), path(F.col("url"))).alias("g")).collect()
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r.y for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r.g] = 1 / np.sqrt(len(r.g))
    bias, weights = -1.0, np.zeros(BUCKETS)
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(x @ weights + bias))) - y
        weights -= 4.0 * (x.T @ off / max(1, len(rows)) + strength / max(1, len(rows)) * weights)
    return UrlModel(float(bias), np.round(weights, 6))


def rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]] | None = None) -> tuple[Column, Column]:
    """(the longest fitting rule's text, its verdict), null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score); the score is null where a rule decides."""
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict}).withColumn("score", F.when(F.col("ruled").isNull(), model.score(F.col("host"), F.col("path"))))
    return rows.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op6_urls(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, fit_urls(pages.sparkSession)).drop("score")
