"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

Only DataFrame functions: rules are column expressions, n-grams are hashed
inside arrays, and training is gradient descent whose sums are aggregates over
a small labelled table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, start of the path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

GRAM = 3
BUCKETS = 512
STEPS = 25
RATE = 2.0
MOMENTUM = 0.9

# The labelled table: each word in each shape, wanted words with label 0 and unwanted ones with 1, and ordinary
# addresses with label 0.
WANTED = "archive article docs guide history journal library museum news paper school science study wiki".split()
UNWANTED = "adclick bet cart casino checkout coupon login popup promo signup slots torrent track warez".split()
ORDINARY = tuple(
    f"{host}/{path}"
    for host in ("example.com", "www.example.net", "m.people.example.org", "blog.travel.example.com", "")
    for path in ("en/12345", "fr/678.html", "de/90817/", "es/4455", "")
)
SHAPES = ("{w}.example/", "site.example/{w}/12345", "www.{w}-site.example/page/77.html", "blog.example/{w}.html")


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, in lower case, and path; both empty for NULL and for a URL without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"\A[^/?#]*+", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"\A[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, as text, and its verdict; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, start, own in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(start)
        rule = F.when(fits, F.lit(own_host + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(own)).otherwise(verdict)
    return rule, verdict


def grams(host: F.Column, path: F.Column) -> F.Column:
    """Buckets of all n-grams of host and path, with an edge mark on either side."""
    letters = F.split(F.concat(F.lit("^"), host, path, F.lit("$")), "")
    run = lambda c, k: F.concat(c, *[F.coalesce(F.get(letters, k + n), F.lit("$")) for n in range(1, GRAM)])
    return F.transform(letters, lambda c, k: F.pmod(F.xxhash64(run(c, k)), F.lit(BUCKETS)).cast("int"))


def margin(buckets: F.Column, weights: F.Column) -> F.Column:
    """The linear score of n-gram buckets; the last weight is the constant."""
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return total / F.sqrt(F.size(buckets)) + F.get(weights, F.lit(BUCKETS))


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label): every word in every shape, and ordinary addresses."""
    rows = [(s.format(w=w), y) for y, words in ((0, WANTED), (1, UNWANTED)) for w in words for s in SHAPES]
    rows += [(url, 0) for url in ORDINARY]
    values = ", ".join(f"('http://{url}', {y})" for url, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def _as_column(weights: list[float]) -> F.Column:
    """The weights as one literal; an array of literals would be code for each."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def train(examples: DataFrame, steps: int = STEPS, rate: float = RATE) -> list[float]:
    """Weights by gradient descent with momentum, all examples in each step; the table is small and stays in one task."""
    host, path = parts(F.col("url"))
    rows = examples.select(grams(host, path).alias("buckets"), F.col("label").cast("double").alias("y")).coalesce(1)
    n = max(rows.count(), 1)
    weights, pace = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    scale = F.sqrt(F.size("buckets"))
    for _ in range(steps):
        known = rows.withColumn("weights", _as_column(weights))
        error = 1 / (1 + F.exp(-margin(F.col("buckets"), F.col("weights")))) - F.col("y")
        slopes = known.select("buckets", (error / scale).alias("g"), error.alias("e"))
        each = slopes.select(F.explode("buckets").alias("bucket"), "g")
        each = each.union(slopes.select(F.lit(BUCKETS), "e"))
        sums = each.coalesce(1).groupBy("bucket").agg(F.sum("g").alias("g")).collect()
        pace = [MOMENTUM * v for v in pace]
        for row in sums:
            pace[row["bucket"]] -= rate * row["g"] / n
        weights = [w + v for w, v in zip(weights, pace, strict=True)]
    return weights


def judge_urls(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    examples: DataFrame | None = None,
) -> DataFrame:
    """One row for each page row: page_id, host, path, rule, verdict, score.

    The longest rule whose host is the URL's or a parent of it and whose path
    begins the URL's decides; where none fits, ``score``, the odds of an
    unwanted URL as a probability, blocks from 0.5 on. NULL, empty and other
    texts without ``://`` have neither host nor path, so no rule fits them.
    Repeated rows and NULL ids stay, an empty table gives an empty table, and
    other columns are not read. ``examples`` (url, label) replace the labelled
    table, which must be small: it is trained on in one task.
    """
    weights = train(labelled(pages.sparkSession) if examples is None else examples)
    host, path = parts(F.col(url))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    scored = cut.withColumn("buckets", grams(F.col("host"), F.col("path"))).withColumn("weights", _as_column(weights))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-margin(F.col("buckets"), F.col("weights")))))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
