"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The classifier learns from a small labelled URL table. Host and path, each between marks for their ends, are cut
into character n-grams that are hashed to ``buckets``; a URL's features are its n-gram counts over the square root
of their number, so that long URLs don't outweigh short ones. Training is one SQL expression that folds over the
labelled rows again and again (stochastic gradient descent in a fixed order); scoring is an expression too.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and the classifier's
score of an empty host and path; a null id is kept; repeated rows each give a row; of the labelled table at most ``MOST_LABELLED`` rows
are taken, more are an error; rows of it with a null URL or label are not learnt from; without any the verdict is
allow; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, table

#: Rules of the query: verdict, host, path. Fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BUCKETS = 1 << 11
SIZES = (3, 4)
EPOCHS = 20
RATE = 0.5
MOST_LABELLED = 1_000

#: Names of the labelled URLs that the query learns from, to block and to allow; each stands under every prefix.
#: Fixed values.
BAD_NAMES = (
    "casino-win", "best-casino-bonus", "free-bets", "free-bets-now", "ads-track", "track-ads", "spam-farm",
    "link-farm-spam", "cheap-pills", "pills-cheap", "adult-x", "x-adult-video",
)
GOOD_NAMES = (
    "library", "gardening", "weather", "thorton", "theatre", "recipes", "science-news", "nation", "open-data",
    "thestation", "then-and-now", "this-other", "question", "whither", "healthy", "ashore",
)
PREFIXES = ("", "www.", "m.", "blog.")
ENDS = (".example.com", ".example.org")
PATHS = (
    "/en/12", "/fr/825?page=2&ref=x", "/de/99", "/es/120/", "/en/960.html", "/fr/25#top", "/es/671?utm_source=feed",
    "/de/3", "/en/4708", "/es/56#top", "/de/741/", "/fr/8.html",
)
LABELLED = tuple(
    (label, f"https://{prefix}{name}{ENDS[(j + k) % 2]}{PATHS[(5 * k + 3 * j) % len(PATHS)]}")
    for label, names in ((1, BAD_NAMES), (0, GOOD_NAMES))
    for k, name in enumerate(names)
    for j, prefix in enumerate(PREFIXES)
) + tuple((0, f"{name}{end}") for name in ("", "notes", "readme", "index") for end in ("", ".txt"))  # no host, no harm


def host_and_path(url: Column) -> Column:
    """A struct of the lower-cased host and the path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(host.alias("host"), path.alias("path"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of its text and verdict, else null; of equal ones the first by text."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column, buckets: int = BUCKETS, sizes: Sequence[int] = SIZES) -> Column:
    """Buckets of the character n-grams of host and path."""

    def of_size(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(starts, lambda k: F.pmod(F.xxhash64(F.substr(text, k, F.lit(n))), F.lit(buckets)).cast("int"))

    def cut(text: Column) -> Column:
        return F.concat(*[of_size(text, n) for n in sizes])

    return F.concat(
        let(F.concat(F.lit("h<"), host, F.lit(">")), cut), let(F.concat(F.lit("p<"), path, F.lit(">")), cut)
    )


def logit(found: Column, weights: Column, bias: Column) -> Column:
    total = F.aggregate(found, F.lit(0.0), lambda s, k: s + F.get(weights, k))
    return bias + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def train(labelled: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """Weights by bucket and then the bias, from ``url`` and ``label``; at most ``MOST_LABELLED`` rows."""
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("double").alias("y"))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    parts = rows.select("url", "y", host_and_path(F.col("url")).alias("u"))
    examples = parts.select(
        F.xxhash64("url").alias("order"), "url", "y", grams(F.col("u.host"), F.col("u.path"), buckets).alias("found")
    )
    size = F.greatest(F.size("found"), F.lit(1))
    count = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda b: F.size(F.filter("found", lambda g: g == b)) / F.sqrt(size),
    )
    dense = examples.select("order", "url", "y", F.concat(count, F.array(F.lit(1.0))).alias("x"))
    packed = dense.agg(F.array_sort(F.collect_list(F.struct("order", "url", "y", "x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        total = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return let(
            rate * (row["y"] - 1 / (1 + F.exp(-total))), lambda by: F.zip_with(w, row["x"], lambda a, b: a + by * b)
        )

    start = F.array_repeat(F.lit(0.0), buckets + 1)
    often = F.flatten(F.array_repeat(F.col("rows"), epochs))
    return packed.select(F.aggregate(often, start, step).alias("weights")).first()["weights"]


def judge(pages: DataFrame, weights: Sequence[float], rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the classifier's ``score`` to block."""
    buckets = len(weights) - 1
    fixed = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    parts = pages.select("page_id", host_and_path(F.col("url")).alias("u")).select("page_id", "u.host", "u.path")
    x = logit(grams(F.col("host"), F.col("path"), buckets), fixed, F.lit(weights[-1]))
    scored = parts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", 1 / (1 + F.exp(-x)))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "score"
    )


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "label int, url string")


def op1_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))
