"""Operator 1, URL filters, in DataFrame functions only.

Every distinct (host, path) is expanded into the expressions host suffix + path prefix that a rule could have, the
expressions are equi-joined with the rules on short prefixes of their SHA-256 digests, and the full digests confirm a hit.
The longest rule that fits decides.  Without a rule a URL is allowed.

Null urls and urls without ``://`` have an empty host and path, which no rule fits.  Repeated rows stay as they are.
Rules are rows (host string, path string, action string) with action block or allow; of equal rules block wins.  An empty
rule table allows everything, and an empty table of urls gives none.  Urls of any length are read whole.  Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables up to this many rows are broadcast (about 2 MB); larger ones are joined by a shuffle.
BROADCAST_RULES = 10_000
#: Hexadecimal digits of the digest that are joined on
SHORT = 8
RESULT = ("host", "path", "rule", "verdict")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def url_filters(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "action")
        .where("h is not null and action in ('allow', 'block')")
        .groupBy("h", "p")
        .agg(F.max("action").alias("action"))
        .select("action", F.concat("h", "p").alias("rule"), _labels(F.col("h")).alias("labels"), F.length("p").alias("prefix"))
        .withColumn("digest", F.sha2("rule", 256))
    )
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    small = F.broadcast if few else lambda df: df
    # the shapes of rules: for each number of labels the lengths of paths, at most as many as rules or places in a path
    shapes = rules.groupBy("labels").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    right = rules.select(F.left("digest", F.lit(SHORT)).alias("short"), "digest", "rule", "action")

    pages = urls.drop(*RESULT).withColumns({"host": url_host(F.col(f"`{url}`")), "path": url_path(F.col(f"`{url}`"))})
    suffixes = pages.where("host != ''").select("host", "path").distinct().withColumn("labels", F.explode(F.sequence(F.lit(1), _labels(F.col("host")))))
    suffixes = suffixes.withColumn("suffix", F.call_function("substring_index", "host", F.lit("."), -F.col("labels")))
    fits = F.transform(F.filter("prefixes", lambda k: k <= F.length("path")), lambda k: F.concat("suffix", F.left("path", k)))
    expressions = (
        suffixes.join(small(shapes), "labels")
        .select("host", "path", F.explode(fits).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("full"))
        .withColumn("short", F.left("full", F.lit(SHORT)))
    )
    hits = (
        expressions.join(small(right), "short")
        .where("full = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    kept = [c for c in pages.columns if c not in ("host", "path")]
    return pages.join(hits, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
