"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

A rule is a host and a path, written together as `host/path`; it fits its host and all
subdomains where the url's path begins with the rule's. Every url is expanded into those of its
host suffixes and path prefixes whose shape (labels, path length) some rule has, so that the
expansion is bounded by the shapes and not by the url. Expressions meet rules by an equi-join on
the first 32 bits of their SHA-256; the full digests then confirm, and of a url's rules the
longest decides (between equal ones block goes before allow).

Null urls and urls without `://` have an empty host and path, fit no rule and get the default
verdict; repeated urls are judged once; an empty rule table leaves all to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Rules of the production query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """A row for each page: page_id, host, path, rule (or null) and verdict."""
    known = rules.where("host is not null and path is not null").select(
        "action", F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")
    )
    shapes = [(r.labels, r.n) for r in known.select("labels", "n").distinct().toLocalIterator()]
    hashed = known.select("rule", "action", F.sha2("rule", 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    parts = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size("parts") >= k) & (F.length("path") >= n),
            F.concat(F.array_join(F.slice("parts", -k, k), "."), F.substring("path", 1, n)),
        )
        for k, n in sorted(shapes)
    ]
    # each url once, however often it stands there; null urls need no lookup
    urls = cut(own.where("url is not null").groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n")))
    best = (
        urls.withColumn("parts", parts)
        .select("url", F.explode(F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")).alias("e"))
        .select("url", F.sha2("e", 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
        .join(hashed.withColumnRenamed("digest", "full"), "short")
        .where("digest = full")
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("block"), "rule", "action")).alias("best"))
    )
    judged = urls.join(best, "url", "left").select("url", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    found = hot_join(own.where("url is not null"), judged, ["url"], urls).select("page_id", "host", "path", "rule", "verdict")
    return found.union(own.where("url is null").select("page_id", "host", "path", F.lit(None).cast("string"), F.lit(default)))
