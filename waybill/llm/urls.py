"""URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could have (its host and parent domains, joined to
the prefixes of its path), the expressions meet the rules on a short prefix of their digest, and a full
digest confirms each hit. The longest rule that fits decides. DataFrame functions only.

Only host depths and path lengths that some rule has are expanded, so a long URL makes no more
expressions than there are (depth, length) pairs of rules. Rules are dealt over ``SALTS`` with the URLs, as
an expression like ``com/`` may be part of most URLs; where the rules are small Spark broadcasts them by its own
check of their size.

Defined results: a URL that is NULL or has no ``://`` has an empty host and path, which no rule fits; rules
without a host are ignored, a NULL path of a rule is empty and fits every path; of equal rules the blocking one
wins; repeated pages give a row each; an empty table of pages or rules works; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: Hex digits of a digest that are joined on.
SHORT = 8


def url_host(url: Column) -> Column:
    """What stands between ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _depth(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (NULL when none fits), verdict.

    ``rules`` has host, path and action (``allow`` or ``block``).
    """
    clean = (rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("action").isNotNull())
             .select("host", F.coalesce("path", F.lit("")).alias("path"), "action")
             .groupBy("host", "path").agg(F.max(F.col("action") == "block").alias("blocks")))
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    listed = (clean.select(
        F.substr(digest, F.lit(1), F.lit(SHORT)).alias("short"), digest.alias("rule_digest"),
        F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length"),
                 "blocks", rule.alias("rule")).alias("found"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    # Shapes of rules: at most as many as rule hosts have depths and rule paths have lengths.
    shapes = clean.agg(F.collect_set(_depth(F.col("host"))).alias("depths"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    depths = F.array(*[F.lit(d) for d in sorted(shapes["depths"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shapes["lengths"])]).cast("array<int>")

    parsed = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                          url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.filter(depths, lambda d: d <= F.size(labels)),
                        lambda d: F.array_join(F.slice(labels, -d, d), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")),
                        lambda n: F.substr(F.col("path"), F.lit(1), n))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    expanded = (parsed.withColumn("expression", F.explode_outer(both))
                .withColumn("digest", F.sha2("expression", 256))
                .withColumn("short", F.substr(F.col("digest"), F.lit(1), F.lit(SHORT)))
                .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
                .drop("expression"))
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    best = (expanded.join(listed, ["short", "salt"], "left")
            .groupBy("row").agg(F.first("key").alias("key"), F.first("host").alias("host"),
                                F.first("path").alias("path"), F.max(confirmed).alias("best")))
    verdict = (F.when(F.col("best").isNull(), F.lit(default))
               .when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow")))
    return best.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                       verdict.alias("verdict"))
