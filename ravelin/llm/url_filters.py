"""URL filters [native]: host-suffix and path-prefix expressions of each URL, equi-joined on short hash prefixes.

Only DataFrame functions run here. A rule ``(action, host, path)`` fits its
host and every subdomain where the URL's path starts with the rule's path.

* Each distinct (host, path) is expanded into host suffixes (of as many labels
  as some rule's host has) times path prefixes (of lengths that some rule's path
  has), so the work for a URL grows with its length and not with its square.
* Expressions meet rules on the first four bytes of their SHA-256, a short key
  that keeps the exchanged rows small; a full digest confirms the match.
* The longest rule (host and path together) wins; of equal length the longer
  host, then ``block``.

Nulls: a null URL, or one without ``://``, has an empty host and path and gets
the default verdict. Rows that repeat are judged each; of rules that tie in
length the longer host wins, then ``block``; extra columns are left
out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_HEX = 8
RULE_SCHEMA = "action string, host string, path string"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row for each expression, with its precedence; of repeated expressions ``block`` stays."""
    e = F.concat(F.col("host"), F.col("path"))
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("allow", "block"))
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(
            F.substring(_digest(F.concat_ws("\n", "host", "path")), 1, SHORT_HEX).alias("short"),
            _digest(F.concat_ws("\n", "host", "path")).alias("full"),
            F.struct(F.length(e).alias("size"), F.length("host").alias("host_size"), F.col("action"), e.alias("rule")).alias("hit"),
        )
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict."""
    own = pages.select(F.col(key).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # The distinct path lengths of rules: at most as many as a path has characters.
    sizes = sorted(r[0] for r in rules.where(F.col("path").isNotNull()).select(F.length("path")).distinct().collect())
    if not sizes:
        return own.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # So are the numbers of labels of their hosts: only suffixes with as many can meet a rule.
    depths = sorted(r[0] for r in rules.where(F.col("host").isNotNull()).select(_labels(F.col("host"))).distinct().collect())
    lengths, depth = F.array(*[F.lit(n) for n in sizes]), F.array(*[F.lit(n) for n in depths])
    empty, named = own.where("host = ''"), own.where("host <> ''")
    targets = named.select("host", "path").distinct()
    suffixes = targets.withColumn("labels", F.explode(F.filter(depth, lambda n: n <= _labels(F.col("host"))))).withColumn("suffix", F.expr("substring_index(host, '.', -labels)"))
    expressions = suffixes.withColumn("prefix_size", F.explode(F.filter(lengths, lambda n: n <= F.length("path")))).select(
        "host", "path", _digest(F.concat_ws("\n", F.col("suffix"), F.expr("substring(path, 1, prefix_size)"))).alias("full")
    )
    wanted = prepared_rules(rules)
    met = expressions.withColumn("short", F.substring("full", 1, SHORT_HEX)).join(wanted, ["short"]).where(expressions["full"] == wanted["full"])
    best = met.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    # Pages without a host meet no rule, and don't all meet in one task.
    judged = named.join(best, ["host", "path"], "left").unionByName(empty, allowMissingColumns=True)
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.action"), F.lit(default)).alias("verdict"))
