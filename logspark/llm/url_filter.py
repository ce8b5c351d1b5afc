"""URL allow and block rules by host suffix and path prefix.

Every url is expanded into the (host suffix, path prefix) expressions that could name it; the
expressions meet the rules on a short prefix of their digest, hits are confirmed on the full
digest, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: (verdict, host, path) as the production rule set has them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hex digits of the digest that the join uses; the rest confirms.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://`` and is lower-cased; both are empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> tuple[DataFrame, list[int], list[int], bool]:
    """The rules with their digests, and the label counts and path lengths that expressions need."""
    table = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "verdict string, host string, path string, rule string")
    table = table.select("verdict", "rule", F.sha2(F.concat_ws("\t", "host", "path"), 256).alias("digest"))
    table = table.withColumns({"short": F.substring("digest", 1, SHORT), "size": F.length("rule")})
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    return table, labels, sorted({len(p) for _, _, p in rules}), True


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null if none fits), verdict.

    A null url, or one without ``://``, has empty host and path and gets the default verdict. Of
    several fitting rules the longest (host and path together) decides; of equally long ones the
    alphabetically last; of equal ones a block. Repeated rows stay apart. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table, labels, lengths, _ = rule_table(spark, rules)
    n = F.size(F.split("host", r"\."))
    suffixes = F.array_distinct(
        F.filter(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels]), lambda x: x.isNotNull())
    )
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull())
    rows = parts.withColumns({"row": F.monotonically_increasing_id(), "suffix": suffixes, "prefix": prefixes})
    expressions = rows.select("row", "page_id", "host", "path", F.explode_outer("suffix").alias("suffix"), "prefix").select(
        "row", "page_id", "host", "path", "suffix", F.explode_outer("prefix").alias("prefix")
    )
    digest = F.sha2(F.concat_ws("\t", "suffix", "prefix"), 256)
    expressions = expressions.select("row", "page_id", "host", "path", digest.alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    hits = expressions.join(small(table), "short", "left")
    confirmed = F.when(F.col("full") == F.col("digest"), F.struct("size", "rule", (F.col("verdict") == "block").alias("block")))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.block"), "block").otherwise("allow"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
