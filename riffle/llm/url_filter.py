"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into every suffix of its host at a dot, times every prefix of its path of a length
that some rule's path has. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; the whole digest
then confirms, and among the rules that fit, the longest host plus path wins (block over allow on a tie).
Lengths of rule paths are few even for large rule sets, so that the expansion is bounded by host labels times lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
#: Parts that the expressions of one digest, and the pages of one url, are spread over in joins.
SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """verdict, host (A-Z lower-cased, as in urls), path of rules given in the program."""
    lower = str.maketrans(_UPPER, _LOWER)
    return spark.createDataFrame([(v, h.translate(lower), p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """`keep`, host, path, rule and verdict of every row.

    Null urls and urls without :// have empty host and path and get the default verdict; so do all if there are no rules.
    Repeated rows stay. Rules are joined by whatever strategy their size allows; their path lengths (distinct numbers,
    at most the longest path) are the only thing that is collected. An expression of very many sites (such as a top-level
    domain that has a rule) and a url of very many pages are spread over SALTS parts, so that neither is one task's.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    keyed = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    sites = keyed.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    expressions = sites.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
    expressions = expressions.select("host", "path", "h", F.explode("ps").alias("p")).select("host", "path", F.sha2(F.concat("h", "p").cast("binary"), 256).alias("digest"))
    known = rules.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256).alias("rule_digest"))
    short = lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = expressions.withColumns({"k": short("digest"), "salt": F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")})
    hits = spread.join(known.withColumns({"k": short("rule_digest"), "salt": salts}), ["k", "salt"]).where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == "block").alias("blocks"), "verdict")).alias("b"))
    found = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in keep)), F.lit(SALTS)).cast("int"))
    return salted.join(found.withColumn("salt", salts), ["host", "path", "salt"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
