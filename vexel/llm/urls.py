"""URL filters: rules for hosts and paths, matched by equi-joins on short hashes.

A rule has a host, a path and a verdict. It fits its host and all subdomains, where the url's path starts with the
rule's path; of the rules that fit, the longest one wins (host and path together, then the host; equal rules: block
before allow). Each distinct (host, path) is unfolded into expressions: each suffix of the host by labels, with each
prefix of the path that ends at a slash, and the empty one. A rule is filed under its own such expression, its path
cut after the last slash. Expressions and rules meet by the first 32 bits of a SHA-256 digest; then the full digest
and the rest of the rule's path are compared. Expressions with more labels or slashes than any rule has can't meet
one and aren't made; that is no cap on matches.

Nulls and the like: a null url, or one without "://", has an empty host and path, which no rule fits; a rule with
a null host or path fits nothing; repeated pages each get their row; pages may have any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder).cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (verdict, host, path) with their digests; the same host and path count once, block before allow."""
    r = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    folder = F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    r = r.withColumn("digest", _digest(F.col("host"), folder)).withColumn("short", _short(F.col("digest")))
    return r.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", "digest", "short")


def expressions(pairs: DataFrame, labels: int, slashes: int) -> DataFrame:
    """Distinct (host, path) unfolded to the digests of their expressions."""
    parts = F.split("host", r"\.")
    suffix = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
    n = F.least(F.size(F.split("path", "/")) - 1, F.lit(slashes))
    folders = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))))
    e = pairs.withColumn("suffix", F.explode(suffix)).withColumn("folder", F.explode(folders))
    e = e.withColumn("digest", _digest(F.col("suffix"), F.col("folder"))).withColumn("short", _short(F.col("digest")))
    return e.select("host", "path", "digest", "short")


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """urls with columns host, path, rule and verdict added (rule: null if none fits).

    Rules are grouped and deduplicated first, so a rule is one row; small rule tables are broadcast by Spark's own
    check of their size, larger ones are shuffled by the short hash, where adaptive execution splits the expressions
    of very common hosts. What comes back to the rows is joined by (host, path), one row each."""
    taken = {"host", "path", "rule", "verdict"} & set(urls.columns)
    pages = urls.drop(*taken).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    filed = rule_table(rules)
    most = filed.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes")).first()
    pairs = pages.select("host", "path").distinct()
    e = expressions(pairs, most.labels or 1, most.slashes or 0)
    met = e.alias("e").join(filed.alias("r"), "short").where((F.col("e.digest") == F.col("r.digest")) & F.col("path").startswith(F.col("rule_path")))
    strength = F.struct((F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("h"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(strength).alias("best"))
    j = pages.alias("p").join(best.alias("b"), ["host", "path"], "left")
    return j.select(*[F.col(f"p.`{c}`") for c in pages.columns], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
ORACLE = rf"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule FROM cut)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)} ELSE '{DEFAULT}' END AS verdict
FROM ruled"""
