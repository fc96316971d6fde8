"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Every url is expanded into the expressions a rule could have: the suffixes of its host with as many
labels as some rule's host, times the prefixes of its path as long as some rule's path. Expressions
meet the rules in an equi-join on the first four bytes of their SHA-256; the full digest confirms, and
the longest rule wins (then the longer host, then block before allow).

Distinct (host, path) pairs are judged once and joined back, so a host that holds a third of all rows
costs no more than its distinct paths; the distinct is aggregated before its shuffle.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; no rule
fits: rule is null and the verdict ``default``; repeated rows stay; an empty rule table leaves
``default`` everywhere; clashing column names of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm.common import materialise

#: Rules of the registered query: fixed values (host, path prefix, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Bytes of a digest that are joined on.
PREFIX_BYTES = 4


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules or [("", "", "")], "rule_host string, rule_path string, verdict string").limit(len(rules))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty if there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rules``: rule_host, rule_path, verdict; any number. Only the distinct label counts and path
    lengths of the rules are collected (small integers, bounded by the longest rule)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    labels, lengths = list(shape["labels"]), list(shape["lengths"])
    if not labels:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = rules.select(
        F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"),
        F.col("verdict").alias("rule_verdict"),
    ).withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    distinct = urls.select("host", "path").distinct()
    expressions = (
        distinct.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
        .select("host", "path", "digest", F.substring("digest", 1, 2 * PREFIX_BYTES).alias("short"))
    )
    hits = expressions.join(keyed, "short").where(expressions["digest"] == keyed["digest"])
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")).alias("best")
    )
    best = materialise(best, "best-rules")  # so that Spark can split the join of a very common url
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


ORACLE = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE n = 1
"""
