"""URL filters: host-suffix and path-prefix expressions, equi-joined on hash prefixes.

Every distinct (host, path) is expanded into the expressions that could equal a
rule: its host suffixes joined to its path prefixes, restricted to the label counts
and path lengths that the rules have. Expressions meet the rules in an equi-join on
the first eight hex digits of their SHA-256; the full digest then confirms, and the
longest rule decides.

Defined results: a null url, or one without ``://``, has an empty host and path and
meets no rule; repeated rows each get the verdict; empty tables give empty results.
Columns of the input other than the key and the url are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path) of the production rule set.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """verdict, host and path of each rule as a table with digests."""
    raw = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return digested_rules(raw)


def digested_rules(raw: DataFrame) -> DataFrame:
    rule = F.concat("host", "path")
    return raw.select(
        "verdict",
        rule.alias("rule"),
        F.size(F.split("host", "\\.")).alias("labels"),
        F.length("path").alias("path_chars"),
        F.length("host").alias("host_chars"),
        F.sha2(rule, 256).alias("rule_digest"),
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every row.

    ``rules`` comes from :func:`rule_table` or :func:`digested_rules`. The longest
    rule wins; between equally long ones that with the longer host, then a block.
    The shapes (label count, path length) of the rules go to the driver: at most 127
    labels times the longest path, however many rules there are.
    """
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    shapes = sorted((r.labels, r.path_chars) for r in rules.select("labels", "path_chars").distinct().collect())
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    grid = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("chars")) for n, k in shapes])
    names = F.split("host", "\\.")
    distinct = parts.where(F.col("host") != "").select("host", "path").distinct()
    expanded = (
        distinct.withColumn("names", names)
        .withColumn("n_names", F.size("names"))
        .withColumn("n_path", F.length("path"))
        .withColumn("shape", F.explode(F.filter(grid, lambda s: (s["labels"] <= F.col("n_names")) & (s["chars"] <= F.col("n_path")))))
        .select(
            "host",
            "path",
            F.sha2(
                F.concat(
                    F.array_join(F.slice("names", F.col("n_names") - F.col("shape.labels") + 1, F.col("shape.labels")), "."),
                    F.substr(F.col("path"), F.lit(1), F.col("shape.chars")),
                ),
                256,
            ).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    hit = (
        expanded.join(rules, expanded["prefix"] == rules["rule_prefix"])
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("chars"), "host_chars", (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return parts.join(hit, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r,
                row_number() OVER () AS rid FROM pages),
parts AS (SELECT rid, page_id, regexp_extract(r, '^[^/?#]*', 0) AS raw, r FROM rest),
split AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(raw) + 1), '^[^?#]*', 0) AS path FROM parts),
hits AS (SELECT s.rid, u.host || u.path AS rule, u.verdict,
                row_number() OVER (PARTITION BY s.rid ORDER BY length(u.host || u.path) DESC, length(u.host) DESC, u.verdict DESC) AS k
         FROM split s JOIN rules u ON (s.host = u.host OR ends_with(s.host, '.' || u.host)) AND starts_with(s.path, u.path))
SELECT s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM split s LEFT JOIN hits h ON h.rid = s.rid AND h.k = 1
"""
