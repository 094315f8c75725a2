"""URL filters by hash-prefix lookup, in DataFrame functions only.

A url's host gives its suffixes at dots, its path the prefixes that end in "/" and the empty one.
Each pair is an expression; its SHA-256 is the full digest, the first 32 bits are the hash prefix.
A rule (host, path, verdict) is filed under its host and the part of its path up to the last "/",
so every rule that can fit is among the expressions.  Expressions meet rules in an equi-join on the
hash prefix; then the full digest and the rest of the rule's path are confirmed, and the longest
rule wins.  Suffixes and prefixes deeper than the deepest rule are not expanded (two numbers that
one aggregate over the rules gives), so a long url costs no more than the rules can use.

Matches are reduced per (host, path) on the map side before they are shuffled, and joined back to
the rows on these columns; a hot url is one match row, and Spark may split its rows in the join.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z folded; path: from there up to "?",
"#" or the end.  Defined cases: a null url, or one without "://", has the empty host and path and
no rule; an empty path fits only rules with an empty path; ties in length go to the longer host,
then to block, then to the lesser string; equal rules with other verdicts: block wins; null rule
hosts or paths are empty strings, and an empty rule host fits nothing.  Very long urls are judged
whole; rows are never dropped, and repeated rows each get their verdict; an empty table gives no rows,
and without rules every verdict is the default; columns of the result replace columns of the same
names, in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules that may be broadcast: 200 bytes each or so; more are joined by a shuffle.
BROADCAST_RULES = 200_000
ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW

#: The rules of the query: verdict, host, path.
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


def _fold(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return _fold(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add host, path, rule (host and path of the winning rule, or null) and verdict to each row.

    rules: columns verdict, host, path.
    """
    rules = rules.select("verdict", _fold(F.coalesce("host", F.lit(""))).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")).where("r_host <> ''")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))  # block comes after allow
    rules = rules.withColumn("r_digest", _expression(F.col("r_host"), F.regexp_extract("r_path", r"(?s)^.*/", 0)))
    depth = rules.agg(F.max(F.size(F.split("r_host", "\\."))), F.max(F.size(F.split("r_path", "/"))), F.count("*")).first()
    labels, slashes, known = depth[0] or 0, depth[1] or 0, depth[2]
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))

    split = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(split), F.lit(max(labels, 1)))), lambda n: F.concat_ws(".", F.slice(split, -n, n)))
    pieces = F.slice(F.split("path", "/"), 1, max(slashes, 1))
    prefixes = F.concat(
        F.array(F.lit("")),
        F.when(
            F.locate("/", F.col("path")) > 0,
            F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("path", "/")) - 1, F.lit(max(slashes - 1, 1)))), lambda n: F.concat(F.concat_ws("/", F.slice(pieces, 1, n)), F.lit("/"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _expression(h, p))))
    tried = rows.where("host <> ''").select("host", "path", F.explode(digests).alias("digest")).withColumn("short", _short(F.col("digest")))
    side = rules.withColumn("short", _short(F.col("r_digest")))
    side = F.broadcast(side) if known <= BROADCAST_RULES else side
    fits = tried.join(side, "short").where("digest = r_digest and startswith(path, r_path)")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == BLOCK).cast("int"), F.col("r_host"), F.col("r_path"), F.col("r_verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("b"))
    best = best.select("host", "path", F.concat("b.r_host", "b.r_path").alias("rule"), F.col("b.r_verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1_url_hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string")).drop("url")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH rules(r_verdict, r_host, r_path) AS (VALUES {_VALUES}),
after AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM after),
fits AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, '{DEFAULT}') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""

QUERIES = {"op1_url_hash_prefix": op1_url_hash_prefix}
ORACLES = {"op1_url_hash_prefix": ORACLE}
