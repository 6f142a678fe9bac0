"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the few rules whose pattern is then run.

A pattern is literal text with `*` for any characters; a leading `||` ties it to a host (that host and all its
subdomains), the rest of the pattern being a prefix of the path. Its literal tokens are its runs of letters and digits
that no `*` or open end can lengthen. A rule is stored under the one that the fewest URLs hold, so that `net` never
fetches a rule that also says `es`. Rules without such a token are stored under the empty token, which every URL has.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no host rule; repeated rows and
repeated URLs are judged once and returned as often as they occur; a very long URL is judged whole; of host rules of one
length, the later by verdict and then by text counts (only equal rules with both verdicts meet so: block wins); columns of
the results' names are replaced, others pass through; a rule table of any size works (a large one is
joined by shuffle, a small one Spark broadcasts by its measured size; a token or URL that very many rows share is split by
Spark's adaptive skew join); an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOST_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
#: What is judged by the method's own patterns where no host rule fits.
SPAM_PATTERNS = ["*-pills.*", "*.casino-*", "*-casino.*", "*/adserver/*", "*.porn-*", "*-porn.*", "*/doubleclick/*"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as text, empty where the URL is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_row(verdict: str, pattern: str, name: str | None, rank: int) -> tuple:
    """(name, verdict, rank, regex over `host#path`, literal tokens); neither part can hold a #."""
    if pattern.startswith("||"):
        host, slash, path = pattern[2:].partition("/")
        body = re.escape(host) + "#" + re.escape(slash + path).replace(r"\*", ".*")
        regex, open_start = "(?s)^(?:[^#]*\\.)?" + body, False
    else:
        regex, open_start = "(?s)" + re.escape(pattern).replace(r"\*", ".*"), True
    literal = pattern.removeprefix("||").lower()
    tokens = [
        m[0] for m in re.finditer(r"[a-z0-9]+", literal)
        if not (m.start() == 0 and open_start) and not (m.end() == len(literal)) and "*" not in (literal[m.start() - 1 : m.start()], literal[m.end() : m.end() + 1])
    ]
    return name, verdict, rank, regex, sorted(set(tokens)) or [""]


def rule_table(spark: SparkSession, host_rules: list[tuple[str, str]], patterns: list[str]) -> DataFrame:
    """Host rules outrank patterns; among host rules the longest wins."""
    rows = [rule_row(v, "||" + r, r, 1 + len(r)) for v, r in host_rules] + [rule_row("block", p, None, 0) for p in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, rank int, regex string, tokens array<string>")


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls(url, ...) with host, path, rule and verdict."""
    host, path = url_parts(F.col("url"))
    each = urls.select("url").distinct().withColumns({"host": host, "path": path})
    key = F.concat_ws("#", "host", "path")
    words = F.array_distinct(F.split(F.lower(key), "[^a-z0-9]+"))
    tokens = each.select("url", key.alias("key"), F.explode(F.array_union(words, F.array(F.lit("")))).alias("token"))

    stored = rules.withColumn("id", F.monotonically_increasing_id())
    in_rules = stored.select(F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(in_rules, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        stored.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
        .groupBy("id", "rule", "verdict", "rank", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    )
    fits = tokens.join(rarest, "token").filter(F.regexp_like("key", F.col("regex")))
    best = fits.groupBy("url").agg(F.max(F.struct("rank", "verdict", "rule")).alias("best"))
    free = "best" + "_" * (1 + max(map(len, urls.columns)))  # a name that no column has
    judged = urls.join(best.withColumnRenamed("best", free), "url", "left").withColumns({"host": host, "path": path})
    return judged.withColumns({"rule": F.col(f"{free}.rule"), "verdict": F.coalesce(f"{free}.verdict", F.lit(default))}).drop(free)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the five host rules and, where none fits, the spam patterns."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, HOST_RULES, SPAM_PATTERNS)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || ' ' || path, '-pills\.|\.casino-|-casino\.|/adserver/|\.porn-|-porn\.|/doubleclick/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
