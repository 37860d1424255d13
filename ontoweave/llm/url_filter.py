"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks; a URL sets or tests one bit in each of the four
words of one block. URLs that pass may be listed, and an exact hash join on the canonical
URL removes the false ones. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table

URLS_PER_BLOCK = 24  # listed URLs for each 256-bit block: about 1 in 100 others passes
LARGEST = 1 << 40


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*", 0), *LETTERS)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits the host or a parent of it, and the start of the path."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that fits is the longest
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(rule.text)).otherwise(chosen)
    return chosen


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without a closing slash or ``.html``: scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^(www\.|m\.)", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the four 64-bit words of the block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def blocked_bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w3): the filter of the listed keys."""
    words = listed.select(_block(F.col(key), n_blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    ``listed`` has a column ``url`` of URLs to block. A rule decides where one fits; other
    pages are blocked if their canonical URL is listed. A null URL, or one without ``://``,
    has an empty host and path, fits no rule, is never listed and so is allowed. Each row
    is judged by itself: repeated rows and null ids stay. Empty tables give empty results.
    """
    own = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).filter("key <> ''").distinct()
    own = stored(own, "listed_urls")
    n_blocks = min(max(1, own.count() // URLS_PER_BLOCK), LARGEST)
    bloom = blocked_bloom(own, "key", n_blocks)

    url = F.coalesce(F.col(url_col), F.lit(""))
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdicts = {r.text: r.verdict for r in rules}
    by_rule = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == text, verdict).otherwise(by_rule)
    columns = ["page_id", "host", "path", "rule"]
    ruled = judged.filter("rule is not null").select(*columns, by_rule.alias("verdict"))

    # one row for each page and one for each distinct URL: only the few columns of the probe are shuffled
    open_pages = judged.filter("rule is null").withColumn("key", canonical(F.col("host"), F.col("path")))
    keys = open_pages.select("key").distinct()
    tested = keys.withColumn("block", _block(F.col("key"), n_blocks)).join(bloom, "block")
    for k, mask in enumerate(_masks(F.col("key"))):
        tested = tested.filter(F.col(f"w{k}").bitwiseAND(mask) == mask)
    hits = tested.select("key").join(own, "key", "left_semi").withColumn("hit", F.lit(True))
    rest = open_pages.join(hits, "key", "left").select(
        *columns, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")
    )
    return ruled.unionByName(rest)


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www\.|m\.)', '') || regexp_replace(path, '(\.html|/)$', '') AS key,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
), listed AS (SELECT DISTINCT key FROM judged WHERE contains(host, 'spam') AND key <> '')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op5_url_filters", OP5_SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every URL seen on a host whose name says spam."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.filter(host_of(F.coalesce("url", F.lit(""))).contains("spam")).select("url"))
