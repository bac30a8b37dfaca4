"""URL filter: rules by host and path, then a blocked Bloom filter before an exact hash join with listed URLs.

Built-in functions only. The filter is a table of 512-bit blocks (eight 64-bit words);
a URL sets one bit in each word of its block. It passes possible hits; the exact join
with the list takes false positives out, so the verdict never depends on the filter.

Rows without a usable URL (null, or no ``://``) have empty host and path, fit no rule
and are allowed. Repeated URLs are judged alike, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.shared import apart, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_PER_BLOCK = 8
BITS_PER_URL = 12
BLOCK_BYTES = 80
#: A filter up to this size is sent to all executors; a larger one is joined by block number.
SENT_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path, and the sorted parameters that aren't for tracking; null without host."""
    name = F.regexp_replace(F.regexp_replace(host(url), "^www[.]", ""), ":(80|443)$", "")
    given = F.split(F.regexp_extract(rest(url), "^[^?#]*[?]([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))), "&")
    way = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(name != "", F.concat(name, way, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits; of equally long ones the first by text."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        found = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(found)
    return found


def _bits(url: Column) -> list[Column]:
    """One bit for each word of the block."""
    spread = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS_PER_BLOCK)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """The blocks that hold a bit, of distinct canonical URLs in the column ``url``."""
    bits = urls.select(_block(F.col("url"), blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("url")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS_PER_BLOCK)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to rows with a URL.

    ``listed``: URLs to block, in the column ``url``, in any spelling; where a rule fits, the rule decides. Columns of
    ``pages`` named host, path, rule or verdict come back with ``_input`` behind them.
    """
    made = ["host", "path", "rule", "verdict", "block", *(f"w{k}" for k in range(WORDS_PER_BLOCK)), "__url", "__block", "__maybe", "__listed"]
    return apart(pages, made, lambda frame: _judged(frame, listed, rules, url), [url])


def _judged(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str) -> DataFrame:
    urls = stored(listed.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct(), "listed-urls")
    blocks = max(1, -(-urls.count() * BITS_PER_URL // (64 * WORDS_PER_BLOCK)))
    known = bloom_filter(urls, blocks)
    known = F.broadcast(known) if blocks * BLOCK_BYTES <= SENT_BYTES else known

    told = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    told = told.withColumn("rule", _longest(rules, F.col("host"), F.col("path"), lambda r: r.text))
    by_rule = told.where("rule is not null").withColumn("verdict", _longest(rules, F.col("host"), F.col("path"), lambda r: r.verdict))
    rest_ = told.where("rule is null").withColumn("__url", canonical(F.col(url)))
    probed = rest_.withColumn("__block", _block(F.col("__url"), blocks)).join(known, F.col("__block") == F.col("block"), "left")
    maybe = F.lit(True)
    for k, bit in enumerate(_bits(F.col("__url"))):
        maybe = maybe & (F.col(f"w{k}").bitwiseAND(bit) == bit)
    probed = probed.withColumn("__maybe", F.coalesce(maybe, F.lit(False)) & F.col("__url").isNotNull())
    columns = [*pages.columns, "host", "path", "rule", "verdict"]
    exact = probed.where("__maybe").join(urls.select(F.col("url").alias("__listed")).hint("shuffle_hash"), F.col("__url") == F.col("__listed"), "left")
    exact = exact.withColumn("verdict", F.when(F.col("__listed").isNotNull(), "block").otherwise("allow"))
    passed = probed.where("not __maybe").withColumn("verdict", F.lit("allow"))
    return by_rule.select(columns).unionByName(exact.select(columns)).unionByName(passed.select(columns))


#: Words that put a host on the derived list, as whole parts between dots and hyphens.
LISTED_HOST = "(^|[.-])(adult|casino|porn|xxx|phish|malware|spam|warez|pills)([.-]|$)"

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def listed_by_host(pages: DataFrame) -> DataFrame:
    """URLs of pages whose host carries a listed word."""
    return pages.where(host(F.col("url")).rlike(LISTED_HOST)).select("url")


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return judge(pages.select("page_id", "url"), listed_by_host(pages), RULES).drop("url")


VERDICTS_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))), '&') AS kept FROM parts
), urls AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') AS name,
         CASE WHEN path = '' THEN '/' ELSE path END AS way FROM named
), full_urls AS (
  SELECT page_id, host, path, CASE WHEN name <> '' THEN name || way || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url FROM urls
), rules(rule, rule_host, rule_path, says) AS (
  VALUES {", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}
), fits AS (
  SELECT page_id, f.host, f.path, url, rule, says, row_number() OVER (PARTITION BY page_id, f.host, f.path, url ORDER BY length(rule) DESC, rule) AS place
  FROM full_urls f LEFT JOIN rules ON (f.host = rule_host OR ends_with(f.host, '.' || rule_host)) AND starts_with(f.path, rule_path)
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN says
  WHEN url IN (SELECT url FROM full_urls WHERE url IS NOT NULL AND regexp_matches(host, '{LISTED_HOST}')) THEN 'block' ELSE 'allow' END AS verdict
FROM fits WHERE place = 1
"""
