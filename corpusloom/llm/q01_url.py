"""op1: every url of `pages` under the site rules and a set of pattern rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import prepare
from corpusloom.llm.url_filter import ALLOW, BLOCK, PatternRule, SiteRule, judge

SITES = [
    SiteRule("org", "/", ALLOW),
    SiteRule("example.org", "/es/", BLOCK),
    SiteRule("example.org", "/en/1", BLOCK),
    SiteRule("com", "/fr/", ALLOW),
    SiteRule("com", "/de/", BLOCK),
]
#: Feed copies, deep listing pages and mobile mirrors are blocked; English mobile pages are let through.
PATTERNS = [PatternRule(x) for x in ("?utm_source=feed|", "?page=2&ref=", "||m.*/es/", "||blog.tionsh.example.^", "@@||m.*/en/*.html|", "/de/*#top|")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, SITES, PATTERNS).select("page_id", "host", "path", "rule", "verdict")


_SITE_SQL = " UNION ALL ".join(f"SELECT '{s.host}' sh, '{s.path}' sp, '{s.verdict}' sv" for s in SITES)
_PATTERN_SQL = " UNION ALL ".join(f"SELECT '{p.regex}' rx, {p.allows} al" for p in PATTERNS)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH site AS ({_SITE_SQL}), pat AS ({_PATTERN_SQL}),
u AS (SELECT DISTINCT coalesce(url, '') url FROM pages),
p AS (SELECT url, {_LOWER.format("regexp_extract(url, '(?s)://([^/?#]*)', 1)")} host,
             regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) path FROM u),
s AS (SELECT url, max(struct_pack(n := length(sh || sp), v := sv, t := sh || sp)) b FROM p, site
      WHERE (host = sh OR ends_with(host, '.' || sh)) AND starts_with(path, sp) GROUP BY url),
m AS (SELECT url, bool_or(al) al FROM p, pat WHERE host <> '' AND regexp_matches({_LOWER.format("url")}, '(?s)' || rx) GROUP BY url)
SELECT page_id, host, path, s.b.t AS rule,
       coalesce(s.b.v, CASE WHEN NOT m.al THEN 'block' END, 'allow') AS verdict
FROM pages JOIN p ON coalesce(pages.url, '') = p.url LEFT JOIN s ON s.url = p.url LEFT JOIN m ON m.url = p.url
"""
