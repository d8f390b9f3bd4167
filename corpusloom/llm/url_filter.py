"""URL filters: pattern rules indexed by their rarest literal token.

A rule set has two layers. Site rules name a host and a path prefix and allow or block what lies
below them; the longest that fits decides. Where none fits, pattern rules decide: each is a wildcard
pattern with literal tokens, filed under the token that fewest rules share. A URL is cut into tokens
once, its tokens fetch the rules filed under them, and only those run their regular expression. Rules
without a literal token are tried on every URL. An exception rule outranks blocking rules.

The work of a URL doesn't depend on the size of the rule set, and no row is shuffled: the rules travel
to the tasks while their size is under `INDEX_BYTES`. A larger rule set is joined to the distinct
URLs on the token instead (`judge_by_join`), with the same verdicts.

Nulls: a null URL, or one without `://`, has an empty host and path; no rule fits it and it is allowed. Rows
that repeat get a row each, an empty table gives none. Of site rules of equal length the blocking one decides,
of pattern rules the first by text. A very long URL is judged whole; other columns stay, but for those that
are named as the new ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rule sets up to so many bytes of text go to the tasks as an index.
INDEX_BYTES = 32 << 20
#: Keys over which URLs are dealt that meet the rules without a token.
SALTS = 64
TOKEN = re.compile(r"[a-z0-9]{2,}")
ALLOW, BLOCK = "allow", "block"
VERDICT_FIELDS = (("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()))


@dataclass(frozen=True)
class SiteRule:
    """Allow or block a host with its subdomains below a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A wildcard pattern over the lower-cased URL.

    `*` stands for any run, `^` for a separator or the end, a leading `||` for the start of the host or
    of one of its labels, a leading or trailing `|` for the start or end of the URL; a leading `@@`
    makes an exception. Everything else is literal.
    """

    text: str

    @property
    def allows(self) -> bool:
        return self.text.startswith("@@")

    @property
    def body(self) -> str:
        return lowered(self.text.removeprefix("@@"))

    @property
    def regex(self) -> str:
        body, head, tail = self.body, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        # A run at an open end says nothing, and costs a search from every place of a long URL.
        body = body if head else body.lstrip("*")
        body = body if tail else body.rstrip("*")
        special = {"*": ".*", "^": r"(?:[^a-z0-9_.%\-]|$)"}
        return head + "".join(special.get(c) or (c if c.isalnum() else "\\" + c) for c in body) + tail

    def tokens(self) -> list[str]:
        """Literal tokens that are whole tokens of every URL the pattern fits."""
        body, found = self.body, []
        anchored_start, anchored_end = body.startswith("|"), body.endswith("|")
        core = body.strip("|")
        for m in TOKEN.finditer(core):
            before, after = core[m.start() - 1 : m.start()], core[m.end() : m.end() + 1]
            if (before == "*" or not before and not anchored_start) or (after == "*" or not after and not anchored_end):
                continue  # an open end could lengthen the token
            if before and before.isascii() and before.isalnum() or after and after.isascii() and after.isalnum():
                continue
            found.append(m[0])
        return found


class RuleIndex:
    """Site rules by host, pattern rules by rarest token."""

    def __init__(self, sites: Iterable[SiteRule], patterns: Iterable[PatternRule]):
        self.sites: dict[str, list[SiteRule]] = {}
        for s in sites:
            self.sites.setdefault(s.host, []).append(s)
        patterns = list(dict.fromkeys(patterns))
        seen = Counter(t for p in patterns for t in set(p.tokens()))
        self.by_token: dict[str, list[tuple[re.Pattern, PatternRule]]] = {}
        for p in patterns:
            key = min(set(p.tokens()), key=lambda t: (seen[t], -len(t), t), default="")
            self.by_token.setdefault(key, []).append((re.compile(p.regex, re.DOTALL), p))

    def filed(self) -> list[tuple[str, str, bool, str]]:
        """(token, regex, allows, text) of every pattern rule; token '' for those without one."""
        return [(t, p.regex, p.allows, p.text) for t, rules in self.by_token.items() for _, p in rules]

    def site(self, host: str, path: str) -> SiteRule | None:
        fit, at = [], 0
        while at <= len(host):
            fit += [s for s in self.sites.get(host[at:], ()) if path.startswith(s.path)]
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return max(fit, key=lambda s: (len(s.text), s.verdict, s.text), default=None)

    def pattern(self, url: str) -> PatternRule | None:
        """The rule that decides: the first exception by text, else the first blocking rule by text."""
        url = lowered(url)
        hits = [p for t in ("", *sorted(set(TOKEN.findall(url)))) for r, p in self.by_token.get(t, ()) if r.search(url)]
        return min(hits, key=lambda p: (not p.allows, p.text), default=None)


def lowered(url: str) -> str:
    return url.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first `://` up to `/`, `?` or `#`; then up to `?` or `#`."""
    m = _PARTS.search(url) if url is not None else None
    return (lowered(m[1]), m[2]) if m else ("", "")


def judge(pages: DataFrame, sites: list[SiteRule], patterns: list[PatternRule], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and pattern (the pattern rule that decided, if one did).

    A column of pages with one of these names is replaced. One row out for each row in.
    """
    if sum(len(s.text) for s in sites) + sum(len(p.text) for p in patterns) > INDEX_BYTES:
        return judge_by_join(pages, sites, patterns, url)
    names = [n for n, _ in VERDICT_FIELDS]
    kept = pages.drop(*[n for n in names if n != url])
    at = kept.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(sites, patterns)
        for b in batches:
            rows = [verdict(index, u) for u in b.column(at).to_pylist()]
            new = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(VERDICT_FIELDS) if names[i] != url]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[n for n in names if n != url]])

    schema = StructType([*kept.schema.fields, *[StructField(n, StringType()) for n in names if n != url]])
    return kept.mapInArrow(run, schema)


def verdict(index: RuleIndex, url: str | None) -> tuple[str, str, str | None, str, str | None]:
    host, path = split_url(url)
    if s := index.site(host, path):
        return host, path, s.text, s.verdict, None
    p = index.pattern(url) if host else None
    return host, path, None, ALLOW if p is None or p.allows else BLOCK, p and p.text


def judge_by_join(pages: DataFrame, sites: list[SiteRule], patterns: list[PatternRule], url: str = "url") -> DataFrame:
    """As judge, for rule sets of any size: distinct URLs meet the rules on their tokens and labels."""
    spark = pages.sparkSession
    index = RuleIndex(sites, patterns)
    u = F.col("u")
    low = F.translate(u, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.translate(F.regexp_extract(u, r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = pages.select(F.col(f"`{url}`").alias("u")).distinct().where(u.isNotNull())
    urls = urls.select(u, low.alias("low"), host.alias("h"), F.regexp_extract(u, r"(?s)://[^/?#]*([^?#]*)", 1).alias("p"))
    rules = spark.createDataFrame(index.filed() or [("", "(?!)", False, "")], "token string, regex string, allows boolean, text string")
    # Every URL has the empty token: it is dealt over SALTS keys, and rules without a token stand under each.
    salt = lambda of: F.when(F.col("token") == "", of).otherwise(F.lit(0))
    rules = rules.withColumn("salt", F.explode(F.when(F.col("token") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("low", F.lit("[a-z0-9]{2,}"), F.lit(0))))
    hits = urls.where("h <> ''").select("u", "low", F.explode(tokens).alias("token")).withColumn("salt", salt(F.pmod(F.hash("u"), F.lit(SALTS)))).join(rules, ["token", "salt"]).where(F.expr("regexp_like(low, concat('(?s)', regex))"))
    by_pattern = hits.groupBy("u").agg(F.min(F.struct((~F.col("allows")).alias("nallows"), F.col("text"))).alias("x")).select("u", F.col("x.text").alias("pattern"), (~F.col("x.nallows")).alias("pallows"))
    site = spark.createDataFrame([(s.host, s.path, s.verdict) for s in sites] or [("", "\0", ALLOW)], "sh string, sp string, sv string")
    labels = F.expr("transform(sequence(1, size(split(h, '[.]'))), i -> concat_ws('.', slice(split(h, '[.]'), i, size(split(h, '[.]')))))")
    text = F.concat("sh", "sp")
    by_site = urls.select("u", "p", F.explode(labels).alias("sh")).join(site, "sh").where(F.col("p").startswith(F.col("sp"))).groupBy("u").agg(F.max(F.struct(F.length(text).alias("n"), F.col("sv"), text.alias("t"))).alias("s")).select("u", F.col("s.sv").alias("sv"), F.col("s.t").alias("rule"))
    found = urls.select("u", "h", "p").join(by_site, "u", "left").join(by_pattern, "u", "left")
    names = [n for n, _ in VERDICT_FIELDS]
    kept = pages.drop(*[n for n in names if n != url])
    return kept.join(found, kept[url].eqNullSafe(found["u"]), "left").select(
        *[kept[c] for c in kept.columns],
        F.coalesce("h", F.lit("")).alias("host"), F.coalesce("p", F.lit("")).alias("path"), "rule",
        F.coalesce("sv", F.when(~F.col("pallows"), BLOCK), F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"),
    )
