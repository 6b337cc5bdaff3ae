"""URL verdicts by rules and by redirect equivalence.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's path; the longest rule
wins. Urls that no rule fits take the verdict of their aliases: urls linked by redirects and canonical links form
connected components, and a block inside a component reaches all its members, unless a member is explicitly allowed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path

#: The production rules (fixed values).
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
                           ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the DuckDB twin: absolute targets of a canonical link, and of a refresh, near the attribute that tells it.
CANONICAL = r"""(?i)<link\s[^>]{0,400}?rel\s*=\s*["']?canonical["']?[^>]{0,400}?href\s*=\s*["']([^"'>]+)"""
CANONICAL_REV = r"""(?i)<link\s[^>]{0,400}?href\s*=\s*["']([^"'>]+)["'][^>]{0,400}?rel\s*=\s*["']?canonical"""
REFRESH = r"""(?i)<meta\s[^>]{0,400}?http-equiv\s*=\s*["']?refresh["']?[^>]{0,400}?url\s*=\s*["']?([^"'>\s]+)"""

#: What may hold a target at all; what a browser does not read as tags; the start of a tag that may hold a target; one attribute,
#: or any other letter of a tag; and the target of a refresh. A tag is read attribute by attribute, however many it has.
ANY_TAG = r"(?i)<(?:link|meta|base)[\s/]"
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"(?i)<(link|meta|base)(?=[\s/])")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?|("[^"]*+"|'[^']*+'|.))""", re.S)
_DELAYED = re.compile(r"""(?is)^\s*[0-9.]*\s*(?:[;,]|\s)?\s*(?:url\s*=\s*["']?|(?<=[;,\s])["']?(?=[^\s"'=;,]))([^"']+)""")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null and where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def matched(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(url, rule, verdict) of the longest rule that fits each distinct url; urls without a rule are left out.

    A host is joined by its suffixes, of which only as many are made as the longest rule host has labels.
    """
    spark = urls.sparkSession
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    if not rules:
        return spark.createDataFrame([], "url string, rule string, verdict string")
    table = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("suffix"), F.lit(p).alias("start")) for v, h, p in rules))))
    host, path = host_path(F.col("url"))
    tails = F.array(*(F.substring_index("host", ".", -k) for k in range(1, labels + 1)))
    keys = (urls.select("url").where("url is not null").distinct().withColumns({"host": host, "path": path})
            .select("url", "path", F.explode(F.array_distinct(tails)).alias("suffix")))
    hits = keys.join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("suffix", "start")
    return (hits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("suffix").alias("k"),
                                                   rule.alias("rule"), "verdict")).alias("best"))
            .select("url", "best.rule", "best.verdict"))


def _tags(page: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Name and attributes (the first of each name, without quotes) of the tags that may hold a target, comments, scripts and
    other plain text left out. A tag that does not end gives none."""
    shown = _HIDDEN.sub(" ", page)
    at = 0
    while tag := _TAG.search(shown, at):
        found: dict[str, str] = {}
        at = tag.end()
        while (a := _ATTRIBUTE.match(shown, at)) and not a.group(1):
            at = a.end()
            if a.group(2):
                found.setdefault(a.group(2).lower(), (a.group(3) or "").strip("\"'").strip())
        if a is None:
            return
        at = a.end()
        yield tag.group(1).lower(), found


def targets_of(page: str) -> tuple[str | None, list[str]]:
    """The base, and the targets of canonical links and refreshes, as a page's mark-up spells them."""
    base, out = None, []
    for name, found in _tags(page):
        if name == "base":
            base = base or found.get("href")
        elif name == "link" and "canonical" in found.get("rel", "").lower().split():
            out.append(found.get("href", ""))
        elif name == "meta" and found.get("http-equiv", "").lower() == "refresh" and (m := _DELAYED.match(found.get("content", ""))):
            out.append(m.group(1))
    return base, [t for t in dict.fromkeys(out) if t.strip()]


def _absolute(page: str, base: str | None, target: str) -> str | None:
    """The target as a browser on that page resolves it: entities decoded, joined to the base, absolute ones as they are."""
    target = html.unescape(target).strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return target
    try:
        return urljoin(urljoin(page, html.unescape(base).strip()) if base else page, target) if target else None
    except ValueError:
        return None


def node(url: Column) -> Column:
    """A url as a node of the alias graph: scheme and host in lower case, the rest as it is."""
    head = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substring(url, F.length(head) + 1, F.length(url)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) alias edges of pages, as nodes: canonical links and refreshes in the mark-up, and the url without its fragment.

    Attributes may stand in any order and number, quoted or not; comments, scripts and styles hold no tags; relative targets are
    resolved. A page without such an edge gives none.
    """
    @F.pandas_udf("array<string>")
    def aliases(url: pd.Series, page: pd.Series) -> pd.Series:
        made = []
        for u, p in zip(url, page, strict=True):
            base, found = targets_of(p)
            made.append([x for t in found if (x := _absolute(u, base, t))])
        return pd.Series(made, dtype=object)

    bounded_batches(pages.sparkSession)
    tagged = pages.where(F.col("url").isNotNull() & F.col("html").rlike(ANY_TAG))
    found = tagged.select("url", F.explode(aliases("url", "html")).alias("dst"))
    found = found.union(pages.select("url", F.substring_index("url", "#", 1)))
    return (found.where("url is not null and dst like '%://%'").select(node(F.col("url")).alias("src"), node(F.col("dst")).alias("dst"))
            .where("src <> dst").distinct())


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (the alias group's least url; null alone).

    ``redirects`` adds (src, dst) url pairs, as from a crawl log. A page's own rule decides. Without one: block if a
    member of its alias group is blocked by a rule and none is allowed by one, else allow. Urls that differ in the letter
    case of scheme or host are one member of their group. Null urls have empty host
    and path, no rule, and are allowed; repeated rows get a row each; extra columns are left behind.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    edges = page_edges(rows)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src").cast("string")), node(F.col("dst").cast("string")))).distinct()
    member = connected_components(edges, name="aliases")
    ruled = matched(rows.select("url").union(member.select("node")), rules)
    heard = (member.join(ruled, member["node"] == ruled["url"], "left").groupBy("component")
             .agg(F.coalesce(F.max(F.col("verdict") == "block"), F.lit(False)).alias("blocked"),
                  F.coalesce(F.max(F.col("verdict") == "allow"), F.lit(False)).alias("allowed")))
    alias = member.join(heard, "component").select(F.col("node").alias("alias"), "component",
                                                   (F.col("blocked") & ~F.col("allowed")).alias("spread"))
    host, path = host_path(F.col("url"))
    distinct = (rows.select("url").where("url is not null").distinct().join(ruled, "url", "left")
                .withColumn("alias", node(F.col("url"))).join(alias, "alias", "left").drop("alias"))
    return (rows.select("page_id", "url").join(distinct, "url", "left")
            .select("page_id", host.alias("host"), path.alias("path"), "rule",
                    F.coalesce("verdict", F.when(F.col("spread"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "component"))
