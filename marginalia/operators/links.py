"""URLs, link graphs and a level-by-level crawl."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# fixed values: endings of files that aren't pages, and what counts as content on known hosts
BINARY = "pdf zip tar gz png jpg jpeg gif svg ico webp ipynb txt css js json xml mp4 webm mp3 woff woff2 ttf eot rst".split()
CONTENT = {"d2l.ai": r"/chapter_", "atcold.github.io": r"/week\d"}


def host(url: Column) -> Column:
    """Host without user, port and `www.`, in lower case; null without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def default_prefix(url: Column) -> Column:
    """The first path segment on hosts that many sites share; else everything."""
    first = F.regexp_extract(path(url), r"^/+([^/]+)", 1)
    return F.when(host(url).endswith(".github.io") & (first != ""), F.concat(F.lit("/"), first)).otherwise(F.lit("/"))


def in_scope(url: Column, scope_host: Column, prefix: Column) -> Column:
    ending = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    return url.rlike(r"(?i)^https?://") & (host(url) == scope_host) & path(url).startswith(prefix) & ~ending.isin(BINARY)


def content_pattern(url: Column, override: str | None = None) -> Column:
    """The pattern for a page's host: the user's, else the known one, else null."""
    if override is not None:
        return F.lit(override)
    out = F.lit(None).cast("string")
    for h, p in CONTENT.items():
        out = F.when(host(url) == h, F.lit(p)).otherwise(out)
    return out


def is_content(url: Column, override: str | None = None) -> Column:
    p = content_pattern(url, override)
    return p.isNull() | F.regexp(path(url), p)


def slug(url: Column, title: Column) -> Column:
    """Parent and stem of the path; the title's letters where the stem says nothing."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[A-Za-z0-9]+$", "")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    named = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    plain = F.when(parent != "", F.concat(parent, F.lit("_"), stem)).otherwise(stem)
    return F.when((stem == "") | (stem == "index"), F.when(named != "", named).otherwise(F.lit("page"))).otherwise(plain)


def discover(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, position, link): the targets of a page's anchors, resolved; not mail, script, phone, fragment."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    raw = pages.where(F.col(html).isNotNull()).select(key, F.posexplode(hrefs).alias("position", "href")).where(~F.lower(F.trim("href")).rlike(r"^(?:mailto:|javascript:|tel:|#|$)"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def join(base: str, href: str) -> str | None:
            try:
                return urljoin(base, href.strip())
            except ValueError:
                return None

        for pdf in batches:
            yield pdf.assign(link=[join(b, h) for b, h in zip(pdf[key], pdf["href"])]).drop(columns=["href"])

    return raw.mapInPandas(run, f"{key} string, position int, link string").where("link is not null")


def markdown_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, label, target) of links in markdown, images not counted."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<!!)\[[^\]]+\]\([^)]*\)"), F.lit(0))
    each = docs.select(key, F.posexplode(found).alias("position", "m"))
    return each.select(key, "position", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)]*)\)$", 1).alias("target"))


def fetch_page(url: str, timeout: float = 20.0, agent: str = "marginalia", render: Callable[[str, float], str] | None = None) -> str:
    """A page's text, decoded as it declares, else as UTF-8, else as Latin-1. `render` stands for a browser,
    for pages that scripts make. An error status raises."""
    if render is not None:
        return render(url, timeout)
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
        raw, stated = r.read(), r.headers.get_content_charset()
    named = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", raw[:4096], re.I)
    for name in (stated, named and named[1].decode(), "utf-8"):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def fetcher(timeout: float = 20.0, agent: str = "marginalia", delay: float = 0.0, render: Callable[[str, float], str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A `fetch` for `crawl`: (url) to (url, html), with null html for a page that fails. Each host is one
    group, so that its pages come one after the other with a delay between; a level's hosts go in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import time

        pages = []
        for i, url in enumerate(pdf["url"]):
            if i and delay:
                time.sleep(delay)
            try:
                pages.append(fetch_page(url, timeout, agent, render))
            except Exception:
                pages.append(None)
        return pd.DataFrame({"url": pdf["url"], "html": pages})

    return lambda urls: urls.select("url").groupBy(host(F.col("url"))).applyInPandas(run, "url string, html string")


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))


def robots(urls: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(origin, rules): the robots file of each site once; null where there is none."""
    sites = urls.select(origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    got = fetch(sites.select(F.concat("origin", F.lit("/robots.txt")).alias("url")))
    return sites.join(got.select(origin(F.col("url")).alias("origin"), F.col("html").alias("rules")), "origin", "left")


def allowed(urls: DataFrame, rules: DataFrame, agent: str = "marginalia") -> DataFrame:
    """The urls that their site's rules (origin, rules) let `agent` fetch; without rules, all."""

    @F.pandas_udf("boolean")
    def may(url: pd.Series, text: pd.Series) -> pd.Series:
        read: dict[str, RobotFileParser] = {}
        out = []
        for u, t in zip(url, text):
            if t is None:
                out.append(True)
                continue
            if t not in read:
                read[t] = RobotFileParser()
                read[t].parse(t.splitlines())
            out.append(read[t].can_fetch(agent, u))
        return pd.Series(out, dtype="boolean")

    j = urls.withColumn("_o", origin(F.col("url"))).join(rules.select(F.col("origin").alias("_o"), F.col("rules").alias("_r")), "_o", "left")
    return j.where(F.col("_r").isNull() | may("url", "_r")).drop("_o", "_r")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 100, include: str | None = None, levels: int = 50, agent: str | None = None) -> DataFrame:
    """Pages reached breadth first from `seeds` (url): (url, level, html, content).

    Level by level: the frontier is fetched, its links are filtered by scope and content, and those
    seen before are dropped by an anti join. `fetch` maps (url) to (url, html), with null html for
    a failed page, which costs no budget. Within a level pages are taken in order of their
    addresses, so the budget cuts the same pages every time. With an `agent`, robots rules of the
    seeds' sites are fetched once and obeyed.
    """
    seeds = seeds.select(normal(F.col("url")).alias("url")).distinct()
    scopes = seeds.select(host(F.col("url")).alias("h"), default_prefix(F.col("url")).alias("prefix")).distinct()
    rules = None if agent is None else cut_lineage(robots(seeds, fetch))
    may = lambda urls: urls if rules is None else allowed(urls, rules, agent)
    seen, frontier, got = seeds, may(seeds), None
    left = max_pages
    for level in range(levels):
        fetched = cut_lineage(fetch(frontier).where("html is not null").orderBy("url").limit(left).withColumn("level", F.lit(level)).withColumn("content", is_content(F.col("url"), include)))
        n = fetched.count()
        got = fetched if got is None else got.unionByName(fetched)
        left -= n
        if not n or left <= 0:
            break
        links = discover(fetched).select(normal(F.col("link")).alias("url")).distinct().withColumn("h", host(F.col("url")))
        scoped = links.join(scopes, "h").where(in_scope(F.col("url"), F.col("h"), F.col("prefix")) & is_content(F.col("url"), include)).select("url").distinct()
        frontier = cut_lineage(may(scoped.join(seen, "url", "left_anti")))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return got
