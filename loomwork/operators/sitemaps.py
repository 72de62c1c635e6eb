"""Sitemap discovery and URL filters."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls
from . import html
from ._rows import per_row

#: Where a site keeps its sitemap if robots.txt names none, in the order of trial.
PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap", "/sitemap.html")


def from_robots(rows: DataFrame, text: str = "text") -> DataFrame:
    """``sitemap`` of every line that names one, in any case."""
    line = F.explode(F.split(F.col(text), r"\r?\n"))
    keep = [c for c in rows.columns if c != text]
    found = rows.select(*keep, line.alias("_l")).where(F.startswith(F.lower("_l"), F.lit("sitemap:")))
    return found.select(*keep, F.trim(F.substring("_l", 9, 1 << 30)).alias("sitemap"))


def _entries(tag: str, *fields: str):
    """A fold over XML: the fields of every element of a name, whatever its namespace. Of what isn't well
    formed there are none."""

    def fold(xml: str) -> Iterator[tuple]:
        try:
            root = ElementTree.fromstring(xml.lstrip("\ufeff \t\r\n"))
        except (ElementTree.ParseError, ValueError):
            return
        for x in root.iter():
            if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == tag:
                held: dict[str, str] = {}
                for c in x:
                    if isinstance(c.tag, str):
                        held.setdefault(c.tag.rpartition("}")[2], "".join(c.itertext()).strip())
                yield tuple(held.get(f) or None for f in fields)

    return fold


def parse(rows: DataFrame, xml: str = "content") -> DataFrame:
    """``ordinal, loc, lastmod, changefreq, priority`` of a sitemap's URLs; those without a place go, and
    a sitemap that isn't well-formed XML has none."""
    keep = [c for c in rows.columns if c != xml]
    found = per_row(rows, xml, _entries("url", "loc", "lastmod", "changefreq", "priority"), "ordinal int, loc string, lastmod string, changefreq string, _p string")
    return found.select(*keep, "ordinal", "loc", "lastmod", "changefreq", F.col("_p").try_cast("double").alias("priority")).where("loc is not null")


def children(rows: DataFrame, xml: str = "content") -> DataFrame:
    """``sitemap`` of a sitemap index's entries."""
    return per_row(rows, xml, _entries("sitemap", "loc"), "sitemap string", ordinal=False).where("sitemap is not null")


def from_html(rows: DataFrame, page: str = "content", url: str = "url") -> DataFrame:
    """``ordinal, loc`` of the links of pages that list a site's URLs, in order, each once."""
    keep = [c for c in rows.columns if c not in (page, url)]
    return html.convert(rows, "links", html=page, url=url, keep=tuple(keep)).select(*keep, F.posexplode("links").alias("ordinal", "loc"))


def is_xml(kind, content):
    """Whether a response is a sitemap in XML: by its type, else by how it begins."""
    return F.when(F.contains(kind, F.lit("xml")), True).when(F.contains(kind, F.lit("html")), False).otherwise(F.startswith(F.ltrim(content), F.lit("<?xml")))


def crawl(files: DataFrame, start: DataFrame) -> DataFrame:
    """URLs of all sitemaps that lead on from ``start`` (``url`` and, for instance, a site), by way of
    indexes; each is visited once. ``files`` holds ``url, content``. A round a level; the frontier is
    checkpointed."""
    names = start.columns
    pages = files.select("url", "content")
    visited = start.distinct().checkpoint()
    front = visited
    while not front.isEmpty():
        below = children(pages.join(front, "url")).drop("url").withColumnRenamed("sitemap", "url").select(*names).distinct()
        front = below.join(visited, names, "left_anti").checkpoint()
        visited = visited.unionByName(front).checkpoint()
    return parse(pages.join(visited, "url"))


def discover(sites: DataFrame, files: DataFrame, site: str = "site", min_priority: float | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """``site, loc, lastmod, priority`` of the sites' URLs, each once, with the best priority that it has.
    ``files`` holds what is there: ``url, kind`` (the content type), ``content``. A site's sitemaps are
    those that its robots.txt names, else the first of PLACES that it has; XML leads on through indexes, a
    page of HTML gives its links. Then the filters; ``limit`` is the first URLs of each site."""
    roots = sites.select(F.regexp_replace(site, "/+$", "").alias("site")).distinct()
    robots = files.join(roots.select("site", F.concat("site", F.lit("/robots.txt")).alias("url")), "url").select("site", "content")
    named = from_robots(robots, "content").select("site", F.col("sitemap").alias("url")).where(urls.is_valid(F.col("url")))
    places = roots.join(named.select("site"), "site", "left_anti").select("site", F.posexplode(F.array(*map(F.lit, PLACES))).alias("place", "p"))
    there = files.select("url").distinct().join(places.select("site", "place", F.concat("site", "p").alias("url")), "url")
    start = named.unionByName(first_found(there).select("site", "url")).distinct()
    kinds = files.withColumn("_xml", is_xml(F.col("kind"), F.col("content")))
    listed = crawl(kinds.where("_xml"), start).select("site", "ordinal", "loc", "lastmod", "priority")
    pages = from_html(kinds.where("not _xml").join(start, "url").select("site", "url", "content"))
    both = listed.unionByName(pages.select("site", "ordinal", "loc", F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("double").alias("priority")))
    both = valid(both).groupBy("site", "loc").agg(F.max("lastmod").alias("lastmod"), F.max("priority").alias("priority"))
    both = filter_urls(both, min_priority, include, exclude)
    if limit is not None:
        both = both.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("loc"))).where(F.col("_k") <= limit).drop("_k")
    return both


def first_found(candidates: DataFrame, site: str = "site", ordinal: str = "place") -> DataFrame:
    """Of each site, the rows of the first place that has any."""
    first = F.min(ordinal).over(Window.partitionBy(site))
    return candidates.withColumn("_first", first).where(F.col(ordinal) == F.col("_first")).drop("_first")


def filter_urls(rows: DataFrame, min_priority: float | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int | None = None, loc: str = "loc", ordinal: str = "ordinal") -> DataFrame:
    """By priority (none passes), then any of the includes, none of the excludes, then the first ones."""
    if min_priority is not None:
        rows = rows.where(F.col("priority").isNull() | (F.col("priority") >= min_priority))
    if include:
        rows = rows.where(F.col(loc).rlike("|".join(f"(?:{p})" for p in include)))
    if exclude:
        rows = rows.where(~F.col(loc).rlike("|".join(f"(?:{p})" for p in exclude)))
    return rows.orderBy(ordinal).limit(limit) if limit is not None else rows


def of_domain(rows: DataFrame, base: str, docs_only: bool = False, loc: str = "loc") -> DataFrame:
    host = base.split("://", 1)[-1].split("/", 1)[0]
    rows = rows.where(F.contains(F.col(loc), F.lit(host)))
    return rows.where(F.contains(F.col(loc), F.lit("/docs"))) if docs_only else rows


def valid(rows: DataFrame, loc: str = "loc") -> DataFrame:
    return rows.where(urls.is_valid(F.col(loc)))


def export_line():
    """``loc[,priority][,lastmod]``: what is null leaves no gap."""
    return F.concat_ws(",", "loc", F.col("priority").cast("string"), "lastmod")


def lines(rows: DataFrame, text: str = "text", comments: bool = True) -> DataFrame:
    """``ordinal, url`` of the lines of link files; blank ones go, and those that begin with ``#``."""
    found = rows.select(F.posexplode(F.split(F.col(text), r"\r?\n")).alias("ordinal", "_l"))
    found = found.where(~F.startswith("_l", F.lit("#"))) if comments else found
    return found.select("ordinal", T.strip(F.col("_l")).alias("url")).where("url != ''")
