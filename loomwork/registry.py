"""Queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import safety, urls
from .functions import text as T
from .functions import vectors as V
from .operators import chunking, embedding, html, search, sitemaps, stats, store
from .plans import pipeline
from .sources import files
from .streaming import requests as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"))


def _marked(spark, sf_dir) -> DataFrame:
    """Documents whose lines become headings of changing levels."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (i * 7) % 4), F.lit(" "), x))
    return _docs(spark, sf_dir).select("doc_id", "url", F.array_join(lines, "\n").alias("md"))


def _events(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")


_SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_W = f"list_filter(string_split_regex(%s, '{_SPACE}+'), lambda x: x <> '')"
_DOCS = "docs as (select doc_id, text content, 'https://' || source || '.example.com/d/' || doc_id url from documents)"
_MARKED = f"{_DOCS}, marked as (select doc_id, url, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: repeat('#', (((i - 1) * 7) % 4)::int) || ' ' || x), chr(10)) md from docs)"
_EVENTS = "ev as (select *, event_type <> 'error' ok, epoch_us(ts) t from events)"
_PATH = r"regexp_extract(%s, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_DOT = "list_sum(list_transform(list_zip(%s, %s), lambda z: z[1]::double * z[2]::double))"


# Chunking


@_query(
    f"""with {_DOCS}, w as (select *, {_W % 'content'} ws from docs),
    s as (select *, unnest(range(0, len(ws), 160)) s from w where len(ws) > 0),
    c as (select *, array_to_string(ws[s + 1:s + 200], ' ') chunk from s)
    select doc_id, (s // 160)::int as "position", md5(url || ':text:' || s) id, chunk, len(ws[s + 1:s + 200])::int word_count, length(chunk)::int char_count,
    regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) "domain" from c"""
)
def chunk_text_words(spark, sf_dir):
    """Plain-text chunks of all documents."""
    return chunking.text_windows(_docs(spark, sf_dir)).drop("content", "url")


@_query(
    f"""with {_DOCS}, w as (select *, {_W % 'content'} ws, length(content) n from docs),
    k as (select *, greatest(1000 * len(ws) // n, 1) width from w where len(ws) > 0),
    l as (select *, width - least(200 * len(ws) // n, width - 1) step from k),
    s as (select *, unnest(range(0, len(ws), step)) s from l)
    select doc_id, (s // step)::int as "position", array_to_string(ws[s + 1:s + width], ' ') chunk from s"""
)
def chunk_sliding(spark, sf_dir):
    return chunking.sliding(_docs(spark, sf_dir).drop("url"), "content").drop("content")


@_query(
    rf"""with t as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) c from documents where length(text) > 0), p as (select doc_id, c, string_split_regex(c, '\n\s*\n') ps from t),
    f as (select doc_id, list_reduce(list_transform(ps, lambda x: {{'done': []::varchar[], 'now': x}}), lambda a, x: case when a.now <> '' and length(a.now) + length(x.now) + 2 > 1000
      then {{'done': list_append(a.done, a.now), 'now': a.now[greatest(length(a.now) - 199, 1):] || chr(10) || chr(10) || x.now}}
      else {{'done': a.done, 'now': case when a.now = '' then x.now else a.now || chr(10) || chr(10) || x.now end}} end) a from p where length(c) > 1000 and len(ps) > 1),
    w as (select doc_id, c, {_W % 'c'} ws from p where length(c) > 1000 and len(ps) = 1), n as (select *, greatest(1000 * len(ws) // length(c), 1) width from w where len(ws) > 0),
    l as (select *, width - least(200 * len(ws) // length(c), width - 1) step from n), s as (select *, unnest(range(0, len(ws), step)) s from l),
    packed as (select doc_id, case when a.now = '' then a.done else list_append(a.done, a.now) end cs from f union all select doc_id, [c] from p where length(c) <= 1000)
    select doc_id, unnest(range(0, len(cs)))::int as "position", unnest(cs) chunk from packed union all select doc_id, (s // step)::int, array_to_string(ws[s + 1:s + width], ' ') from s"""
)
def chunk_recursive(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("content", "\n", "\n\n").alias("content"))
    return chunking.recursive(rows).drop("content")


@_query(
    rf"""with {_MARKED}, ls as (select doc_id, unnest(string_split(md, chr(10))) l, generate_subscripts(string_split(md, chr(10)), 1) i from marked),
    h as (select *, case when regexp_matches(l, '^ {{0,3}}#{{1,6}} ') then length(regexp_extract(l, '^ *(#+)', 1)) else 0 end lv from ls),
    g as (select *, sum((lv > 0)::int) over (partition by doc_id order by i) g from h),
    h0 as (select doc_id, g, min(i) i0 from g where lv = 0 and g = 0 and regexp_matches(l, '[^\t-\r\x1c-\x1f\x85\p{{Z}}]') group by all),
    keep as (select g.* from g left join h0 on g.doc_id = h0.doc_id where g.g > 0 or g.i >= h0.i0)
    select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int "section", level, body from (
    select doc_id, g, max(lv)::int "level", string_agg(l || chr(10), '' order by i) body from keep group by doc_id, g)"""
)
def markdown_sections(spark, sf_dir):
    return chunking.sections(_marked(spark, sf_dir), "md").select("doc_id", "section", "level", "body")


@_query()
def chunk_semantic(spark, sf_dir):
    return chunking.semantic(_marked(spark, sf_dir), "md", "url", 500, 100)


@_query()
def chunk_breaks(spark, sf_dir):
    return chunking.breaks(_marked(spark, sf_dir).drop("url"), "md")


@_query()
def chunk_dispatch(spark, sf_dir):
    plain = _docs(spark, sf_dir).select("url", "content")
    return chunking.chunk(plain.unionByName(_marked(spark, sf_dir).select(F.concat("url", F.lit("/md")).alias("url"), F.col("md").alias("content"))))


@_query(
    rf"""with w as (select doc_id, {_W % 'text'} ws from documents),
    n as (select doc_id, len(ws) n, len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}'))) u, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{N}}'))) d,
    len(list_filter(ws, lambda x: regexp_matches(lower(x), '{"|".join(T.TERMS)}'))) k from w)
    select doc_id, round(case when n = 0 then 0 else least((u * 5 + d * 3 + k * 7) / (n * 10.0::double), 1) + least(n / 100.0::double, 0.2) end, 9) density from n"""
)
def semantic_density(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.round(T.density(F.col("text")), 9).alias("density"))


# Text and hashes


@_query(
    rf"""select doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) clean, len({_W % 'text'})::int words, length(text)::int chars, sha256(text) sha, md5(doc_id || ':x') chunk_id,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') xml,
    case when length(text) > 200 then text[1:200] || '...' else text end preview from documents"""
)
def text_basics(spark, sf_dir):
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", T.clean(t).alias("clean"), T.word_count(t).alias("words"), F.length(t).alias("chars"), F.sha2(t, 256).alias("sha"),
        F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":x"))).alias("chunk_id"), T.escape_xml(t).alias("xml"), T.preview(t).alias("preview"),
    )


@_query(
    """select item_id, case when trim(text) <> '' and length(text) <= 200 then replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') end q from benchmark"""
)
def query_escape(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", T.escape_query(F.col("text"), 200).alias("q"))


@_query("select page_id, regexp_replace(html, '<[/!?a-zA-Z][^>]*>', '', 'g') plain from pages")
def strip_tags(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


def _redaction_sql() -> str:
    out = "text"
    for pattern, mark in safety.PATTERNS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), mark.replace("$", "\\"))
    return f"select doc_id, {out} redacted from documents"


@_query(_redaction_sql())
def redact_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", safety.redact(F.col("text")).alias("redacted"))


@_query("select event_id, case when event_type in ('click', 'view') then '[REDACTED]' else props end a, event_type b from events")
def redact_headers(spark, sf_dir):
    name = F.when(F.col("event_type").isin("click", "view"), F.lit("Cookie")).otherwise(F.lit("Accept"))
    headers = safety.redact_headers(F.map_from_arrays(F.array(name, F.lit("Host")), F.array("props", "event_type")))
    return _read(spark, sf_dir, "events").select("event_id", headers[name].alias("a"), headers["Host"].alias("b"))


@_query("select user_id, 'Security event: audit - key=token: [REDACTED], user=' || user_id line from (select distinct user_id from events)")
def audit_lines(spark, sf_dir):
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    details = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("key"), F.lit("token: ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return users.select("user_id", safety.audit_line(F.lit("audit"), details).alias("line"))


@_query(
    r"""select page_id, not regexp_matches(html, '(?is)<script.*?>.*?</script>|javascript:|on(?:error|load)=|eval\(|document\.cookie|<(?:iframe|object|embed)') safe,
    (contains(lower(html), '<html') or contains(lower(html), '<body')) and len(regexp_extract_all(lower(html), '<script')) <= 20 valid_html from pages"""
)
def page_safety(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", safety.is_safe(F.col("html")).alias("safe"), safety.is_html(F.col("html")).alias("valid_html"))


@_query(
    """select event_id, case event_type when 'click' then value > 0 and value <= 100 when 'view' then false when 'signup' then true else false end ok from events"""
)
def typed_validation(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "rate").when(F.col("event_type") == "view", "path").when(F.col("event_type") == "signup", "format").otherwise("other")
    value = F.when(F.col("event_type") == "click", F.col("value").cast("string")).when(F.col("event_type") == "view", "../x").otherwise("JSON")
    return _read(spark, sf_dir, "events").select("event_id", safety.validate(kind, value).alias("ok"))


@_query(
    """select event_id, case when event_id % 3 = 0 then (event_id % 50 + 1)::double when event_id % 3 = 1 then 90.0::double else 5.0::double end wait from events"""
)
def retry_after(spark, sf_dir):
    k = F.col("event_id")
    header = F.when(k % 3 == 0, (k % 50 + 1).cast("string")).when(k % 3 == 1, F.lit("Mon, 01 Jan 2024 00:01:30 GMT")).otherwise(F.lit("soon"))
    return _read(spark, sf_dir, "events").select("event_id", safety.retry_after(header, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("wait"))


@_query(
    """with u as (select distinct user_id from events), d as (select user_id, sha256('loom:' || user_id || ':fast') h from u)
    select user_id, round(list_reduce(list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', h[i]) - 1)::bigint), lambda a, b: (a * 16 + b) % 10000) / 100.0::double, 2) bucket from d"""
)
def rollout_bucket(spark, sf_dir):
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.round(T.rollout(F.col("user_id"), "fast", "loom"), 2).alias("bucket"))


# URLs


@_query(
    rf"""with p as (select page_id, url, trim({_PATH % 'url'}, '/') path, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) host from pages)
    select page_id, host "domain", regexp_matches(url, '^(?i:https?)://[^/?#]+') valid,
    regexp_replace(regexp_replace('https://user:pw@' || host || '/a?b=1#frag', '#.*$', ''), '^([^:/?#]+://)[^/?#@]*@([^/?#@]*)', '\1\2') sanitized,
    case when ends_with(n, '.json') then n else regexp_replace(n, '\.[^.]*$', '') || '.json' end file_name,
    regexp_replace(coalesce(nullif(string_split(path, '/')[-1], ''), host), '[\\/*?:"<>|]', '_', 'g') || '.xml' short_name
    from (select *, regexp_replace(coalesce(nullif(path, ''), 'index'), '[\\/*?:"<>|]', '_', 'g') n from p)"""
)
def url_functions(spark, sf_dir):
    u = F.col("url")
    dirty = F.concat(F.lit("https://user:pw@"), urls.host(u), F.lit("/a?b=1#frag"))
    return _read(spark, sf_dir, "pages").select(
        "page_id", urls.domain(u).alias("domain"), urls.is_valid(u).alias("valid"), urls.sanitize(dirty).alias("sanitized"), urls.file_name(u, F.lit("json")).alias("file_name"), urls.short_name(u, F.lit("xml")).alias("short_name")
    )


@_query(
    r"""select page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/x/c.html?q=1' up, regexp_extract(url, '^([^:/?#]+:)', 1) || '//h/z' scheme, 'http://o/' absolute from pages"""
)
def url_resolve(spark, sf_dir):
    u = F.concat(F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1), F.lit("/x/y/z.html"))
    return _read(spark, sf_dir, "pages").select("page_id", urls.resolve(u, F.lit("../c.html?q=1")).alias("up"), urls.resolve(u, F.lit("//h/z")).alias("scheme"), urls.resolve(u, F.lit("http://o/")).alias("absolute"))


@_query(
    """with s as (select page_id ordinal, url loc, case when page_id % 5 = 0 then null else (page_id % 10) / 10.0::double end priority from pages)
    select ordinal, loc from s where (priority is null or priority >= 0.3) and regexp_matches(loc, 'example\\.com|/en/') and not regexp_matches(loc, '#') order by ordinal limit 100""".replace("\\\\", "\\")
)
def filter_urls(spark, sf_dir):
    rows = _sitemap(spark, sf_dir)
    return sitemaps.filter_urls(rows, 0.3, (r"example\.com", "/en/"), ("#",), 100).select("ordinal", "loc")


def _sitemap(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("loc"), F.when(F.col("page_id") % 5 != 0, (F.col("page_id") % 10) / 10.0).alias("priority"), F.lit("2024-01-01").alias("lastmod"))


@_query("select page_id ordinal, url || case when page_id % 5 = 0 then '' else ',' || ((page_id % 10) / 10.0::double) end || ',2024-01-01' line from pages")
def export_urls(spark, sf_dir):
    return _sitemap(spark, sf_dir).select("ordinal", sitemaps.export_line().alias("line"))


@_query(
    """select page_id site, replace(url, '&', '&amp;') raw, unnest(range(0, page_id % 7 + 1))::int ordinal,
    case when unnest(range(0, page_id % 7 + 1)) < page_id % 7 then 'http://a/' || unnest(range(0, page_id % 7 + 1)) || '?"&<' else url end loc,
    case when unnest(range(0, page_id % 7 + 1)) = page_id % 7 then '2024-01-02' end lastmod, case when unnest(range(0, page_id % 7 + 1)) = page_id % 7 and page_id % 2 = 0 then 0.5::double end priority
    from pages where page_id % 5 <> 0"""
)
def sitemap_parse(spark, sf_dir):
    """Sitemaps of as many entries as a page's number leaves over, and one more; every fifth isn't well formed."""
    raw = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    priority = F.when(F.col("page_id") % 2 == 0, F.lit("0.5")).otherwise(F.lit("high"))
    many = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 7).cast("int")), lambda i: F.when(i < F.col("page_id") % 7, F.concat(F.lit("<url><loc>http://a/"), i.cast("string"), F.lit("?&quot;&#38;<![CDATA[<]]></loc></url>"))).otherwise(""))
    entry = F.concat(F.lit("<?xml version='1.0'?><urlset>"), F.array_join(many, ""), F.lit("<url><loc> "), raw, F.lit(" </loc><lastmod>2024-01-02</lastmod><priority>"), priority, F.lit("</priority></url>"), F.when(F.col("page_id") % 5 != 0, "</urlset>").otherwise("</urlse>"))
    rows = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), raw.alias("raw"), entry.alias("content"))
    return sitemaps.parse(rows).select("site", "raw", "ordinal", "loc", "lastmod", "priority")


@_query("select page_id site, url || '/s.xml' sitemap from pages where page_id % 2 = 0")
def robots_sitemaps(spark, sf_dir):
    body = F.concat(F.lit("User-agent: *\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("SiteMap:  "), "url", F.lit("/s.xml \n"))).otherwise(F.lit("# sitemap: no\n")))
    return sitemaps.from_robots(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), body.alias("text")))


@_query("select url from pages where page_id % 2 = 0")
def link_lines(spark, sf_dir):
    text = F.concat(F.lit("# c\n\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("  "), "url", F.lit(" \n"))).otherwise(F.lit("#x")))
    return sitemaps.lines(_read(spark, sf_dir, "pages").select(text.alias("text"))).select("url")


# HTML

_ROOT = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@_query(rf"""select page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda x: {_ROOT} || x))) links from pages""")
def html_links(spark, sf_dir):
    return html.convert(_read(spark, sf_dir, "pages"), "links", keep=("page_id",))


@_query(
    r"""select page_id, trim(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) title,
    'page ' || page_id description, 'a, "b" & c' keywords, case when page_id % 2 = 0 then 'T ' || page_id else '' end og_title, url || '/i.png' og_image, url from pages"""
)
def html_metadata(spark, sf_dir):
    """Pages with meta elements: names and properties, with entities, the first of a name counting."""
    k = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta name="description" content="page '), k, F.lit('"><META NAME=keywords CONTENT=\'a, "b" &amp; c\'><meta name="description" content="again"><meta property="og:image" content="'), F.col("url"), F.lit('/i.png">'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="T '), k, F.lit('">'))).otherwise(F.lit('<meta property="og:title">')),
    )
    pages = _read(spark, sf_dir, "pages").withColumn("html", F.concat(head, "html"))
    return html.convert(pages, "metadata", keep=("page_id",)).select("page_id", "metadata.*")


@_query("select page_id, regexp_extract(html, '(?s)<article>.*</article>') main_html from pages")
def html_main(spark, sf_dir):
    return html.convert(_read(spark, sf_dir, "pages"), "main_html", keep=("page_id",))


@_query(
    """select page_id, regexp_replace(html, '(?s)<(?:style|script|nav|footer)>.*?</(?:style|script|nav|footer)>|<div class="ad">.*?</div>', '', 'g') clean_html
    from (select page_id, replace(html, '<script>var t="</p>";', '<script>') html from pages)"""
)
def html_clean(spark, sf_dir):
    return html.convert(_read(spark, sf_dir, "pages"), "clean_html", keep=("page_id",))


@_query()
def html_document(spark, sf_dir):
    rows = html.convert(_read(spark, sf_dir, "pages"), "document", keep=("page_id",))
    return rows.select("page_id", "document", html.render(F.col("document")).alias("markdown"), F.to_json("document", {"pretty": "true"}).alias("json"), html.document_xml(F.col("document")).alias("xml"))


@_query()
def html_markdown(spark, sf_dir):
    return html.convert(_read(spark, sf_dir, "pages"), "markdown", keep=("page_id",))


@_query()
def html_formats(spark, sf_dir):
    return html.convert(_read(spark, sf_dir, "pages"), "json", "xml", "blocks", "text", keep=("page_id",))


@_query()
def markdown_document(spark, sf_dir):
    return html.markdown_document(_marked(spark, sf_dir), "md", "url", keep=("doc_id",))


_STRIP = r"regexp_replace(%s, '^[\t-\r\x1c-\x1f\x85\p{Z}]+|[\t-\r\x1c-\x1f\x85\p{Z}]+$', '', 'g')"


@_query(
    rf"""with {_DOCS}, h as (select doc_id, coalesce(nullif({_STRIP % "string_split(content, chr(10))[1]"}, ''), doc_id::varchar) from_head, source from docs join documents using (doc_id))
    select doc_id, case doc_id % 3 when 0 then from_head when 1 then 'My Page ' || doc_id else source || '.example.com' end title from h"""
)
def document_titles(spark, sf_dir):
    """By the first heading, the URL's last part, or the host, as there is one."""
    k, number = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    rows = _docs(spark, sf_dir).withColumn("content", F.when(k == 0, F.concat(F.lit("# "), "content")).otherwise(F.lit("no heading")))
    url = F.when(k == 1, F.concat(F.lit("https://h/a/my-page_"), number, F.lit("/"))).when(k == 2, F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1)).otherwise(F.col("url"))
    return rows.select("doc_id", T.title(F.col("content"), url).alias("title"))


@_query("select page_id, len(regexp_extract_all(html, '<a '))::int links, len(regexp_extract_all(html, '<p>'))::int paragraphs from pages")
def page_counts(spark, sf_dir):
    rows = html.convert(_read(spark, sf_dir, "pages"), "kinds", keep=("page_id",))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind))
    return rows.select("page_id", count("a").alias("links"), count("p").alias("paragraphs"))


# Embeddings

_TERMS = "terms as (select doc_id id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]{2,}')) term from documents)"


@_query(
    f"""with {_TERMS}, c as (select id, term, count(*) n from terms where term not in ({", ".join(repr(w) for w in embedding.STOP_WORDS)}) group by all),
    v as (select term, sum(n) total, count(*) df from c group by term order by total desc, term limit 1024),
    w as (select id, term, n * (ln((1 + (select count(*) from documents))::double / (1 + df)) + 1) w from c join v using (term))
    select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 9) weight from w"""
)
def tf_idf(spark, sf_dir):
    return embedding.tf_idf(_read(spark, sf_dir, "documents")).select("id", "term", F.round("weight", 9).alias("weight"))


@_query(
    f"""with w as (select doc_id id, {_W % 'lower(text)'} ws from documents), t as (select id, unnest(ws) term, generate_subscripts(ws, 1) p from w),
    c as (select id, term, count(*) n, min(p) p from t group by all), v as (select term from (select term, min((id, p)) s from c group by term) order by s limit 512)
    select id, term, round(n / sqrt(sum(n * n) over (partition by id)), 9) weight from c join v using (term)"""
)
def count_vectors(spark, sf_dir):
    return embedding.count_vectors(_read(spark, sf_dir, "documents")).select("id", "term", F.round("weight", 9).alias("weight"))


@_query("with c as (select distinct sha256(text) h from documents where doc_id % 2 = 0) select distinct sha256(text) text_hash, text from documents where sha256(text) not in (select h from c)")
def cache_misses(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.lit("hashed").alias("model"), F.sha2("text", 256).alias("text_hash"))
    return embedding.missing(docs, cache, "hashed")


@_query(
    rf"""with w as (select doc_id, {_W % "text"} ws from documents), v as (select doc_id, list_transform(range(1, 9), lambda k: len(list_filter(ws, lambda x: length(x) % 8 = k - 1))::double) v from w),
    n as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v)
    select doc_id, v embedding, round(case when n > 0 then 1.0 else 0.0 end, 4)::double norm, true has_embedding from n"""
)
def embed_chunks(spark, sf_dir):
    """A model of word lengths; its vectors, and the table that stands for them where vectors aren't kept."""

    def lengths(texts):
        out = np.zeros((len(texts), 8))
        for r, text in enumerate(texts):
            for word in text.split():
                out[r, len(word) % 8] += 1
        return out

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = embedding.embed(docs, lengths, normalize=False).withColumn("e", F.col("embedding").cast("array<double>"))
    rows = embedding.unit(rows).withColumn("norm", F.round(V.norm(F.col("embedding")), 4))
    return files.without_vectors(rows).select("doc_id", F.col("e").alias("embedding"), "norm", "has_embedding")


@_query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) norm from embeddings")
def vector_norms(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


# Search

_COS = f"({_DOT % ('a.embedding', 'b.embedding')}) / (sqrt({_DOT % ('a.embedding', 'a.embedding')}) * sqrt({_DOT % ('b.embedding', 'b.embedding')}))"


@_query(
    f"""with q as (select embedding from embeddings where vec_id = 0)
    select vec_id, label, round(score, 6) score from (select a.vec_id, a.label, {_COS} score from embeddings a, q b where a.label in (0, 1, 2) and a.label <> 1)
    where score >= 0.1 order by score desc, vec_id limit 10"""
)
def vector_top_k(spark, sf_dir):
    points = _read(spark, sf_dir, "embeddings")
    query = [float(x) for x in points.where("vec_id = 0").first()["embedding"]]
    where = {"must": [{"key": "label", "range": {"gte": 0, "lte": 2}}], "must_not": [{"key": "label", "match": {"value": 1}}]}
    return search.top_k(points, query, 10, 0.1, where).select("vec_id", "label", F.round("score", 6).alias("score"))


@_query(
    f"""select query_id, id, rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, id)::int as "rank" from (
    select b.vec_id query_id, a.vec_id id, round({_COS}, 9) score from embeddings a, embeddings b where b.vec_id % 100 = 0)) where rank <= 5 and score >= 0"""
)
def vector_top_k_each(spark, sf_dir):
    """Every hundredth vector as a query against all."""
    points = _read(spark, sf_dir, "embeddings")
    queries = points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_each(points, queries, 5, 0.0).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@_query(
    f"""with p as (select a.vec_id id, b.vec_id query_id, round({_DOT % ('a.embedding', 'b.embedding')}, 9) score from embeddings a, embeddings b where b.vec_id % 100 = 0),
    e as (select *, row_number() over (partition by query_id order by score desc, id) k from p)
    select id, round(max(score), 6) score, arg_min(query_id, (-score, query_id)) query_id from e where k <= 5 and score >= 0 group by id order by max(score) desc, id limit 10"""
)
def vector_probe(spark, sf_dir):
    """The ten best points over all probes, by dot product."""
    points = _read(spark, sf_dir, "embeddings")
    probes = points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.probe(points, probes, metric="dot").withColumn("score", F.round("score", 6))


@_query(
    rf"""with d as (select doc_id, list_distinct({_W % 'lower(text)'}) t, len({_W % 'lower(text)'}) n from documents), q as (select item_id, list_distinct({_W % 'lower(text)'}) q from benchmark),
    u as (select doc_id, n, unnest(t) w from d), v as (select item_id, len(q) m, unnest(q) w from q), c as (select item_id, doc_id, count(*) c from u join v using (w) group by all),
    s as (select item_id, doc_id, round(0.8::double * 0.7 + coalesce(c, 0)::double / len(q) * 0.2 + least(1.0, 200.0::double / greatest(n, 1)) * 0.1, 9) score from q cross join d left join c using (item_id, doc_id))
    select item_id, doc_id, rank, round(score, 6) score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as "rank" from s) where rank <= 10"""
)
def rerank(spark, sf_dir):
    """The ten best of all documents for every item of the benchmark."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0.8).alias("score"), F.col("text").alias("content"))
    return search.rerank_each(hits, queries, 10).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@_query(
    rf"""with d as (select doc_id, source, text, list_distinct({_W % 'lower(text)'}) t, len({_W % 'lower(text)'}) n from documents), q as (select item_id, list_distinct({_W % 'lower(text)'}) q from benchmark),
    u as (select doc_id, unnest(t) w from d), v as (select item_id, unnest(q) w from q), c as (select item_id, doc_id, count(*) c from u join v using (w) group by all),
    s as (select item_id, source, text, round(0.8::double * 0.7 + c::double / len(q) * 0.2 + least(1.0, 200.0::double / greatest(n, 1)) * 0.1, 9) score, doc_id from c join q using (item_id) join d using (doc_id)),
    k as (select *, row_number() over (partition by item_id order by score desc, doc_id) k from s where score >= 0.6),
    r as (select *, row_number() over (partition by item_id order by score desc, source, text) r from k where k <= 3)
    select item_id, string_agg('Source: ' || source || chr(10) || 'Content: ' || text, chr(10) || chr(10) order by r) context from r group by item_id"""
)
def source_context(spark, sf_dir):
    """For every item of the benchmark the three documents that rerank best, with their sources."""
    docs = _read(spark, sf_dir, "documents")
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = search.rerank_each(docs.select(F.col("doc_id").alias("id"), F.lit(0.8).alias("score"), F.col("text").alias("content")), queries, 3)
    hits = best.join(docs.select(F.col("doc_id").alias("id"), "text", "source"), "id")
    return search.source_context(hits, ["query_id"], content="text", source="source").withColumnRenamed("query_id", "item_id")


@_query("""select source, string_agg('DOCUMENT ' || r || ':' || chr(10) || text, chr(10) || chr(10) order by r) context from (select source, text, row_number() over (partition by source order by doc_id) r from documents) where r <= 5 group by source""")
def context_assembly(spark, sf_dir):
    """The prompt's context from the first five documents of each source."""
    return search.context(_read(spark, sf_dir, "documents"), ["source"], "doc_id", "text", 5)


@_query(
    """select conv_id, turn, role, case when l is null then '' else 'PREVIOUS CONVERSATION:' || chr(10) || l end history from (
    select conv_id, turn, role, string_agg(upper(role) || ': ' || text, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) l from conversations)"""
)
def chat_history(spark, sf_dir):
    return search.history(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "history")


@_query("select d.doc_id, quality, toxic from documents d join labels l using (doc_id) where (quality = 1 or toxic = 1) and not (toxic = 1 and quality = 1) ")
def payload_filter(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    both = {"must": [{"key": "quality", "match": {"value": 1}}, {"key": "toxic", "match": {"value": 1}}]}
    spec = {"should": [{"key": "quality", "match": {"value": 1}}, {"key": "toxic", "match": {"any": [1]}}], "must_not": [both]}
    return rows.where(search.condition(spec)).select("doc_id", "quality", "toxic")


# Store


@_query("select vec_id, case when vec_id % 3 = 0 then label + 100 else label end::int label from embeddings")
def store_upsert(spark, sf_dir):
    old = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("seq"))
    new = old.where("vec_id % 3 = 0").select("vec_id", F.explode(F.array(F.struct((F.col("label") + 50).alias("label"), F.lit(1).alias("seq")), F.struct((F.col("label") + 100).alias("label"), F.lit(2).alias("seq")))).alias("x")).select("vec_id", "x.*")
    return store.upsert(old, new, "vec_id", "seq").select("vec_id", "label")


@_query("select vec_id, label from embeddings where vec_id % 3 <> 0 and label <> 2")
def store_delete(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return store.delete_where(store.delete_keys(rows, rows.where("vec_id % 3 = 0"), "vec_id"), {"must": [{"key": "label", "match": {"value": 2}}]})


@_query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 20")
def evict_by_count(spark, sf_dir):
    return store.evict_count(_read(spark, sf_dir, "events"), 20, "ts", "event_id", "user_id").select("user_id", "event_id", "ts")


@_query(
    """with b as (select *, octet_length(props::blob) size from events), r as (select *, coalesce(sum(size) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) gone,
    sum(size) over (partition by user_id) - 200 excess from b) select user_id, event_id, size::int size from r where excess <= 0 or gone >= excess"""
)
def evict_by_bytes(spark, sf_dir):
    rows = files.with_storage_flags(_read(spark, sf_dir, "events"), "props")
    return store.evict_bytes(rows, 200, key="event_id", by="user_id").select("user_id", "event_id", "size")


@_query(
    f"""with {_EVENTS}, p as (select *, last_value(case when event_type = 'purchase' then t end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) w from ev)
    select event_id, coalesce(t - w <= 86400000000, false) hit from p"""
)
def ttl_cache(spark, sf_dir):
    return store.cache_hits(_events(spark, sf_dir).withColumn("is_write", F.col("event_type") == "purchase"), 86_400, "user_id").select("event_id", "hit")


@_query("select page_id, case when contains(url, '/en/') then 60.0::double when regexp_matches(url, '\\.org') then 30.0::double else 10.0::double end ttl from pages".replace("\\\\", "\\"))
def ttl_patterns(spark, sf_dir):
    return store.first_match(_read(spark, sf_dir, "pages"), [("/en/", 60), (r"\.org", 30)], "url", 10).select("page_id", "ttl")


@_query("with h as (select page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) h from pages) select page_id, case when h = 'therha.example.com' then 1.0::double when ends_with(h, '.example.org') then 2.0::double else 10.0::double end as \"limit\" from h")
def domain_limits(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").withColumn("domain", urls.domain(F.col("url")))
    return store.domain_limit(rows, {"*.example.org": 2, "therha.example.com": 1}, 10).select("page_id", "limit")


@_query("select event_id from events where not (ts < timestamp '2024-01-10' and event_type = 'view')")
def cache_invalidate(spark, sf_dir):
    import datetime

    return store.invalidate(_read(spark, sf_dir, "events"), datetime.datetime(2024, 1, 10), "view", key="event_type").select("event_id")


# Statistics


@_query(
    f"""with {_EVENTS}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from ev)
    select user_id, count(*) requests, count(*) filter (ok) successes, count(*) filter (not ok) errors, round(avg(value) filter (k <= 100), 9) recent_seconds, round(avg(value), 9) mean_seconds,
    round(count(*) filter (ok) / count(*), 9) success_rate, count(*) filter (event_type = 'view') views from r group by user_id"""
)
def domain_stats(spark, sf_dir):
    out = stats.domain_stats(_events(spark, sf_dir), "user_id", tie="event_id", seconds="value", status="event_type")
    return out.select("user_id", "requests", "successes", "errors", F.round("recent_seconds", 9).alias("recent_seconds"), F.round("mean_seconds", 9).alias("mean_seconds"), F.round("success_rate", 9).alias("success_rate"), F.coalesce(out["statuses"]["view"], F.lit(0)).alias("views"))


@_query("select count(*) filter (event_type = 'view') hits, count(*) filter (event_type <> 'view') misses, round(count(*) filter (event_type = 'view') / count(*), 9) hit_rate from events")
def cache_stats(spark, sf_dir):
    total, _ = stats.cache_stats(_events(spark, sf_dir).withColumn("hit", F.col("event_type") == "view"), key="user_id")
    return total.withColumn("hit_rate", F.round("hit_rate", 9))


@_query("select user_id, count(*) n from events group by user_id order by n desc, user_id limit 5")
def top_keys(spark, sf_dir):
    return stats.cache_stats(_events(spark, sf_dir).withColumn("hit", F.col("ok")), key="user_id")[1]


@_query(
    f"""with {_EVENTS}, w as (select *, count(*) over r n, min(t) over r f from ev window r as (partition by user_id order by t range between 86400000000 preceding and current row))
    select event_id, n in_window, n <= 3 allowed, case when n <= 3 then 0.0::double else (86400000000 - (t - f)) / 1e6 end wait from w"""
)
def rate_limit(spark, sf_dir):
    return stats.rate_limit(_events(spark, sf_dir), 3, 86_400, "user_id").select("event_id", "in_window", "allowed", "wait")


@_query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row), 9) rolling from events")
def rolling_mean(spark, sf_dir):
    return stats.rolling_mean(_events(spark, sf_dir), "value", "user_id", ("ts", "event_id")).select("event_id", F.round("rolling", 9).alias("rolling"))


@_query(
    f"""with {_EVENTS}, g as (select *, sum(ok::int) over (partition by user_id order by ts, event_id rows unbounded preceding) g from ev),
    n as (select *, sum((not ok)::int) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint n from g)
    select event_id, n errors_in_row, case when n > 1 then least(60.0, 2.0 * pow(2.0, n - 1)) else 0.0 end::double pause, case when n >= 3 then least(60.0, pow(2.0, n - 2)) else 0.0 end::double parallel_pause from n"""
)
def error_backoff(spark, sf_dir):
    rows = stats.error_runs(_events(spark, sf_dir), key="user_id", order=("ts", "event_id"))
    return rows.select("event_id", "errors_in_row", stats.backoff(F.col("errors_in_row")).alias("pause"), stats.backoff(F.col("errors_in_row"), parallel=True).alias("parallel_pause"))


@_query(
    f"""with {_EVENTS}, u as (select user_id, avg(value) / 10 m, count(*) filter (not ok) e, count(*) n from ev group by user_id)
    select user_id, case when e / n > 0.1 then 2.5::double else 5.0::double end adapted, case when n > 10 and e / n > 0.2 then 2.5::double when n > 10 and e / n > 0.1 then 3.75::double else 5.0::double end tiered from u"""
)
def adaptive_rate(spark, sf_dir):
    rows = stats.domain_stats(_events(spark, sf_dir), "user_id", tie="event_id", seconds="value", status="event_type")
    limit = F.lit(5.0)
    return rows.select("user_id", stats.adapted_rate(limit, F.col("mean_seconds") / 10, F.col("errors") / F.col("requests")).alias("adapted"), stats.tiered_rate(limit, F.col("requests"), F.col("errors")).alias("tiered"))


@_query(f"with {_EVENTS}, g as (select event_id, (t - lag(t) over (partition by user_id order by ts, event_id)) / 1e6 gap from ev) select event_id, gap, coalesce(greatest(0.0::double, 3600.0 - gap), 0.0::double) pause from g")
def request_gaps(spark, sf_dir):
    return stats.gaps(_events(spark, sf_dir), 1 / 3600, "user_id", tie="event_id").select("event_id", "gap", F.round("pause", 6).alias("pause"))


@_query(
    f"""with {_EVENTS} select time_bucket(interval 1 day, ts) "start", user_id, count(*) requests, count(*) filter (not ok) errors, round(avg(value), 9) mean_value from ev group by all"""
)
def windowed_stats(spark, sf_dir):
    out = streams.windowed_stats(_events(spark, sf_dir), "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "requests", "errors", F.round("mean_value", 9).alias("mean_value"))


@_query()
def pages_to_chunks(spark, sf_dir):
    """Pages extracted and chunked."""
    return pipeline.chunk(pipeline.extract(_read(spark, sf_dir, "pages")), pipeline.Config())


@_query("select page_id, url from pages where regexp_matches(url, '^(?i:https?)://[^/?#]+') and not starts_with(url, 'http://t')")
def failed_urls(spark, sf_dir):
    """The valid URLs that aren't among those that succeeded."""
    rows = sitemaps.valid(_read(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return rows.join(rows.where(F.startswith("url", F.lit("http://t"))), "page_id", "left_anti")


@_query("select source, min(doc_id) doc_id, count(*) n from documents group by source")
def first_of_each(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("source", "doc_id")
    found = sitemaps.first_found(rows, "source", "doc_id")
    return found.join(rows.groupBy("source").agg(F.count("*").alias("n")), "source")


_SITES = f"s as (select page_id, url, {_ROOT} || '/' || page_id site from pages)"


@_query(
    f"""with {_SITES}, x as (
    select site, url loc, null::varchar lastmod, 0.5::double priority from s where page_id % 4 = 0 union all select site, site || '/b', '2024-01-02', 0.9::double from s where page_id % 4 = 0 union all
    select site, site || '/c', null, null from s where page_id % 4 = 1 union all select site, site || '/d', null, null from s where page_id % 4 = 2)
    select site, loc, lastmod, priority from x where regexp_matches(loc, '^(?i:https?)://[^/?#]+')"""
)
def discover_urls(spark, sf_dir):
    """Sites of four kinds: an index that robots.txt names, a sitemap at a usual place, a page of links, and
    a sitemap that isn't well formed."""
    k, site = F.col("page_id") % 4, F.concat(F.regexp_extract("url", "^([^:/?#]+://[^/?#]*)", 1), F.lit("/"), F.col("page_id").cast("string"))
    rows = _read(spark, sf_dir, "pages").select("page_id", "url", site.alias("site"))
    loc = lambda x: F.concat(F.lit("<url><loc>"), x, F.lit("</loc>"))
    escaped = F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))
    file = lambda path, kind, content: F.struct(F.concat("site", F.lit(path)).alias("url"), F.lit(kind).alias("kind"), content.alias("content"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "site", F.lit("/1.xml</loc></sitemap><!-- <sitemap><loc>no</loc></sitemap> --></sitemapindex>"))
    leaf = F.concat(F.lit("<s:urlset xmlns:s='u'>".replace("s:urlset xmlns:s", "urlset xmlns")), loc(escaped), F.lit("<priority>0.5</priority></url>"), loc(F.concat("site", F.lit("/b"))), F.lit("<lastmod>2024-01-02</lastmod><priority>0.9</priority></url></urlset>"))
    files = F.when(k == 0, F.array(file("/robots.txt", "text/plain", F.concat(F.lit("Sitemap: "), "site", F.lit("/0.xml"))), file("/0.xml", "text/xml", index), file("/1.xml", "application/xml", leaf)))
    files = files.when(k == 1, F.array(file("/sitemap_index.xml", "text/xml", F.concat(F.lit("<urlset>"), loc(F.concat("site", F.lit("/c"))), F.lit("</url></urlset>"))), file("/sitemap.html", "text/html", F.lit("<a href='/no'>x</a>"))))
    files = files.when(k == 2, F.array(file("/sitemap.html", "text/html", F.concat(F.lit("<ul><li><a href='"), "site", F.lit("/d'>x</a></ul>")))))
    files = files.otherwise(F.array(file("/sitemap.xml", "text/xml", F.lit("<urlset><url><loc>http://a/</loc></url>"))))
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or f"/tmp/loomwork-{spark.sparkContext.applicationId}")
    return sitemaps.discover(rows, rows.select(F.inline(files)))
