"""URL expressions, after RFC 3986 and without exceptions on what isn't a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[^:/?#]+://([^/?#]*)"
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, _HOST, 1)


def domain(url: Column) -> Column:
    """The host with its port, else ``unknown``."""
    return F.coalesce(F.nullif(host(url), F.lit("")), F.lit("unknown"))


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def sanitize(url: Column) -> Column:
    """Without user name, password and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([^:/?#]+://)[^/?#@]*@([^/?#@]*)(?:@[^/?#]*)?", "$1$2")


def _extension(kind: Column) -> Column:
    return F.when(kind == "markdown", F.lit(".md")).otherwise(F.concat(F.lit("."), kind))


def with_extension(name: Column, kind: Column) -> Column:
    """A file name with the extension of an output format in place of its own."""
    end = _extension(kind)
    return F.when(F.endswith(name, end), name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), end))


def output_name(name: Column, kind: Column, content: Column, markdown: Column) -> Column:
    """``with_extension``, but ``.md`` where the content fell back to markdown."""
    named = with_extension(name, kind)
    fell_back = (kind != "markdown") & (content == markdown)
    return F.when(fell_back, F.replace(named, F.concat(F.lit("."), kind), F.lit(".md"))).otherwise(named)


def file_name(url: Column, kind: Column) -> Column:
    """All path segments joined by underscores, with the extension of an output format."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "^/+|/+$", "")
    joined = F.regexp_replace(F.coalesce(F.nullif(path, F.lit("")), F.lit("index")), r"""[\\/*?:"<>|]""", "_")
    return with_extension(F.when(F.startswith(path, F.lit("/")), F.lit("index")).otherwise(joined), kind)


def short_name(url: Column, kind: Column) -> Column:
    """The last path segment, else the host, with the extension of an output format."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "^/+|/+$", "")
    last = F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), host(url))
    end = F.when(kind == "json", F.lit(".json")).when(kind == "xml", F.lit(".xml")).otherwise(F.lit(".md"))
    return F.concat(F.regexp_replace(last, r"""[\\/*?:"<>|]""", "_"), end)


def resolve(base: Column, link: Column) -> Column:
    """A link as seen from an absolute base, with dot segments removed."""
    root, scheme = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(base, "^([^:/?#]+:)", 1)
    path = F.regexp_extract(base, _PATH, 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    body, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_replace(F.when(F.startswith(body, F.lit("/")), body).otherwise(F.concat(folder, body)), "^/", ""), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    last = F.element_at(steps, -1)
    joined = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")), rest)
    same = F.concat(root, path)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link == "", base)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(F.startswith(link, F.lit("?")), F.concat(same, link))
        .otherwise(joined)
    )


def is_safe_path(path: Column, extensions: tuple[str, ...] = (), base: str | None = None) -> Column:
    """Whether a path stays in its folder (an absolute one in ``base``, if that is given) and, if any are
    given, has one of the extensions."""
    ok = ~F.contains(path, F.lit("..")) & ~F.contains(path, F.lit("~")) & (path != "")
    if base is not None:
        ok &= ~F.startswith(path, F.lit("/")) | F.startswith(path, F.lit(base.rstrip("/") + "/"))
    if extensions:
        ok &= F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*(e.lstrip(".").lower() for e in extensions))
    return F.coalesce(ok, F.lit(False))
