"""Text expressions. White space is what Unicode calls so, not just ASCII's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
#: Terms that raise a chunk's density.
TERMS = ("algorithm", "analysis", "class", "data", "function", "implementation", "method", "model", "process", "system")


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def escape_xml(text: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


def escape_query(text: Column, limit: int = 1000) -> Column:
    """A search text escaped for HTML; null if it is blank or longer than ``limit``."""
    ok = (strip(text) != "") & (F.length(text) <= limit)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.when(ok, text)


def preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Without tags; what stands between them stays."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<[/!?a-zA-Z][^>]*>", "")


def title(text: Column, url: Column) -> Column:
    """The first level-one heading, else the URL's last path segment in words, else its host."""
    head = strip(F.regexp_extract(text, r"(?m)^# ([^\n]*)", 1))
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)
    host = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    named = F.initcap(F.regexp_replace(last, "[-_]", " "))
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(named, F.lit("")), host)


def density(text: Column) -> Column:
    """Share of telling words, with a bonus of up to 0.2 for length; 0 without words. Words are counted
    where they stand: none is cut out."""
    solid = f"[^{SPACE[1:]}"
    text = F.coalesce(text, F.lit(""))
    count = lambda of, pattern: F.regexp_count(of, F.lit(pattern))
    n = count(text, f"{solid}++")
    digit, upper = count(text, rf"[^{SPACE[1:-1]}\p{{N}}]*+\p{{N}}{solid}*+"), count(text, rf"(?<!{solid})\p{{Lu}}")
    term = count(F.lower(text), f"(?:{'|'.join(TERMS)}){solid}*+")
    share = (upper * 5 + digit * 3 + term * 7) / (n * F.lit(10.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(share, F.lit(1.0)) + F.least(n / F.lit(100.0), F.lit(0.2)))


def safe_name(name: Column) -> Column:
    """A name that is safe as a folder's."""
    name = F.regexp_replace(F.regexp_replace(name, r"[^\w\-.]", "_"), r"\.\.", "_")
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^\.+|\.+$", ""), F.lit("")), F.lit("default"))


def rollout(user: Column, feature: str, salt: str) -> Column:
    """A user's place from 0 to 99.99 in a feature's rollout."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), user.cast("string"), F.lit(":" + feature)), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(digest, i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % 10000) / F.lit(100.0)
