"""Redaction and validation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: What is redacted, in this order: an address with a password in a URL is taken for e-mail first.
PATTERNS: tuple[tuple[str, str], ...] = (
    (r"(api(?:_|-)?key|token)['\"]?\s*[=:]\s*['\"]?[0-9A-Za-z]{20,}['\"]?", "$1: [REDACTED]"),
    (r"[.\w-]+@[.\w-]+\.\w+", "[EMAIL REDACTED]"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP REDACTED]"),
    (r"(https?://)[^/:@]+:[^/@]+@", "$1[USER REDACTED]:[PASS REDACTED]@"),
    (r"\b(?:[0-9]{4}[\s-]?){3}[0-9]{4}\b", "[CARD REDACTED]"),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN REDACTED]"),
    ("AKIA[A-Z0-9]{16}", "[AWS KEY REDACTED]"),
    (r"(passw(?:or)?d|pwd)['\"]?\s*[=:]\s*['\"]?[^'\"\s]{8,}['\"]?", "$1: [REDACTED]"),
)
HEADERS = ("authorization", "cookie", "proxy-authorization", "set-cookie", "x-api-key", "x-auth-token")
#: Any of these makes content unsafe, in any case and across lines.
UNSAFE = r"(?is)<script.*?>.*?</script>|javascript:|on(?:error|load)=|eval\(|document\.cookie|<(?:iframe|object|embed)"
FORMATS = ("markdown", "json", "xml")


def redact(text: Column, patterns: tuple[tuple[str, str], ...] = ()) -> Column:
    """Sensitive data replaced by marks; of no patterns the usual ones are taken; a null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    for pattern, mark in patterns or PATTERNS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*HEADERS), F.lit("[REDACTED]")).otherwise(v))


def is_safe(content: Column) -> Column:
    return ~F.coalesce(content, F.lit("")).rlike(UNSAFE)


def is_html(content: Column) -> Column:
    """Has a page's tags and 20 scripts at most."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return (F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body"))) & (F.regexp_count(low, F.lit("<script")) <= 20)


def is_format(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(*FORMATS), F.lit(False))


def is_rate(rate: Column) -> Column:
    return F.coalesce((rate > 0) & (rate <= 100), F.lit(False))


def is_pattern(pattern: str) -> bool:
    """Whether a regular expression compiles and has none of the shapes that are known to run away."""
    if any(bad in pattern for bad in ("(.*)*", "(.+)+", "(a+)+")):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def check_chunking(size: int, overlap: int) -> None:
    """Raises unless windows of ``size`` advance."""
    if size < 5 or overlap < 0 or overlap // 5 >= size // 5:
        raise ValueError("the chunk size must be 5 or more, and the overlap less than it")


def validate(kind: Column, value: Column) -> Column:
    """The validator that ``kind`` names; unknown kinds are invalid."""
    return (
        F.when(kind == "url", urls.is_valid(value)).when(kind == "html", is_html(value)).when(kind == "format", is_format(value))
        .when(kind == "rate", is_rate(value.try_cast("double"))).when(kind == "path", urls.is_safe_path(value)).otherwise(F.lit(False))
    )


def retry_after(header: Column, now: Column, default: float = 5.0) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date; else the default."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(header.try_cast("double"), F.unix_timestamp(date).cast("double") - F.unix_timestamp(now).cast("double"))
    return F.when(seconds > 0, seconds).otherwise(F.lit(default))


def audit_line(event: Column, details: Column) -> Column:
    """An audit entry with redacted values, by key."""
    parts = F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit("="), redact(e["value"])))
    return F.concat(F.lit("Security event: "), event, F.lit(" - "), F.array_join(parts, ", "))
