"""Scalar expressions: names, labels, dates, paths. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.schema import DEFAULT_ROLE, DEFAULT_TOPIC, MAX_PAGE_SIZE, PAGE_SIZE, PLATFORMS

#: White space as a script's trim() sees it: Unicode's, with no-break space and byte order mark.
BLANK = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def with_role(role: Column, text: Column) -> Column:
    """Text under its role's header; a null role counts as unknown."""
    return F.concat(F.lit("["), F.upper(F.coalesce(role, F.lit(DEFAULT_ROLE))), F.lit("] "), text)


def sanitize_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")


def record_chunk_id(source_url: Column, index: Column) -> Column:
    """Captures without URL share the ids of the literal null."""
    return sanitize_id(F.concat(F.coalesce(source_url, F.lit("null")), F.lit("_"), index.cast("string")))


def code_chunk_id(topic: Column, rel_path: Column, index: Column) -> Column:
    return F.concat(sanitize_id(F.concat(F.lit("codebase_"), topic, F.lit("_"), rel_path)), F.lit("_"), index.cast("string"))


def result_label(platform: Column, topic: Column, document: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(platform, F.lit("?")), F.lit(" — "), F.coalesce(topic, F.lit("?")), F.lit("]\n"), document)


def render_ms(ms: Column, empty: str = "?") -> Column:
    """Epoch milliseconds as d/M/yyyy, HH:mm:ss in the session's zone; null and 0 have no date."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(empty)).otherwise(F.date_format(F.timestamp_millis(ms), "d/M/yyyy, HH:mm:ss"))


def file_name(topic: Column) -> Column:
    """Runs of white space become one underscore."""
    return F.regexp_replace(topic, f"{BLANK}+", "_")


def wiki_name(topic: Column) -> Column:
    """Each white space and each character that wikis forbid becomes an underscore."""
    return F.regexp_replace(topic, BLANK[:-1] + r"/\\:*?\"<>|]", "_")


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def badge(platform: Column) -> Column:
    return F.when(platform == "codebase", "codebase").when(platform.startswith("Manual"), "manual").otherwise("")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5)).otherwise(F.lit(0)).cast("bigint")


def resolve_topic(c: Column) -> Column:
    return F.coalesce(F.nullif(trim(c), F.lit("")), F.lit(DEFAULT_TOPIC))


def parse_extensions(c: Column) -> Column:
    """A list separated by commas: trimmed, without empty parts, in lower case, without a leading dot."""
    parts = F.filter(F.transform(F.split(c, ","), trim), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.lower(x), r"^\.", ""))


def leading_int(c: Column) -> Column:
    """The whole number that a text starts with, after white space and a sign, as a script's parseInt reads it; else null."""
    return F.nullif(F.regexp_extract(c, f"^{BLANK}*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def page_limit(c: Column) -> Column:
    """No number, 0 and negative ones mean the default."""
    n = leading_int(c)
    return F.least(F.when(n > 0, n).otherwise(F.lit(PAGE_SIZE)), F.lit(MAX_PAGE_SIZE)).cast("int")


def page_offset(c: Column) -> Column:
    n = leading_int(c)
    return F.when(n > 0, n).otherwise(F.lit(0)).cast("bigint")


def decoded_topic(c: Column) -> Column:
    """A topic out of a URL's path, where a plus sign is one; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def detect_platform(url: Column) -> Column:
    """The platform whose host the URL's host contains, the first of the registry; else null."""
    name = F.lit(None).cast("string")
    for part, platform in reversed(PLATFORMS):
        name = F.when(F.contains(host(url), F.lit(part)), platform).otherwise(name)
    return name


def platform_label(url: Column) -> Column:
    """The platform of a page, or its host for pages that are read by a chosen container."""
    return F.coalesce(detect_platform(url), F.concat(F.lit("Manual:"), host(url)))


def translate_host_path(path: Column, prefix: str, mount: str = "/workspace") -> Column:
    """A path under the host's prefix (in any case, with either slash) as one under the mount.

    The tail is cut by the length of the prefix as given, so a slash at its end moves the cut by one.
    """
    if not prefix or prefix == ".":
        return path
    plain = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", ""))
    start = plain(F.lit(prefix))
    tail = F.substring(F.replace(path, F.lit("\\"), F.lit("/")), len(prefix) + 1, 1 << 20)
    return F.when(plain(path) == start, F.lit(mount)).when(plain(path).startswith(F.concat(start, F.lit("/"))), F.concat(F.lit(mount), tail)).otherwise(path)
