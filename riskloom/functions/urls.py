"""URL, e-mail and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import strip

# Fixed formats of the validators.
URL_FORMAT = r"""^https?://[^\s<>"{}|\\^`\[\]]+$"""
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SLUG_FORMAT = r"^[A-Za-z0-9_]{2,21}$"

_ABSOLUTE = r"^(https?)://([^/?#]+)([^?#]*)"


def is_url(value: Column) -> Column:
    return value.rlike(URL_FORMAT)


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL_FORMAT)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path of an absolute http(s) URL; empty strings otherwise."""
    lowered = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return lowered, rest, path


def canonical_url(url: Column) -> Column:
    """scheme://host/path without query, fragment and trailing slashes."""
    scheme, host, path = url_parts(url)
    return F.regexp_replace(F.concat(scheme, F.lit("://"), host, path), "/+$", "")


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page at ``base``."""
    scheme, host, path = url_parts(base)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    joined = (
        F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
    dotted = joined.rlike(r"^[^?#]*/\.{1,2}(/|[?#]|$)")
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(dotted, _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` path segments applied."""
    root = F.regexp_extract(url, r"^([^/]*//[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"([?#].*)$", 1)

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    segments = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), open_end)
    return F.concat(root, F.regexp_replace(clean, "//$", "/"), rest)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def normalize_source_value(source_type: Column, value: Column) -> Column:
    """``struct<value, problem>``: the accepted source value, or the reason it was refused."""
    raw = strip(F.coalesce(value, F.lit("")))
    scheme, host, path = url_parts(raw)
    segments = path_segments(path)
    is_http_text = raw.startswith("http://") | raw.startswith("https://")
    community_url = (F.size(segments) >= 2) & (F.lower(F.get(segments, F.lit(0))) == "r")
    candidate = F.when(is_http_text & community_url, F.get(segments, F.lit(1))).when(~is_http_text, raw)
    slug = strip(F.regexp_replace(candidate, "^[rR]/", ""))
    community = source_type == "reddit"
    web_ok = scheme.isin("http", "https") & (F.length(host) > 0)
    problem = (
        F.when(raw == "", "value required")
        .when(community & slug.isNull(), "not a community address")
        .when(community & ~slug.rlike(SLUG_FORMAT), "bad community name")
        .when(~community & ~web_ok, "not an http address")
    )
    accepted = F.when(problem.isNull(), F.when(community, slug).otherwise(raw))
    return F.struct(accepted.alias("value"), problem.alias("problem"))


def feed_item_id(source_type: Column, guid: Column, title: Column, published: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (guid, title, published)]
    return F.concat(source_type, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24))


def article_id(canonical: Column) -> Column:
    return F.concat(F.lit("url:"), F.substring(F.sha1(canonical), 1, 24))


def page_id(url: Column, title: Column, text: Column, fingerprint_chars: int | None = None) -> Column:
    """Identity of a page version: its address and a digest of title and whole text, or of the text's first ``fingerprint_chars``."""
    body = text if fingerprint_chars is None else F.substring(text, 1, fingerprint_chars)
    mark = F.sha1(F.concat(title, F.lit("\n"), body))
    return F.concat(F.lit("url:"), url, F.lit(":"), F.substring(mark, 1, 16))


def channel_feed_url(channel: Column, bridge: str) -> Column:
    slug = F.regexp_replace(channel, "^/+", "")
    return F.when(channel.startswith("http"), channel).otherwise(F.concat(F.lit(bridge.rstrip("/") + "/"), slug))


def channel_label(channel: Column) -> Column:
    return F.concat(F.lit("t.me/"), F.regexp_replace(channel, "^/+", ""))
