"""URL features over an array of URLs per mail.

All checks are higher-order ``exists``/``filter`` over the per-mail URL list
(a few entries), so they stay inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailguard.functions import content as C
from mailguard.functions.patterns import NOT_WS, WS

_STOP = WS[1:-1] + r"\)\]\<\>\"\'\,"
TEXT_URL = r"(https?://[^" + _STOP + r"]+|www\.[^" + _STOP + r"]+)"
IP_URL = r"^https?://([0-9]{1,3}\.){3}[0-9]{1,3}"
AUTHORITY = r"^https?://([^/?#]*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_scheme(u: Column) -> Column:
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("http://"), u))


def extract_urls(text, html) -> Column:
    """URLs written in the text (``www.`` ones get ``http://``) plus the
    non-empty ``href`` values of the HTML, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TEXT_URL), 1)
    hrefs = F.filter(C.hyperlinks(html), lambda h: h != "")
    return F.array_sort(F.array_distinct(F.concat(F.transform(found, with_scheme), hrefs)))


def url_count(urls) -> Column:
    """U2."""
    return F.size(_c(urls))


def has_ip_url(urls) -> Column:
    """A URL whose host is a dotted quad."""
    return F.exists(_c(urls), lambda u: with_scheme(u).rlike(IP_URL))


def has_http_only(urls) -> Column:
    """A URL starting with plain ``http://``."""
    return F.exists(_c(urls), lambda u: u.startswith("http://"))


def has_at_symbol(urls) -> Column:
    """A URL containing ``@`` (user-info hides the real host)."""
    return F.exists(_c(urls), lambda u: u.contains("@"))


def _authority(u: Column) -> Column:
    return F.regexp_extract(with_scheme(u), AUTHORITY, 1)


def has_port_number(urls) -> Column:
    """U8: an explicit numeric port after the host (user-info ignored)."""
    return F.exists(_c(urls), lambda u: F.element_at(F.split(_authority(u), "@"), -1).rlike(r":[0-9]+$"))


def has_long_url(urls, threshold: int = 75) -> Column:
    """A URL longer than ``threshold`` characters."""
    return F.exists(_c(urls), lambda u: F.length(u) > threshold)


def has_multiple_subdomains(urls) -> Column:
    """A network location with more than three dot-separated parts."""
    return F.exists(_c(urls), lambda u: u.rlike(NOT_WS) & (F.size(F.split(_authority(u), r"\.")) > 3))


def normalized(u: Column) -> Column:
    """U4 helper: lower case without trailing slashes."""
    return F.regexp_replace(F.lower(u), "/+$", "")
