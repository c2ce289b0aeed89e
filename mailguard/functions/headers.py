"""Header features as Column -> Column expressions.

Every function is null-safe and returns the value the reference computes on a
pandas Series (its vectorised path); nothing here raises on malformed mail.
Regexes use the explicit Unicode classes of ``patterns`` so ``\\s``/``\\w``
mean what they mean in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailguard.functions import netmath
from mailguard.functions import sqltext as S
from mailguard.functions.patterns import NOT_WORD, NOT_WS, WORD, WS

# Organisation domain and mail-relay host pattern of the
# reference deployment; both are parameters of the functions below.
ORG_DOMAIN = "ubc.ca"
ORG_RELAY = r"by[WS]+[a-zA-Z0-9-]+\.mail-relay\.ubc\.ca"
# Received headers skipped when looking for the first hop.
SKIP_MARKERS = ("localhost", "127.0.0.1", "with mapi id", "envelope-from")

IPV4_IN_BRACKETS = r"\[([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\]"
UNKNOWN_IPV4 = r"unknown \[[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\]"
IPV6_SHAPES = (r"\[([0-9a-fA-F:]+:[0-9a-fA-F:]+)\]",
               r"([0-9a-fA-F:]+:[0-9a-fA-F:]+)\)",
               r"\(([0-9a-fA-F:]+:[0-9a-fA-F:]+)\)")
HOST = r"[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z0-9][-a-zA-Z0-9.]*"
SUBJECT_URL = (r"(?:(?:https?://|ftp://|www\.)" + NOT_WS + r"+|(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}"
               r"(?:/" + NOT_WS + r"*)?)")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ws(p: str) -> str:
    return p.replace("[WS]", WS)


def org_from_pattern(org_domain: str = ORG_DOMAIN) -> str:
    """``from <host>.<org>`` followed by a word boundary (end or non-word)."""
    dom = org_domain.replace(".", r"\.")
    return rf"from{WS}+{NOT_WS}+\.{dom}(?:{NOT_WORD}|$)"


def _first_match(s: Column, pattern: str) -> Column:
    """First capture group, null when the pattern does not match."""
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))


# -- H1-H12: presence, authentication results, sender consistency ---------

def has_header_value(h) -> Column:
    """H1: header present (an empty string counts as present)."""
    return _c(h).isNotNull()


def has_dmarc_authentication(auth) -> Column:
    """H2: ``dmarc=`` anywhere, ignoring case; null -> false."""
    return F.coalesce(F.lower(_c(auth)).contains("dmarc="), F.lit(False))


def _auth_word(auth: Column, key: str) -> Column:
    return F.coalesce(F.lower(_first_match(auth, rf"{key}=({WORD}+)")), F.lit("none"))


def get_dkim_result(auth) -> Column:
    """H3: first ``dkim=<word>`` (case-sensitive key), lower-cased, else none."""
    return _auth_word(_c(auth), "dkim")


def get_spf_result(received_spf) -> Column:
    """H4: leading word of Received-SPF, lower-cased, else none."""
    return F.coalesce(F.lower(_first_match(_c(received_spf), rf"^({WORD}+)")), F.lit("none"))


def get_dmarc_result(auth) -> Column:
    """H5: first ``dmarc=<word>`` (case-sensitive key), lower-cased, else none."""
    return _auth_word(_c(auth), "dmarc")


def auth_method_result(auth, method: str) -> Column:
    """H6: ``<method> = <word>`` ignoring case and spaces, lower; none when absent."""
    return F.coalesce(F.lower(_first_match(_c(auth), rf"(?i){method}{WS}*={WS}*({WORD}+)")),
                      F.lit("none"))


def extract_dkim_domain(sig) -> Column:
    """H7: first ``d=<host>`` anywhere in the signature (unanchored), lower."""
    return F.lower(_first_match(_c(sig), r"d=([\p{L}\p{N}_.-]+)"))


def dkim_domain_matches_sender(sig, sender_domain) -> Column:
    """H8: DKIM domain equals sender domain ignoring case; null -> false."""
    return F.coalesce(extract_dkim_domain(sig) == F.lower(_c(sender_domain)), F.lit(False))


def to_from_match(a, b) -> Column:
    """H9: addresses equal ignoring case; any null -> false."""
    return F.coalesce(F.lower(_c(a)) == F.lower(_c(b)), F.lit(False))


def extract_spf_email(received_spf) -> Column:
    """``envelope-from=`` value without quotes, lower-cased."""
    pat = r"envelope-from=[\"']?([^\"'>" + WS[1:-1] + r"]+)[\"']?"
    return F.lower(_first_match(_c(received_spf), pat))


def spf_email_matches_sender(received_spf, sender_email) -> Column:
    """SPF envelope address equals the sender address ignoring case."""
    return F.coalesce(extract_spf_email(received_spf) == F.lower(_c(sender_email)), F.lit(False))


def check_different_reply_domain(from_domain, reply_domain) -> Column:
    """Suspicious Reply-To: missing reply -> only when From is missing
    too; present reply -> From missing or different (case-sensitive)."""
    f, r = _c(from_domain), _c(reply_domain)
    no_reply = r.isNull() | (r == "")
    no_from = f.isNull() | (f == "")
    return F.when(no_reply, no_from).otherwise(no_from | (f != r))


# -- H13-H22: routing ------------------------------------------------------

def _ref(col) -> str:
    if not isinstance(col, str):
        raise TypeError("pass a column name; stage computed inputs with withColumn first")
    return S.ident(col)


def _skipped_sql(h: str) -> str:
    conds = " OR ".join(f"contains({h}, {S.s(m)})" for m in SKIP_MARKERS)
    return f"coalesce({conds}, true)"


def first_server_transfer_sql(r: str) -> str:
    h, ip = S.var("h"), S.var("ip")
    strong = (f"{h} -> NOT {_skipped_sql(h)} AND ({h} RLIKE {S.rx(_ws(ORG_RELAY))} OR "
              f"{h} RLIKE {S.rx(UNKNOWN_IPV4)} OR (contains({h}, 'from') AND contains({h}, 'by') AND "
              f"exists(regexp_extract_all({h}, {S.rx(IPV4_IN_BRACKETS)}, 1), "
              f"{ip} -> {netmath.ipv4_is_global_sql(ip)})))")
    loose = f"{h} -> NOT {_skipped_sql(h)} AND contains({h}, 'from') AND contains({h}, 'by')"
    return (f"coalesce(get(filter(reverse({r}), {strong}), 0), "
            f"get(filter(reverse({r}), {loose}), 0))")


def received_domain_sql(x: str) -> str:
    direct = rf"from{WS}+({HOST})[" + WS[1:-1] + r"\(]"
    helo = rf"from{WS}+[^\(]*\([^H]*HELO{WS}+({HOST})"
    return (f"coalesce(nullif(regexp_extract({x}, {S.rx(direct)}, 1), ''), "
            f"nullif(regexp_extract({x}, {S.rx(helo)}, 1), ''))")


def received_ip_sql(x: str) -> str:
    m = S.var("m")
    cands = ", ".join(f"regexp_extract_all({x}, {S.rx(p)}, 1)" for p in IPV6_SHAPES)
    return (f"coalesce(get(regexp_extract_all({x}, {S.rx(IPV4_IN_BRACKETS)}, 1), 0), "
            f"get(filter(concat({cands}), {m} -> length({m}) - length(replace({m}, ':', '')) >= 2), 0))")


def routing_sql(r: str, org_domain: str = ORG_DOMAIN) -> str:
    h = S.var("h")
    pos = (f"array_position(transform({r}, {h} -> NOT coalesce({h} RLIKE "
           f"{S.rx(org_from_pattern(org_domain))}, false)), true)")
    return S.let(pos, lambda p: (f"CASE WHEN {r} IS NULL OR {p} = 0 THEN CAST(array() AS ARRAY<STRING>) "
                                 f"ELSE slice({r}, CAST(greatest({p}, 1) AS INT), "
                                 f"CAST(greatest(size({r}) - {p} + 1, 0) AS INT)) END"))


def internal_count_sql(routing: str) -> str:
    h, ip = S.var("h"), S.var("ip")
    return (f"size(filter(transform({routing}, {h} -> {received_ip_sql(h)}), "
            f"{ip} -> coalesce({netmath.ip_is_private_sql(ip)}, false)))")


def extract_first_server_transfer(received) -> Column:
    """Oldest-first scan; first pass takes the org relay, an ``unknown
    [ip]`` hop or a from/by hop with a global IPv4, whichever header comes
    first; otherwise the oldest from/by hop.  Skip-listed and null headers
    never count; an invalid dotted quad is simply not global."""
    return F.expr(first_server_transfer_sql(_ref(received)))


def extract_domain_from_received_header(h) -> Column:
    """``from host.tld`` then the HELO name as fallback."""
    return F.expr(received_domain_sql(_ref(h)))


def extract_ip_from_received_header(h) -> Column:
    """First bracketed IPv4, else the first IPv6-looking token (three
    shapes, in that order) with at least two colons."""
    return F.expr(received_ip_sql(_ref(h)))


def check_email_from_org(h, org_domain: str = ORG_DOMAIN) -> Column:
    """Header says ``from <host>.<org>`` (case-insensitive)."""
    return F.coalesce(_c(h).rlike("(?i)" + org_from_pattern(org_domain)), F.lit(False))


def name_servers_match(a, b) -> Column:
    """Multiset equality of two name-server lists; empty/null -> false."""
    a, b = _c(a), _c(b)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) == F.array_sort(b)),
                      F.lit(False))


def routing_before_org(received, org_domain: str = ORG_DOMAIN) -> Column:
    """Drop the leading headers that say ``from <host>.<org>``
    (case-sensitive); keep everything from the first other header on.
    A null header counts as outside the organisation."""
    return F.expr(routing_sql(_ref(received), org_domain))


def routing_length_before_org(received, org_domain: str = ORG_DOMAIN) -> Column:
    """Number of headers kept by H19 (0 for null)."""
    return F.expr(f"size({routing_sql(_ref(received), org_domain)})")


def internal_server_transfer_count(routing) -> Column:
    """Headers whose first IP parses and is private."""
    return F.expr(internal_count_sql(_ref(routing)))


def url_present_in_subject(subject) -> Column:
    """Any URL-looking token in the subject; null/empty -> false."""
    return F.coalesce(_c(subject).rlike(SUBJECT_URL), F.lit(False))


def has_attachment(types) -> Column:
    """Attachment list non-empty."""
    return F.coalesce(F.size(_c(types)) > 0, F.lit(False))


def number_of_received(received) -> Column:
    """List length, null -> 0."""
    r = _c(received)
    return F.when(r.isNull(), F.lit(0)).otherwise(F.size(r))


def return_path_domain(return_path) -> Column:
    """Text after the last ``@``, lower-cased."""
    return F.lower(F.element_at(F.split(_c(return_path), "@"), -1))


def return_path_matches(return_path, from_domain) -> Column:
    """The Return-Path domain is the sender's; either one missing -> false."""
    return F.coalesce(return_path_domain(return_path) == F.lower(_c(from_domain)), F.lit(False))


def attachment_types(content_types) -> Column:
    """P8 where no dispositions are stored: the parts that are neither text nor containers; null stays null."""
    return F.filter(_c(content_types), lambda t: ~t.startswith("text/") & ~t.startswith("multipart/"))
