"""DuckDB SQL fragments for the oracle side of the parity checks.

These render the same feature definitions as ``mailguard.functions`` in
DuckDB's dialect (RE2 regexes, ``list_*`` functions, ``lambda x:`` syntax) so
each Spark query can be checked against an independent engine.
"""

from __future__ import annotations

from mailguard.functions import content as C
from mailguard.functions import headers as H
from mailguard.functions import netmath as N
from mailguard.functions.patterns import LETTER, NOT_WS, WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def first(s: str, pat: str) -> str:
    return f"nullif(regexp_extract({s}, {q(pat)}, 1), '')"


def rcount(s: str, pat: str) -> str:
    return f"len(regexp_extract_all({s}, {q(pat)}))"


def matches(s: str, pat: str) -> str:
    return f"regexp_matches({s}, {q(pat)})"


# -- netmath -----------------------------------------------------------------

def _between_any(x: str, ranges) -> str:
    conds = [f"({x} BETWEEN {a if isinstance(a, int) else q(a)} AND {b if isinstance(b, int) else q(b)})"
             for a, b in ranges]
    return "(" + " OR ".join(conds) + ")"


def ipv4_to_long(s: str) -> str:
    octs = [f"CAST(regexp_extract({s}, {q(N.IPV4_RE)}, {i}) AS BIGINT)" for i in range(1, 5)]
    valid = f"coalesce({matches(s, N.IPV4_RE)}, false)"
    ok = " AND ".join(f"{o} <= 255" for o in octs)
    val = f"({octs[0]} * 16777216 + {octs[1]} * 65536 + {octs[2]} * 256 + {octs[3]})"
    return f"(CASE WHEN {valid} THEN CASE WHEN {ok} THEN {val} END END)"


def _hexpad(part: str) -> str:
    return (f"(CASE WHEN {part} = '' THEN '' ELSE array_to_string(list_transform("
            f"string_split({part}, ':'), lambda g: lpad(lower(g), 4, '0')), '') END)")


def _ngroups(part: str) -> str:
    return f"(CASE WHEN {part} = '' THEN 0 ELSE len(string_split({part}, ':')) END)"


def ipv6_to_hex(s: str) -> str:
    head = f"split_part({s}, '::', 1)"
    tail = f"split_part({s}, '::', 2)"
    nz = f"(8 - {_ngroups(head)} - {_ngroups(tail)})"
    return (f"(CASE WHEN coalesce({matches(s, N.IPV6_FULL_RE)}, false) THEN {_hexpad(s)} "
            f"WHEN coalesce({matches(s, N.IPV6_GAP_RE)}, false) AND {nz} >= 1 THEN "
            f"{_hexpad(head)} || repeat('0000', {nz}) || {_hexpad(tail)} END)")


def v4_is_private(n: str) -> str:
    return (f"({_between_any(n, N.v4_ranges(N.IPV4_PRIVATE))} AND NOT "
            f"{_between_any(n, N.v4_ranges(N.IPV4_PRIVATE_EXCEPTIONS))})")


def v4_is_global(n: str) -> str:
    return f"(NOT {_between_any(n, N.v4_ranges([N.IPV4_SHARED]))} AND NOT {v4_is_private(n)})"


def v6_is_private(h: str) -> str:
    mapped_v4 = f"CAST(('0x' || substr({h}, 25, 8)) AS BIGINT)"
    native = (f"({_between_any(h, N.v6_ranges(N.IPV6_PRIVATE))} AND NOT "
              f"{_between_any(h, N.v6_ranges(N.IPV6_PRIVATE_EXCEPTIONS))})")
    return f"(CASE WHEN starts_with({h}, {q(N.MAPPED_PREFIX)}) THEN {v4_is_private(mapped_v4)} ELSE {native} END)"


def ip_is_private(s: str) -> str:
    v4, v6 = ipv4_to_long(s), ipv6_to_hex(s)
    return (f"(CASE WHEN {v4} IS NOT NULL THEN {v4_is_private(v4)} "
            f"WHEN {v6} IS NOT NULL THEN {v6_is_private(v6)} END)")


def ipv4_is_global(s: str) -> str:
    v4 = ipv4_to_long(s)
    return f"coalesce(CASE WHEN {v4} IS NOT NULL THEN {v4_is_global(v4)} END, false)"


# -- headers -----------------------------------------------------------------

def has_dmarc_authentication(a: str) -> str:
    return f"coalesce(contains(lower({a}), 'dmarc='), false)"


def auth_word(a: str, key: str) -> str:
    return f"coalesce(lower({first(a, key + '=(' + H.WORD + '+)')}), 'none')"


def spf_result(s: str) -> str:
    return f"coalesce(lower({first(s, '^(' + H.WORD + '+)')}), 'none')"


def auth_method_result(a: str, method: str) -> str:
    return f"coalesce(lower({first(a, '(?i)' + method + WS + '*=' + WS + '*(' + H.WORD + '+)')}), 'none')"


def dkim_domain(sig: str) -> str:
    return f"lower({first(sig, r'd=([\p{L}\p{N}_.-]+)')})"


def dkim_match(sig: str, dom: str) -> str:
    return f"coalesce({dkim_domain(sig)} = lower({dom}), false)"


def to_from_match(a: str, b: str) -> str:
    return f"coalesce(lower({a}) = lower({b}), false)"


def spf_email(s: str) -> str:
    pat = r"envelope-from=[\"']?([^\"'>" + WS[1:-1] + r"]+)[\"']?"
    return f"lower({first(s, pat)})"


def spf_match(s: str, sender: str) -> str:
    return f"coalesce({spf_email(s)} = lower({sender}), false)"


def different_reply(f: str, r: str) -> str:
    no_reply = f"({r} IS NULL OR {r} = '')"
    no_from = f"({f} IS NULL OR {f} = '')"
    return f"(CASE WHEN {no_reply} THEN {no_from} ELSE ({no_from} OR {f} <> {r}) END)"


def _skipped(h: str) -> str:
    conds = " OR ".join(f"contains({h}, {q(m)})" for m in H.SKIP_MARKERS)
    return f"coalesce({conds}, true)"


def first_server_transfer(r: str) -> str:
    strong = (f"lambda h: NOT {_skipped('h')} AND ({matches('h', H._ws(H.ORG_RELAY))} OR "
              f"{matches('h', H.UNKNOWN_IPV4)} OR (contains(h, 'from') AND contains(h, 'by') AND "
              f"len(list_filter(regexp_extract_all(h, {q(H.IPV4_IN_BRACKETS)}, 1), "
              f"lambda ip: {ipv4_is_global('ip')})) > 0))")
    loose = f"lambda h: NOT {_skipped('h')} AND contains(h, 'from') AND contains(h, 'by')"
    return (f"coalesce(list_filter(list_reverse({r}), {strong})[1], "
            f"list_filter(list_reverse({r}), {loose})[1])")


def received_domain(h: str) -> str:
    direct = first(h, "from" + WS + "+(" + H.HOST + ")[" + WS[1:-1] + r"\(]")
    helo = first(h, "from" + WS + r"+[^\(]*\([^H]*HELO" + WS + "+(" + H.HOST + ")")
    return f"coalesce({direct}, {helo})"


def received_ip(h: str) -> str:
    v4 = f"regexp_extract_all({h}, {q(H.IPV4_IN_BRACKETS)}, 1)[1]"
    cands = " || ".join(f"regexp_extract_all({h}, {q(p)}, 1)" for p in H.IPV6_SHAPES)
    v6 = f"list_filter({cands}, lambda m: length(m) - length(replace(m, ':', '')) >= 2)[1]"
    return f"coalesce({v4}, {v6})"


def from_org(h: str) -> str:
    return f"coalesce({matches(h, '(?i)' + H.org_from_pattern())}, false)"


def name_servers_match(a: str, b: str) -> str:
    return f"coalesce(len({a}) > 0 AND len({b}) > 0 AND list_sort({a}) = list_sort({b}), false)"


def routing(r: str) -> str:
    pos = (f"list_position(list_transform({r}, lambda h: NOT coalesce("
           f"{matches('h', H.org_from_pattern())}, false)), true)")
    return f"coalesce({r}[{pos}:], []::VARCHAR[])"


def internal_count(routing_expr: str) -> str:
    return (f"len(list_filter({routing_expr}, lambda x: coalesce("
            f"{ip_is_private(received_ip('x'))}, false)))")


def url_in_subject(s: str) -> str:
    return f"coalesce({matches(s, H.SUBJECT_URL)}, false)"


# -- content -------------------------------------------------------------------

def unescape(s: str) -> str:
    out = s
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def text_clean(t: str) -> str:
    return (f"ltrim(replace(trim(regexp_replace({t}, {q(WS + '+')}, ' ', 'g'), ' '), "
            f"{q(C.CAUTION_TAG)}, ''), ' ')")


# Markup by RE2, apart from the expressions it checks: blocks without visible text, tags, and the
# href of a tag found by walking its attributes from the left.
_QUOTED = r"""(?:[^'">]|"[^"]*"|'[^']*')*"""
_BLOCKS = (r"(?is:<!--.*?(?:-->|\z)|<script\b" + _QUOTED + r">.*?(?:</script\s*>|\z)|<style\b" + _QUOTED + r">.*?(?:</style\s*>|\z))")
_TAGS = r"</[a-zA-Z][^>]*>|<[a-zA-Z]" + _QUOTED + r">|<[a-zA-Z][^>]*>"
_BEFORE = r"""^<[aA](?:[\s/]+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?[\s/]+(?i:href)"""


def _unmarked(html: str) -> str:
    return f"regexp_replace({html}, {q(_BLOCKS)}, '', 'g')"


def hyperlinks(html: str) -> str:
    tags = f"regexp_extract_all({_unmarked(f'coalesce({html}, {q(str())})')}, {q(_TAGS)}, 0)"
    own = f"list_filter({tags}, lambda t: regexp_matches(t, {q(_BEFORE)}))"
    value = " || ".join(f"coalesce(regexp_extract(t, {q(_BEFORE + part)}, 1), '')" for part in (
        r"""\s*=\s*"([^"]*)\"""", r"""\s*=\s*'([^']*)'""", r"""\s*=\s*([^\s"'>]+)"""))
    return f"list_sort(list_distinct(list_transform(list_transform({own}, lambda t: {value}), lambda u: {unescape('u')})))"


def html_to_text(html: str) -> str:
    return unescape(f"regexp_replace({_unmarked(html)}, {q(_TAGS)}, '', 'g')")


def non_ascii(t: str) -> str:
    return f"coalesce({matches(t, r'[^\x00-\x7F]')}, false)"


def hidden_text(h: str) -> str:
    conds = " OR ".join(f"contains({h}, {q(p)})" for p in C.HIDDEN_PATTERNS)
    return f"coalesce({conds}, false)"


def html_parsing_error(html: str) -> str:
    """Levels instead of a stack: a closing tag must equal the last earlier mark of its level, which must be open."""
    void = ", ".join(q(v) for v in C.VOID_TAGS)
    tags = f"list_filter(regexp_extract_all({_unmarked(html)}, {q(_TAGS)}, 0), lambda t: NOT ends_with(t, '/>'))"
    marks = (f"list_filter(list_transform({tags}, lambda t: regexp_extract(lower(t), '^<(/?[a-z][^\\s/>]*)', 1)), "
             f"lambda n: NOT list_contains([{void}], ltrim(n, '/')))")
    sign = "list_transform(m, lambda x: CASE WHEN starts_with(x, '/') THEN -1 ELSE 1 END)"
    level = f"list_transform(range(1, len(m) + 1), lambda i: list_sum({sign}[1:i]) + CASE WHEN starts_with(m[i], '/') THEN 1 ELSE 0 END)"
    fits = ("list_transform(range(1, len(m) + 1), lambda i: NOT starts_with(m[i], '/') OR "
            "coalesce('/' || m[list_max(list_filter(range(1, i), lambda j: v[j] = v[i]))] = m[i], false))")
    fine = (f"list_transform([{marks}], lambda m: coalesce(list_sum({sign}), 0) = 0 AND list_transform([{level}], "
            f"lambda v: coalesce(list_bool_and({fits}), true))[1])[1]")
    return (f"(CASE WHEN {html} IS NULL THEN 0 WHEN contains({html}, chr(65533)) THEN -1 WHEN {fine} THEN 0 ELSE 1 END)")


def word_count(t: str) -> str:
    return f"coalesce({rcount(t, NOT_WS + '+')}, 0)"


def readable(clean: str, html: str) -> str:
    prop = f"(length({clean}) / length({html}))"
    return (f"(CASE WHEN {html} IS NULL OR {html} = '' THEN 0.0 WHEN {prop} BETWEEN 0 AND 1 "
            f"THEN {prop} ELSE 0.0 END)")


def whitespace_ratio(t: str) -> str:
    return (f"(CASE WHEN {t} IS NULL OR length({t}) = 0 THEN 0.0 ELSE "
            f"{rcount(t, WS)} / length({t}) END)")


def alphabet_proportion(t: str) -> str:
    return (f"(CASE WHEN {t} IS NULL OR length({t}) = 0 THEN 0.0 ELSE "
            f"{rcount(t, LETTER)} / length({t}) END)")


def grammar_rate(tp: str, lang: str, n: str) -> str:
    tags = ", ".join(q(t) for t in C.ENGLISH_TAGS)
    words = word_count(tp)
    return (f"(CASE WHEN NOT (lower({lang}) IS NULL OR lower({lang}) = '' OR lower({lang}) IN ({tags})) "
            f"THEN 1.0 WHEN {n} IS NULL OR {words} = 0 THEN 0.0 "
            f"WHEN {n} / {words} > 1 THEN 1.0 ELSE {n} / {words} END)")


def content_counts(types: str) -> tuple[str, str, str]:
    t = f"coalesce({types}, []::VARCHAR[])"
    media = "(starts_with(x, 'image/') OR starts_with(x, 'audio/') OR starts_with(x, 'video/'))"
    text = f"len(list_filter({t}, lambda x: starts_with(x, 'text/')))"
    mm = f"len(list_filter({t}, lambda x: {media}))"
    oth = (f"len(list_filter({t}, lambda x: NOT starts_with(x, 'multipart/') AND "
           f"NOT starts_with(x, 'text/') AND NOT {media}))")
    return text, mm, oth


def hyperlink_prop(links: str, words: str) -> str:
    n = f"coalesce(len({links}), 0)"
    return (f"(CASE WHEN {n} <= 0 THEN 0.0 WHEN {words} = 0 THEN 1.0 "
            f"ELSE least({n} / {words}, 1.0) END)")


def has_pdf(types: str) -> str:
    return f"coalesce(list_contains({types}, 'application/pdf'), false)"


def label_map_values() -> str:
    from mailguard.operators.features import LABEL_MAP
    rows = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in LABEL_MAP)
    return f"(VALUES {rows}) AS lm(folder, target_3, target_2, target_1)"
