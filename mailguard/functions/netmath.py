"""IP address parsing and special-purpose range tests as Spark expressions.

Semantics follow Python's ``ipaddress`` module (3.12.4+ tables): IPv4 octets
must be decimal without leading zeros and <= 255; IPv6 is the pure-hex form
with at most one ``::``.  ``is_private`` is "inside a private network and not
inside an exception"; IPv4 ``is_global`` additionally excludes the shared
100.64.0.0/10 block, so an address there is neither private nor global.
IPv4-mapped IPv6 addresses take the class of the embedded IPv4 address.

All tests are range comparisons on an integer (IPv4) or on a fixed-width
lower-case hex string (IPv6, where lexical order equals numeric order).  The
expressions are emitted as Spark SQL text (``*_sql``) because the range
tables make them large; the Column wrappers parse them once with ``F.expr``.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailguard.functions import sqltext as S

# Special-purpose blocks as listed by Python's ipaddress
# module (IANA special registries).
IPV4_PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16",
                "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
                "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
                "240.0.0.0/4", "255.255.255.255/32"]
IPV4_PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
IPV4_SHARED = "100.64.0.0/10"
IPV6_PRIVATE = ["::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
                "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
IPV6_PRIVATE_EXCEPTIONS = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32",
                           "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

IPV4_RE = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"
HEX4 = "[0-9a-fA-F]{1,4}"
IPV6_FULL_RE = rf"^{HEX4}(:{HEX4}){{7}}$"
IPV6_GAP_RE = rf"^({HEX4}(:{HEX4})*)?::({HEX4}(:{HEX4})*)?$"
MAPPED_PREFIX = "0" * 20 + "ffff"


def v4_ranges(cidrs: list[str]) -> list[tuple[int, int]]:
    out = []
    for c in cidrs:
        n = ipaddress.ip_network(c)
        out.append((int(n.network_address), int(n.broadcast_address)))
    return out


def v6_ranges(cidrs: list[str]) -> list[tuple[str, str]]:
    out = []
    for c in cidrs:
        n = ipaddress.ip_network(c)
        out.append((f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}"))
    return out


# -- SQL text (inputs are cheap references: column names or lambda vars) ----

def ipv4_to_long_sql(x: str) -> str:
    """Dotted quad -> BIGINT, null when ``ipaddress`` would reject it."""
    parts = f"split({x}, '[.]')"
    o, acc = S.var("o"), S.var("a")
    return (f"CASE WHEN coalesce({x} RLIKE {S.rx(IPV4_RE)}, false) THEN "
            f"CASE WHEN forall({parts}, {o} -> try_cast({o} AS INT) <= 255) THEN "
            f"aggregate({parts}, 0L, ({acc}, {o}) -> {acc} * 256 + try_cast({o} AS BIGINT)) END END")


def _groups_sql(part: str) -> str:
    return f"CASE WHEN {part} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({part}, ':') END"


def _pad_sql(arr: str) -> str:
    g = S.var("g")
    return f"array_join(transform({arr}, {g} -> lpad(lower({g}), 4, '0')), '')"


def ipv6_to_hex_sql(x: str) -> str:
    """Pure-hex IPv6 text -> 32 lower-case hex digits, null when invalid."""
    halves = (f"named_struct('head', {_groups_sql(f'substring_index({x}, {chr(39)}::{chr(39)}, 1)')}, "
              f"'tail', {_groups_sql(f'substring_index({x}, {chr(39)}::{chr(39)}, -1)')})")

    def fill(hv: str) -> str:
        nz = f"(8 - size({hv}.head) - size({hv}.tail))"
        return (f"CASE WHEN {nz} >= 1 THEN concat({_pad_sql(hv + '.head')}, repeat('0000', {nz}), "
                f"{_pad_sql(hv + '.tail')}) END")

    return (f"CASE WHEN coalesce({x} RLIKE {S.rx(IPV6_FULL_RE)}, false) THEN {_pad_sql(f'split({x}, {chr(39)}:{chr(39)})')} "
            f"WHEN coalesce({x} RLIKE {S.rx(IPV6_GAP_RE)}, false) THEN {S.let(halves, fill)} END")


def v4_is_private_sql(n: str) -> str:
    return (f"({S.any_between(n, v4_ranges(IPV4_PRIVATE))} AND NOT "
            f"{S.any_between(n, v4_ranges(IPV4_PRIVATE_EXCEPTIONS))})")


def v4_is_global_sql(n: str) -> str:
    return f"(NOT {S.any_between(n, v4_ranges([IPV4_SHARED]))} AND NOT {v4_is_private_sql(n)})"


def v6_is_private_sql(h: str) -> str:
    mapped = f"CAST(conv(substring({h}, 25, 8), 16, 10) AS BIGINT)"
    native = (f"({S.any_between(h, v6_ranges(IPV6_PRIVATE))} AND NOT "
              f"{S.any_between(h, v6_ranges(IPV6_PRIVATE_EXCEPTIONS))})")
    return (f"CASE WHEN startswith({h}, {S.s(MAPPED_PREFIX)}) THEN {S.let(mapped, v4_is_private_sql)} "
            f"ELSE {native} END")


def ip_is_private_sql(x: str) -> str:
    """True/False for parsable IPv4/IPv6 text, null when unparsable."""
    parsed = f"named_struct('v4', {ipv4_to_long_sql(x)}, 'v6', {ipv6_to_hex_sql(x)})"
    return S.let(parsed, lambda p: (f"CASE WHEN {p}.v4 IS NOT NULL THEN {v4_is_private_sql(p + '.v4')} "
                                    f"WHEN {p}.v6 IS NOT NULL THEN {v6_is_private_sql(p + '.v6')} END"))


def ipv4_is_global_sql(x: str) -> str:
    """IPv4 ``is_global``; an unparsable quad counts as not global."""
    return ("coalesce(" + S.let(ipv4_to_long_sql(x),
                                lambda n: f"CASE WHEN {n} IS NOT NULL THEN {v4_is_global_sql(n)} END")
            + ", false)")


# -- Column API ------------------------------------------------------------------

def _ref(col) -> str:
    if not isinstance(col, str):
        raise TypeError("pass a column name; stage computed inputs with withColumn first")
    return S.ident(col)


def ipv4_to_long(col) -> Column:
    return F.expr(ipv4_to_long_sql(_ref(col)))


def ipv6_to_hex(col) -> Column:
    return F.expr(ipv6_to_hex_sql(_ref(col)))


def ip_is_private(col) -> Column:
    return F.expr(ip_is_private_sql(_ref(col)))


def ipv4_is_global(col) -> Column:
    return F.expr(ipv4_is_global_sql(_ref(col)))


def ip_is_global(col) -> Column:
    """IPv4 rule for dotted quads, IPv6 ``not is_private`` otherwise."""
    x = _ref(col)
    parsed = f"named_struct('v4', {ipv4_to_long_sql(x)}, 'v6', {ipv6_to_hex_sql(x)})"
    return F.expr(S.let(parsed, lambda p: (
        f"CASE WHEN {p}.v4 IS NOT NULL THEN {v4_is_global_sql(p + '.v4')} "
        f"WHEN {p}.v6 IS NOT NULL THEN NOT {v6_is_private_sql(p + '.v6')} END")))
