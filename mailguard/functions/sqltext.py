"""Spark SQL text builders for large expressions.

A Column built with many ``pyspark.sql.functions`` calls costs one JVM round
trip per call; an expression with hundreds of nodes (IP range tables, routing
scans with nested lambdas) is cheaper to write as SQL text and parse once with
``F.expr``.  The functions here take SQL text for their inputs (a column
name or a lambda variable) and return SQL text.
"""

from __future__ import annotations

import itertools

_ids = itertools.count()


def rx(pattern: str) -> str:
    """Raw SQL literal for a Java regex (no backslash escaping)."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def s(text: str) -> str:
    """Plain SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def var(prefix: str = "v") -> str:
    """Fresh lambda-variable name."""
    return f"{prefix}{next(_ids)}"


def let(value: str, body) -> str:
    """Bind ``value`` once and evaluate ``body(var)`` (see ``_expr.let``)."""
    v = var("b")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def any_between(x: str, ranges) -> str:
    parts = []
    for lo, hi in ranges:
        a = str(lo) if isinstance(lo, int) else s(lo)
        b = str(hi) if isinstance(hi, int) else s(hi)
        parts.append(f"({x} BETWEEN {a} AND {b})")
    return "(" + " OR ".join(parts) + ")"
