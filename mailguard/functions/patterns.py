"""Regex character classes that behave alike in Java (Spark) and RE2 (DuckDB).

The features are defined on Python's Unicode-aware ``re`` and ``str``
methods; Java's and RE2's ``\\s``/``\\w``/``\\d`` are ASCII by default, so the
classes are spelled out explicitly and used by both the Spark expressions and
the oracle SQL.
"""

# Python str.isspace() characters -- the ASCII controls
# \t \n \x0b \x0c \r, the separators \x1c-\x1f, NEL \x85 and every Unicode
# separator (Zs, Zl, Zp).
WS_CHARS = r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F}\x{85}\p{Z}"
WS = "[" + WS_CHARS + "]"
NOT_WS = "[^" + WS_CHARS + "]"

# Python str.isalnum() plus underscore, i.e. re's Unicode \w.
WORD_CHARS = r"\p{L}\p{N}_"
WORD = "[" + WORD_CHARS + "]"
NOT_WORD = "[^" + WORD_CHARS + "]"

# Python str.isalpha().
LETTER = r"\p{L}"
