"""Personal data by anchor expansion (operator 5).

An Aho-Corasick automaton finds anchors in a text: at-signs, schemes, plus
signs, digits joined by at most one separator and identifier cues.  At each anchor a
deterministic parser of its kind expands to the left and right, fixes the
boundaries and validates the candidate.  No pattern runs over whole texts.

The base kinds (email, ip, card, phone) follow fixed patterns matched leftmost
and without overlap per kind.  Further kinds are found beside them:

* ``address``: house number and street name around a street cue;
* ``account``: an IBAN with valid check digits, or digits after an account cue;
* ``secret``: the userinfo of a URL, or a value assigned to a credential cue.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm.common import slices, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")

# The character sets of the base kinds.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cues of the further kinds, lower case.
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive")
ACCOUNT_CUES = ("iban", "account number", "account no", "acct no")
SECRET_CUES = ("password", "passwd", "api_key", "api-key", "apikey", "secret", "token", "access_key", "private_key", "bearer")

# Characters of an IBAN by country.
IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}

_HOUSE = re.compile(r"(?<!\w)[1-9][0-9]{0,4}(?: [A-Z][a-z]+){1,3} $")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[ :#.]{1,3}([0-9](?:[ -]?[0-9]){7,17})(?![0-9])")
_VALUE = re.compile(r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']{0,2}([^\s\"',;]{8,})")
_BEARER = re.compile(r"[ \t]{1,3}([A-Za-z0-9._~+/=-]{16,})")
_USERINFO = re.compile(r"([^\s/@:]+:[^\s/@]+)@")


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in (("@", "email"), ("+", "phone"), ("://", "userinfo")):
        auto.add_word(word, (kind, len(word)))
    for d in "0123456789":      # identifier cues of numbers: a dot or a digit, also behind a space or hyphen, after a digit
        auto.add_word(f"{d}.", ("ip", 2))
        for e in "0123456789":
            for gap in ("", " ", "-"):
                auto.add_word(d + gap + e, ("card", 2 + len(gap)))
    for kind, cues in (("address", STREET_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            auto.add_word(cue, (kind, len(cue)))
    auto.make_automaton()
    return auto


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN that starts the candidate ends: at its country's length, else at the farthest
    end of a word, or of the candidate, where the check digits hold; 0 if they hold nowhere."""
    places = [i + 1 for i in range(start, end) if text[i] != " "]
    size = IBAN_SIZES.get(text[start:start + 2], 0)
    ends = [at for at in reversed(places) if at == end or not text[at].isalnum()]
    if 0 < size <= len(places):
        ends.insert(0, places[size - 1])
    return next((at for at in ends if iban_valid(text[start:at])), 0)


def _run_start(text: str, at: int, floor: int, separators: str) -> int:
    """Start of the chain of digits, joined by single separators, that ends at ``at``."""
    while at > floor:
        if text[at - 1] in _DIGITS:
            at -= 1
        elif text[at - 1] in separators and at - 2 >= floor and text[at - 2] in _DIGITS:
            at -= 2
        else:
            break
    return at


def _secret(text: str, first: int, end: int) -> re.Match | None:
    """The value that a cue at ``first:end`` is given: any behind a password's sign, else letters mixed with digits."""
    if text[first - 1:first].isalnum():
        return None
    cue = text[first:end].lower()
    m = (_BEARER if cue == "bearer" else _VALUE).match(text, end)
    mixed = m and any(c in _DIGITS for c in m[1]) and any(c.isalpha() for c in m[1])
    return m if m and (mixed or cue in ("password", "passwd")) else None


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then in the order of ``KINDS``."""
    spans: list[tuple[str, int, int]] = []
    upto = dict.fromkeys(KINDS, 0)    # end of the last candidate of each kind, match or not
    folded = text if text.isascii() and text.islower() else "".join(map(_fold, text)) if not text.isascii() else text.lower()
    for last, (kind, size) in _AUTOMATON.iter(folded):
        first = last - size + 1
        if kind == "email":
            start = first
            while start > upto["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, first + 1) if start < first else None
            if m:
                spans.append(("email", start, m.end()))
                upto["email"] = m.end()
        elif kind == "phone":
            if first >= upto["phone"] and (m := _PHONE.match(text, first)):
                upto["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append(("phone", first, m.end()))
        elif kind == "ip":
            if first >= upto["ip"]:
                start = first
                while start > upto["ip"] and text[start - 1] in _DIGITS:
                    start -= 1
                if m := _IP.match(text, start):
                    upto["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        spans.append(("ip", start, m.end()))
        elif kind == "card":
            if first >= upto["card"]:
                start = _run_start(text, first, upto["card"], " -")
                m = _CARD.match(text, start)
                upto["card"] = m.end()
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", start, m.end()))
        elif kind == "address":
            if not text[last + 1:last + 2].isalnum() and (m := _HOUSE.search(text, max(upto["address"], first - 60), first)):
                upto["address"] = last + 1
                spans.append(("address", m.start(), last + 1))
        elif kind == "account":
            if first >= upto["account"] and not text[first - 1:first].isalnum():
                m = _IBAN.search(text, last + 1, last + 45)
                end = _iban_end(text, *m.span()) if m and not text[m.start() - 1].isalnum() else 0
                if end:
                    spans.append(("account", m.start(), end))
                    upto["account"] = end
                elif m := _NUMBER.match(text, last + 1):
                    spans.append(("account", *m.span(1)))
                    upto["account"] = m.end()
        elif kind == "secret":
            if first >= upto["secret"] and (m := _secret(text, first, last + 1)):
                spans.append(("secret", *m.span(1)))
                upto["secret"] = m.end()
        elif m := _USERINFO.match(text, last + 1):
            if last + 1 >= upto["secret"]:
                spans.append(("secret", *m.span(1)))
                upto["secret"] = m.end()
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _fold(c: str) -> str:
    """Lower case of one character where it stays one character (offsets must not move)."""
    low = c.lower()
    return low if len(low) == 1 else c


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with every maximal run of spans replaced by the kind of its first span in angle brackets."""
    parts, at = [], 0
    for k, s, e in spans:
        if s >= at:
            parts += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def find_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` (array of kind, start, end) and ``redacted`` per row; no shuffle.

    Offsets count code points, ends are exclusive.  Null counts as empty (no
    spans, redacted text ''); repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    d = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("spans", span),
                           T.StructField("redacted", T.StringType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [find(t) for t in texts]
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
            out = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(out, pa.string())], names=schema.names)

    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def brute_force(text: str) -> list[tuple[str, int, int]]:
    """Base kinds by their patterns over the whole text (reference for tests)."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c in _DIGITS for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
