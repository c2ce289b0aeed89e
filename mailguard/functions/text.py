"""Text scalar helpers as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailguard.functions.content import CAUTION_TAG
from mailguard.functions.patterns import NOT_WS, WORD_CHARS, WS


def _accent_table(lo: int = 0x00C0, hi: int = 0x024F) -> tuple[str, str]:
    """Characters of the Latin-1 Supplement and Latin Extended-A/B blocks whose
    NFKD decomposition minus combining marks is one different character
    (the rule behind ``strip_accents='unicode'``), with their base letters."""
    src, dst = [], []
    for cp in range(lo, hi + 1):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()

# The vectoriser's stop list is the two literal words.
VECTORIZER_STOP_WORDS = ("english", "french")
TOKEN = "[" + WORD_CHARS + "]{2,}"

CLOCK_TIME = r"\b[0-9]{1,2}:[0-9]{2}(?:" + WS + r"*[–-]" + WS + r"*[0-9]{1,2}:[0-9]{2})?\b"
EMAIL_LIKE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL_LIKE = r"^(?:https?://|www\.)|\.(?:com|org|net|edu|gov|ca|io)(?:/|$)"
NUMBER_LIKE = r"^[0-9]+(?:[.,][0-9]+)*(?:px|em|%)?$"

# English function words removed before topic modelling
# (a compact stand-in for a tagger's stop list).
TOPIC_STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_accents(t) -> Column:
    return F.translate(_c(t), ACCENTED, UNACCENTED)


def vectorizer_tokens(t, stop_words=VECTORIZER_STOP_WORDS) -> Column:
    """Lower-case, strip accents, tokens of two or more word characters,
    minus the stop list (the two literal words by default)."""
    toks = F.regexp_extract_all(strip_accents(F.lower(F.coalesce(_c(t), F.lit("")))), F.lit(TOKEN), 0)
    if not stop_words:
        return toks
    return F.filter(toks, lambda x: ~x.isin(*stop_words))


def topic_tokens(t, min_len: int = 2) -> Column:
    """T8 (re-aimed, no lemma/POS/NER): drop the caution banner and clock times,
    lower-case white-space tokens stripped of edge punctuation, then drop stop
    words, tokens not longer than ``min_len``, e-mails, URLs and numbers or
    sizes like ``10px``/``50%``."""
    x = F.replace(F.coalesce(_c(t), F.lit("")), F.lit(CAUTION_TAG), F.lit(""))
    x = F.regexp_replace(x, CLOCK_TIME, " ")
    raw = F.regexp_extract_all(F.lower(x), F.lit(NOT_WS + "+"), 0)
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", ""))
    return F.filter(trimmed, lambda w: (F.length(w) > min_len) & ~w.isin(*TOPIC_STOP_WORDS)
                    & ~w.rlike(EMAIL_LIKE) & ~w.rlike(URL_LIKE) & ~w.rlike(NUMBER_LIKE))


def strip_think(t) -> Column:
    """Drop ``<think>...</think>`` blocks, squeeze blank lines, trim."""
    x = F.regexp_replace(_c(t), r"(?s)<think>.*?</think>", "")
    x = F.regexp_replace(x, "\n" + WS + "*\n", "\n\n")
    return F.regexp_replace(x, "^" + WS + "+|" + WS + "+$", "")


def truncate_tokens(t, max_tokens: int = 2500, suffix: str = "...[content truncated]") -> Column:
    """Keep ``4 * max_tokens`` characters and mark the cut."""
    limit = max_tokens * 4
    x = _c(t)
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit(suffix))).otherwise(x)


def chunks(t, size: int = 512) -> Column:
    """The whole text as consecutive ``size``-character pieces."""
    x = F.coalesce(_c(t), F.lit(""))
    n = F.greatest(F.ceil(F.length(x) / F.lit(size)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(x, i * size + 1, size))
