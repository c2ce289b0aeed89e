"""Body and content features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailguard.functions._expr import let
from mailguard.functions.patterns import LETTER, WS

# Banner the mail gateway prepends; removed from text_clean.
CAUTION_TAG = "[CAUTION: Non-UBC Email]"

# Markup snippets that hide text, matched as exact substrings.
HIDDEN_PATTERNS = (
    'style="color: white;"',
    'style="color:#ffffff"',
    'style="display:none"',
    'style="visibility:hidden"',
    'style="opacity:0"',
    'style="font-size:0px"',
    'style="height:0px"',
    '<div hidden',
    'class="hidden"',
)

# HTML void elements (never closed), per the HTML standard.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr")

# English language tags that the grammar check accepts.
ENGLISH_TAGS = ("en", "en-us", "en-gb", "en-ca", "en-au")

# One piece of markup, in document order: a comment, a script or style block, a closing tag or an
# opening tag, whose quoted attribute values may hold any character.  Possessive: no backtracking.
_INSIDE = r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+"
RAW_TEXT_BLOCKS = (r"<!--[\s\S]*?(?:-->|\z)|(?i:<script\b" + _INSIDE + r">[\s\S]*?(?:</script\s*>|\z)|<style\b" + _INSIDE
                   + r">[\s\S]*?(?:</style\s*>|\z))")
MARKUP = RAW_TEXT_BLOCKS + r"|</[a-zA-Z][^>]*+>|<[a-zA-Z]" + _INSIDE + r">|<[a-zA-Z][^>]*+>"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unescape_basic(s: Column) -> Column:
    """Decode the five predefined XML entities (as an HTML parser would)."""
    out = s
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


# -- P5-P7, P12 -------------------------------------------------------------

def text_clean(text_plain, tag: str = CAUTION_TAG) -> Column:
    """P5: collapse white-space runs, drop the caution banner, left-trim."""
    collapsed = F.trim(F.regexp_replace(_c(text_plain), WS + "+", " "))
    return F.ltrim(F.replace(collapsed, F.lit(tag), F.lit("")))


def html_to_text(html) -> Column:
    """Visible text of an HTML document: markup, script and style dropped, entities decoded."""
    return unescape_basic(F.regexp_replace(_c(html), MARKUP, ""))


def _tags(html: Column) -> Column:
    """Opening and closing tags in document order, without comments and raw text blocks."""
    return F.filter(F.regexp_extract_all(html, F.lit(MARKUP), 0), lambda t: ~t.rlike(r"^(?i:<!--|<script\b|<style\b)"))


def _tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, TAG_NAME, 1))


def _href(tag: Column) -> Column:
    """Value of the first ``href`` of an opening tag, quoted or not; null without one."""
    def groups(attrs: Column) -> Column:
        at = F.array_position(F.transform(F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), 1), lambda n: F.lower(n)), "href").cast("int") - 1
        values = [F.coalesce(F.get(F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), g), at), F.lit("")) for g in (2, 3, 4)]
        return F.when(at >= 0, F.concat(*values))
    return let(F.substring(tag, 3, 1 << 30), groups)


def hyperlinks(html) -> Column:
    """Distinct ``href`` values of ``<a>`` tags (sorted); [] for null.

    Unquoted values, ``>`` inside attributes and upper case are read as a
    parser reads them; links in comments, scripts and styles are not links.
    """
    links = F.transform(F.filter(_tags(F.coalesce(_c(html), F.lit(""))), lambda t: t.rlike(r"^<[aA][\s/]")), _href)
    return F.array_sort(F.array_distinct(F.transform(F.filter(links, lambda u: u.isNotNull()), unescape_basic)))


def empty_if_null(col) -> Column:
    """Null text -> empty string."""
    return F.coalesce(_c(col), F.lit(""))


# -- C1-C7 --------------------------------------------------------------------

def non_ascii_present(t) -> Column:
    """Any character outside 7-bit ASCII, each of which has more bytes than one; null -> false."""
    return F.coalesce(F.octet_length(_c(t)) > F.char_length(_c(t)), F.lit(False))


def hidden_text_present(html) -> Column:
    """Any of the fixed hiding snippets; null -> false."""
    h = _c(html)
    cond = F.lit(False)
    for p in HIDDEN_PATTERNS:
        cond = cond | h.contains(p)
    return F.coalesce(cond, F.lit(False))


def html_parsing_error(html) -> Column:
    """C3 (re-aimed): 0 for null html or properly nested markup, 1 where a tag
    is closed that is not the last one open, or one stays open, -1 where bytes
    could not be decoded (U+FFFD).  Void and self-closing tags, comments,
    script and style are left out."""
    marks = F.transform(F.filter(_tags(_c(html)), lambda t: ~t.endswith("/>")),
                        lambda t: F.concat(F.when(t.startswith("</"), F.lit("/")).otherwise(F.lit("")), _tag_name(t)))
    marks = F.filter(marks, lambda n: ~F.ltrim(n, F.lit("/")).isin(*VOID_TAGS))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(False).alias("bad"))

    def step(state: Column, mark: Column) -> Column:
        open_, depth = state["open"], F.size(state["open"])
        fits = F.coalesce(F.concat(F.lit("/"), F.get(open_, depth - 1)) == mark, F.lit(False))
        opened = F.struct(F.concat(open_, F.array(mark)).alias("open"), state["bad"].alias("bad"))
        closed = F.struct(F.slice(open_, F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("open"), (state["bad"] | ~fits).alias("bad"))
        return F.when(state["bad"], state).when(mark.startswith("/"), closed).otherwise(opened)

    wrong = F.aggregate(marks, start, step, lambda s: s["bad"] | (F.size(s["open"]) > 0))
    return (F.when(_c(html).isNull(), F.lit(0)).when(F.contains(_c(html), F.lit("\ufffd")), F.lit(-1))
            .when(wrong, F.lit(1)).otherwise(F.lit(0)))


def count_matches(t, char_class: str) -> Column:
    """Number of characters of ``t`` in a single-character regex class.

    Counted as a length difference after deleting runs of the class: one pass
    that builds one string, instead of ``regexp_count`` which materialises
    every match as its own string.
    """
    t = _c(t)
    return F.length(t) - F.length(F.regexp_replace(t, char_class + "+", ""))


def word_count(t) -> Column:
    """C4: number of white-space separated tokens (Python ``str.split()``).

    White-space runs collapse to one blank, as in ``text_clean``; between the
    tokens there is then one blank less than tokens."""
    def words(one: Column) -> Column:
        return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1)
    return F.coalesce(let(F.trim(F.regexp_replace(_c(t), WS + "+", " ")), words), F.lit(0))


def readable_proportion(clean, html) -> Column:
    """len(text_clean)/len(text_html); null/empty html or outside [0,1] -> 0."""
    h = _c(html)
    prop = F.length(_c(clean)) / F.length(h)
    return (F.when(h.isNull() | (h == ""), F.lit(0.0))
            .when(prop.between(0, 1), prop).otherwise(F.lit(0.0)))


def whitespace_ratio(t) -> Column:
    """Share of white-space characters in text_plain; null/empty -> 0."""
    t = _c(t)
    return (F.when(t.isNull() | (F.length(t) == 0), F.lit(0.0))
            .otherwise(count_matches(t, WS) / F.length(t)))


def alphabet_proportion(t) -> Column:
    """Share of letters (``str.isalpha``); empty -> 0."""
    t = _c(t)
    return (F.when(t.isNull() | (F.length(t) == 0), F.lit(0.0))
            .otherwise(count_matches(t, LETTER) / F.length(t)))


# -- C8 ------------------------------------------------------------------------

def grammar_error_rate(text_plain, language, n_matches, words=None) -> Column:
    """Grammar matches per word of text_plain; ``words``: its word count, if known.

    Non-English language tag -> 1; no checker answer (null ``n_matches``) -> 0;
    no words -> 0; above 1 -> 1.  A null or empty tag counts as English.
    """
    lang = F.lower(_c(language))
    english = lang.isNull() | (lang == "") | lang.isin(*ENGLISH_TAGS)
    words = word_count(text_plain) if words is None else _c(words)
    prop = _c(n_matches) / words
    return (F.when(~english, F.lit(1.0))
            .when(_c(n_matches).isNull() | (words == 0), F.lit(0.0))
            .when(prop > 1, F.lit(1.0))
            .otherwise(prop.cast("double")))


# -- C11-C14 -----------------------------------------------------------------

def content_count(types) -> Column:
    """C11: struct(text, multimedia, others); ``multipart/*`` is skipped."""
    t = F.coalesce(_c(types), F.array().cast("array<string>"))

    def n(pred):
        return F.size(F.filter(t, pred))

    media = lambda x: x.startswith("image/") | x.startswith("audio/") | x.startswith("video/")
    return F.struct(
        n(lambda x: x.startswith("text/")).alias("text"),
        n(media).alias("multimedia"),
        n(lambda x: ~x.startswith("multipart/") & ~x.startswith("text/") & ~media(x)).alias("others"),
    )


def is_body_empty(clean, multimedia, others, links) -> Column:
    """No clean text, no multimedia or other parts and no links."""
    return ((F.coalesce(_c(clean), F.lit("")) == "") & (_c(multimedia) == 0)
            & (_c(others) == 0) & (F.coalesce(F.size(_c(links)), F.lit(0)) == 0))


def hyperlink_proportion(links, words) -> Column:
    """Links per word; no links -> 0, no words -> 1, clipped to [0,1]."""
    n = F.coalesce(F.size(_c(links)), F.lit(0))
    w = _c(words)
    return (F.when(n <= 0, F.lit(0.0)).when(w == 0, F.lit(1.0))
            .otherwise(F.least(n / w, F.lit(1.0))))


def has_pdf(types) -> Column:
    """C14: a part typed ``application/pdf``."""
    return F.coalesce(F.array_contains(_c(types), "application/pdf"), F.lit(False))
