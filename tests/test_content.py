"""Golden rows for content features (Q16 Unicode classes, Q19 docstring fixes)."""

from pyspark.sql import functions as F

import pytest

from mailguard.functions import content as C
from mailguard.functions import text as TX


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {'array<string>' if isinstance(cols[n], list) else 'string'}" for n in names)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], schema)
    return df.select(expr.alias("v")).first()["v"]


def test_text_clean(spark):
    t = "[CAUTION: Non-UBC Email]  Hello\n\t world  again  "
    assert one(spark, C.text_clean("t"), t=t) == "Hello world again"


def test_word_count_unicode_whitespace(spark):
    assert one(spark, C.word_count("t"), t="a b c  d\n") == 4
    assert one(spark, C.word_count("t"), t="") == 0


def test_ratios(spark):
    assert abs(one(spark, C.alphabet_proportion("t"), t="abcd1234éèàç!!?.") - 8 / 16) < 1e-12
    assert abs(one(spark, C.alphabet_proportion("t"), t="Hello World! 123") - 10 / 16) < 1e-12
    assert one(spark, C.whitespace_ratio("t"), t="") == 0.0
    assert abs(one(spark, C.whitespace_ratio("t"), t="a b c") - 2 / 5) < 1e-12
    assert abs(one(spark, C.readable_proportion("c", "h"), c="x" * 12, h="y" * 38) - 12 / 38) < 1e-12
    assert one(spark, C.readable_proportion("c", "h"), c="x" * 50, h="y" * 38) == 0.0
    assert one(spark, C.readable_proportion("c", "h"), c="x", h=None) == 0.0


def test_non_ascii_and_hidden(spark):
    assert one(spark, C.non_ascii_present("t"), t="你好") is True
    assert one(spark, C.non_ascii_present("t"), t="plain") is False
    assert one(spark, C.hidden_text_present("h"), h='<p style="display:none">x</p>') is True
    assert one(spark, C.hidden_text_present("h"), h=None) is False


def test_hyperlinks_and_parsing(spark):
    h = '<a href="http://a.com/?x=1&amp;y=2">a</a><A class="c" HREF=\'/b\'>b</A><a href="/b">dup</a>'
    assert one(spark, C.hyperlinks("h"), h=h) == ["/b", "http://a.com/?x=1&y=2"]
    assert one(spark, C.hyperlinks("h"), h=None) == []
    assert one(spark, C.html_parsing_error("h"), h="<div><p>x</p><br></div>") == 0
    assert one(spark, C.html_parsing_error("h"), h="<div><p>x</div>") == 1
    assert one(spark, C.html_parsing_error("h"), h='<script>var t="</p>";</script><p>x</p>') == 0
    assert one(spark, C.html_parsing_error("h"), h=None) == 0


@pytest.mark.parametrize(("html", "links", "error", "text"), [
    ("<a href=/u?x=1&amp;y=2>t</a>", ["/u?x=1&y=2"], 0, "t"),
    ("<a href=/u/>t", ["/u/"], 0, "t"),
    ('<a title="a > b" class=c href = "/q">t</a>', ["/q"], 0, "t"),
    ("<a title='href=\"/no\"' data-href=/no>t</a>", [], 0, "t"),
    ("<A\nHREF='/up'>t</A >", ["/up"], 0, "t"),
    ('<!-- <a href="/c"> --><script>"<a href=/s>"</script><STYLE>p > a</STYLE>t', [], 0, "t"),
    ('<abbr href="/n">t</abbr><a href="">u</a>', [""], 0, "tu"),
    ("<b><i>t</b></i>", [], 1, "t"), ("</p><p>", [], 1, ""), ("<p></p></p><p>", [], 1, ""), ("<p><br>t<img src='>'/></p>", [], 0, "t"),
    ("a < b &lt;c&gt;", [], 0, "a < b <c>"), ('<a href="/open>t</a>', [""], 0, "t"), ("<p>\ufffd</p>", [], -1, "\ufffd"),
    ("<a " + "x " * 20000, [], 0, None), ("<p " + "a='1' " * 5000 + "><a href=/z></a></p>", ["/z"], 0, ""),
])
def test_markup_in_order(spark, html, links, error, text):
    assert one(spark, C.hyperlinks("h"), h=html) == links
    assert one(spark, C.html_parsing_error("h"), h=html) == error
    if text is not None:
        assert one(spark, C.html_to_text("h"), h=html) == text


def test_content_count_and_empty_body(spark):
    cc = one(spark, C.content_count("t"), t=["multipart/mixed", "text/plain", "image/png",
                                            "application/pdf", "video/mp4"])
    assert (cc["text"], cc["multimedia"], cc["others"]) == (1, 2, 1)
    df = spark.createDataFrame([("", 0, 0, [])], "c string, m int, o int, l array<string>")
    assert df.select(C.is_body_empty("c", "m", "o", "l")).first()[0] is True


def test_hyperlink_proportion(spark):
    df = spark.createDataFrame([([], 5), (["a"], 0), (["a", "b"], 4), (["a", "b", "c"], 1)],
                               "l array<string>, w int")
    got = [r[0] for r in df.select(C.hyperlink_proportion("l", "w")).collect()]
    assert got == [0.0, 1.0, 0.5, 1.0]


def test_grammar_rate(spark):
    df = spark.createDataFrame([("a b c d", "fr", 1), ("a b c d", None, 1), ("a b", "en-US", 5),
                                ("", "en", 3), ("a b", "en", None)], "t string, l string, n int")
    got = [r[0] for r in df.select(C.grammar_error_rate("t", "l", "n")).collect()]
    assert got == [1.0, 0.25, 1.0, 0.0, 0.0]


def test_vectorizer_tokens(spark):
    got = one(spark, TX.vectorizer_tokens("t"), t="Élan ÇA va a english French x2 über")
    assert got == ["elan", "ca", "va", "x2", "uber"]      # Q13: only the two literal stop words


def test_topic_tokens_and_llm_helpers(spark):
    got = one(spark, TX.topic_tokens("t"), t="[CAUTION: Non-UBC Email] Meet at 10:30 with bob@x.com "
                                               "re www.site.com the invoice 100% 10px payment!")
    assert got == ["meet", "invoice", "payment"]
    assert one(spark, TX.strip_think("t"), t="<think>a\nb</think>\n \n\nAnswer\n\n\nmore ") == "Answer\n\nmore"
    assert one(spark, TX.truncate_tokens("t", 1, "..."), t="abcdefgh") == "abcd..."
    assert one(spark, TX.chunks("t", 3), t="abcdefg") == ["abc", "def", "g"]
