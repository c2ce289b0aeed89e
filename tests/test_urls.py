"""URL flags (U5-U10) against a table of expected flags, URL extraction, language vote."""

import pytest

from mailguard.functions import urls as U
from mailguard.operators import features as FE

# url, then the expected flags
FLAGS = ("ip", "http", "at", "port", "long", "subdomains")
CASES = [
    ("http://192.168.0.1/index.html", {"ip", "http", "subdomains"}),
    ("https://example.com", set()),
    ("www.example.com/a", set()),
    ("http://user@evil.com/x", {"http", "at"}),
    ("http://site.org:8000/page", {"http", "port"}),
    ("https://a.b.c.com/", {"subdomains"}),
    ("http://UBC.com@bad.com", {"http", "at"}),
    ("/relative/link", set()),
    ("https://x.example.com:443", {"port"}),
    ("http://" + "a" * 80 + ".com", {"http", "long"}),
    ("https://[2001:db8::1]:8443/p", {"port"}),
]


@pytest.mark.parametrize("url,expected", CASES)
def test_single_url_flags(spark, url, expected):
    df = spark.createDataFrame([([url],)], "u array<string>")
    r = df.select(U.has_ip_url("u").alias("ip"), U.has_http_only("u").alias("http"),
                  U.has_at_symbol("u").alias("at"), U.has_port_number("u").alias("port"),
                  U.has_long_url("u").alias("long"),
                  U.has_multiple_subdomains("u").alias("subdomains")).first().asDict()
    assert r == {f: f in expected for f in FLAGS}


def test_extract_urls(spark):
    df = spark.createDataFrame([("see www.a.com, and https://b.org/x) now", '<a href="/c">c</a><a href="">e</a>')],
                               "t string, h string")
    assert df.select(U.extract_urls("t", "h")).first()[0] == ["/c", "http://www.a.com", "https://b.org/x"]


def test_line_language_vote(spark):
    mails = spark.createDataFrame(
        [("m1", "the cat is in the house and it is on the mat\nle chat est dans la maison et la table\nxyz")],
        "path string, text_plain string")
    got = sorted((r["lang"], r["words"]) for r in FE.language_segments(spark, mails).collect())
    assert got == [("en", 12), ("fr", 9)]
