"""Golden rows for header features (reference docstrings, corrected where the
code disagrees, and the semantic traps Q6-Q11)."""

import pytest
from pyspark.sql import functions as F

from mailguard.functions import headers as H
from mailguard.functions import netmath as N


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)],
                               ", ".join(f"{n} {t}" for n, t in
                                         ((n, "array<string>" if isinstance(cols[n], list) else "string")
                                          for n in names)))
    return df.select(expr.alias("v")).first()["v"]


def test_auth_results(spark):
    a = "mx.ubc.ca; dkim=Pass header.d=x; spf=pass; DMARC=Fail"
    assert one(spark, H.get_dkim_result("a"), a=a) == "pass"
    assert one(spark, H.get_dmarc_result("a"), a=a) == "none"          # key is case-sensitive
    assert one(spark, H.has_dmarc_authentication("a"), a=a) is True    # presence ignores case
    assert one(spark, H.auth_method_result("a", "dmarc"), a=a) == "fail"
    assert one(spark, H.get_dkim_result("a"), a=None) == "none"
    assert one(spark, H.has_dmarc_authentication("a"), a=None) is False


def test_spf_result_full_word_and_non_word_start(spark):
    assert one(spark, H.get_spf_result("s"), s="SoftFail (mx) x") == "softfail"   # Q6: whole word
    assert one(spark, H.get_spf_result("s"), s="(none) no result") == "none"


def test_dkim_domain_unanchored(spark):
    # Q7: the first d= wins even inside another tag
    assert one(spark, H.extract_dkim_domain("s"), s="v=1; id=foo.bar; d=dom.com;") == "foo.bar"
    assert one(spark, H.extract_dkim_domain("s"), s="v=1; d=DOM.COM; bh=x") == "dom.com"
    assert one(spark, H.dkim_domain_matches_sender("s", "d"), s="d=DOM.com", d="dom.COM") is True
    assert one(spark, H.dkim_domain_matches_sender("s", "d"), s=None, d="dom.com") is False


def test_spf_email(spark):
    s = 'Pass client-ip=1.2.3.4; envelope-from="User@Example.COM"; helo=h'
    assert one(spark, H.extract_spf_email("s"), s=s) == "user@example.com"    # Q26: whole address
    assert one(spark, H.spf_email_matches_sender("s", "e"), s=s, e="user@example.com") is True


@pytest.mark.parametrize("frm,reply,expected", [
    (None, None, True), ("", "", True), ("a.com", None, False), ("a.com", "", False),
    ("a.com", "a.com", False), ("a.com", "b.com", True), (None, "b.com", True),
    ("a.com", "A.com", True),   # case-sensitive
])
def test_reply_domain_truth_table(spark, frm, reply, expected):
    assert one(spark, H.check_different_reply_domain("f", "r"), f=frm, r=reply) is expected


def test_to_from_match_nulls(spark):
    assert one(spark, H.to_from_match("a", "b"), a=None, b=None) is False
    assert one(spark, H.to_from_match("a", "b"), a="X@y.com", b="x@Y.com") is True


def test_routing_latch_is_case_sensitive(spark):
    r = ["from a.ubc.ca by b", "from mx.other.com by c", "from z.ubc.ca by d"]
    assert one(spark, H.routing_before_org("r"), r=r) == r[1:]            # Q10: later org kept
    assert one(spark, H.routing_before_org("r"), r=["from A.UBC.CA by b"]) == ["from A.UBC.CA by b"]
    nulls = spark.createDataFrame([(None,)], "r array<string>")
    assert nulls.select(H.routing_before_org("r")).first()[0] == []
    assert one(spark, H.routing_length_before_org("r"), r=["from a.ubc.ca by b"]) == 0


def test_first_server_transfer_priorities(spark):
    r = ["from a by b with mapi id 1", "from x ([8.8.8.8]) by y", "from p ([10.0.0.1]) by q"]
    # oldest first: the private hop is no match, the global IPv4 hop is
    assert one(spark, H.extract_first_server_transfer("r"), r=r) == r[1]
    r2 = ["from x ([999.1.1.1]) by y"]                                    # Q9: invalid quad -> not global
    assert one(spark, H.extract_first_server_transfer("r"), r=r2) == r2[0]   # second, looser pass
    assert one(spark, H.extract_first_server_transfer("r"), r=["from localhost by x"]) is None


def test_received_domain_and_ip(spark):
    assert one(spark, H.extract_domain_from_received_header("h"),
               h="from mail.example.com (unknown [1.2.3.4]) by x") == "mail.example.com"
    assert one(spark, H.extract_domain_from_received_header("h"),
               h="from srv (HELO mail.dom.org) ([1.2.3.4]) by z") == "mail.dom.org"
    assert one(spark, H.extract_ip_from_received_header("h"), h="from a ([1.2.3.4]) by b") == "1.2.3.4"
    assert one(spark, H.extract_ip_from_received_header("h"), h="from v6 ([2001:db8::1]) by w") == "2001:db8::1"
    assert one(spark, H.extract_ip_from_received_header("h"), h="from a (b) by c") is None


@pytest.mark.parametrize("ip,private,is_global", [
    ("10.1.2.3", True, False), ("172.16.0.1", True, False), ("192.168.1.1", True, False),
    ("127.0.0.1", True, False), ("169.254.1.1", True, False), ("100.64.0.7", False, False),
    ("192.0.2.1", True, False), ("198.18.0.1", True, False), ("198.51.100.1", True, False),
    ("203.0.113.9", True, False), ("240.0.0.1", True, False), ("8.8.8.8", False, True),
    ("999.1.1.1", None, None), ("010.1.1.1", None, None), ("::1", True, False),
    ("fc00::1", True, False), ("fe80::1", True, False), ("2001:db8::1", True, False),
    ("2606:4700::1", False, True), ("fe80:0:0::2", True, False), ("::ffff:808:808", False, True),
])
def test_ip_classes_follow_python_ipaddress(spark, ip, private, is_global):
    import ipaddress
    assert one(spark, N.ip_is_private("ip"), ip=ip) is private
    assert one(spark, N.ip_is_global("ip"), ip=ip) is is_global
    try:
        a = ipaddress.ip_address(ip)
        assert a.is_private is private and a.is_global is is_global
    except ValueError:
        assert private is None


def test_internal_transfer_count(spark):
    r = ["from a ([10.0.0.1]) by b", "from c ([8.8.8.8]) by d", "from e ([203.0.113.5]) by f"]
    assert one(spark, H.internal_server_transfer_count("r"), r=r) == 2     # Q11: 203.0.113/24 counts


def test_subject_url(spark):
    assert one(spark, H.url_present_in_subject("s"), s="Visit www.site.com now") is True
    assert one(spark, H.url_present_in_subject("s"), s="RE: invoice example.org/pay") is True
    assert one(spark, H.url_present_in_subject("s"), s="hello there") is False
    assert one(spark, H.url_present_in_subject("s"), s=None) is False
