"""The ``emails`` stand-in view and its lookup tables (see FIXTURES.md).

The driver's tables hold no mail, so one metadata row per ``documents`` row is
derived here with the schema the e-mail operators expect.  The view only
supplies inputs; every feature, join and aggregate on top of it is computed by
the library.  The same SQL text is rendered for Spark (``array(``) and for
DuckDB (``list_value(``) so oracle queries can inline it as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.sources.tables import read_table

# {documents}, {labels}, {pages} are DataFrame placeholders for spark.sql
# (bare table names in DuckDB); ARR( is the only dialect token.
EMAILS_SQL = r"""
WITH b AS (
  SELECT d.doc_id AS k, d.text, d.lang, p.html,
         coalesce(l.toxic, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END) AS mal,
         CAST(d.doc_id AS STRING) AS ks,
         'user' || CAST(d.doc_id % 50 AS STRING) AS usr,
         'dom'  || CAST(d.doc_id % 20 AS STRING) || '.example.com' AS dom
  FROM {documents} d
  LEFT JOIN {labels} l ON l.doc_id = d.doc_id
  LEFT JOIN {pages}  p ON p.page_id = d.doc_id),
f AS (
  SELECT *, CASE WHEN mal = 1 THEN CASE k % 10
      WHEN 0 THEN 'CEO_Fraud_-_Gift_Cards'     WHEN 1 THEN 'CEO_Fraud_-_Payroll_Update'
      WHEN 2 THEN 'CEO_Fraud_-_Wire_Transfers' WHEN 3 THEN 'Phishing_-_3rd_Party'
      WHEN 4 THEN 'Phishing_-_Outbound'        WHEN 5 THEN 'Phishing_–_UBC'
      WHEN 6 THEN 'Phishing_UBC_-_Outbound'    WHEN 7 THEN 'Self-Phishing'
      WHEN 8 THEN 'Spearphishing'              ELSE 'Reply_Chain_Attack' END
    ELSE CASE k % 4
      WHEN 0 THEN 'Legitimate_Email_Confirmed' WHEN 1 THEN 'Spam_-_False_Positives'
      WHEN 2 THEN 'Spam_–_Inbound'             ELSE 'Spam_–_Outbound' END END AS folder
  FROM b)
SELECT
  '/data/dataset/' || folder || '/' || ks || '/0_message.eml' AS path,
  folder,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN upper(usr) || '@' || dom ELSE usr || '@' || dom END AS from_email,
  CASE WHEN k % 13 = 0 THEN NULL ELSE dom END AS from_email_domain,
  CASE WHEN k % 11 = 0 AND k % 13 <> 0 THEN usr || '@' || dom WHEN k % 17 = 0 THEN NULL
       ELSE 'staff' || CAST(k % 30 AS STRING) || '@ubc.ca' END AS to_email,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 7 = 0 THEN 'Visit www.site' || CAST(k % 10 AS STRING) || '.com now'
       WHEN k % 8 = 0 THEN 'RE: invoice example' || CAST(k % 10 AS STRING) || '.org/pay' ELSE left(text, 40) END AS subject,
  CASE k % 6
    WHEN 0 THEN NULL
    WHEN 1 THEN ARR('from a.ubc.ca ([10.1.2.3]) by b.ubc.ca', 'from mx.' || dom || ' ([93.184.216.' || CAST(k % 250 AS STRING) || ']) by c.mail-relay.ubc.ca', 'from localhost (127.0.0.1) by mx.' || dom)
    WHEN 2 THEN ARR('from mx.' || dom || ' (unknown [203.0.113.9]) by in.example.org', 'from a.ubc.ca by b.ubc.ca', 'from pc ([192.168.0.' || CAST(k % 250 AS STRING) || ']) by mx.' || dom)
    WHEN 3 THEN ARR('from A.UBC.CA ([172.20.0.1]) by b.ubc.ca', 'from x ([999.1.1.1]) by y')
    WHEN 4 THEN ARR('from srv (HELO mail.' || dom || ') ([100.64.0.7]) by z', 'by q with mapi id 15')
    ELSE ARR('from v6 ([2001:db8::1]) by w.example.org', 'from fe ([fe80:0:0::2]) by w.example.org') END AS received,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'mx.ubc.ca; dkim=Pass header.d=' || dom || '; spf=pass; dmarc=pass'
    WHEN 2 THEN 'mx.ubc.ca; spf=fail; DMARC=Fail' ELSE 'mx.ubc.ca; dkim = fail; dkim=temperror; dmarc=none' END AS authentication_results,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Pass (mx: domain of x) client-ip=1.2.3.4; envelope-from="' || usr || '@' || upper(dom) || '"; helo=h'
    WHEN 2 THEN 'softfail (mx) envelope-from=' || usr || '@other.example.net' WHEN 3 THEN '(none) no result' ELSE 'none' END AS received_spf,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'v=1; a=rsa-sha256; c=relaxed/relaxed; d=' || upper(dom) || '; s=s1; bh=abc=' ELSE 'v=1; id=foo.bar; d=' || dom || ';' END AS dkim_signature,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN dom WHEN 2 THEN 'evil.example.net' ELSE '' END AS reply_to_domain,
  CASE WHEN k % 10 = 0 THEN NULL WHEN lang = 'en' THEN 'en-US' ELSE lang END AS content_language,
  CASE WHEN k % 29 = 0 THEN ARR('text/plain') WHEN k % 4 = 0 THEN ARR('multipart/mixed', 'text/plain', 'application/pdf')
       WHEN k % 4 = 1 THEN ARR('multipart/related', 'text/html', 'image/png', 'video/mp4') ELSE ARR('multipart/alternative', 'text/plain', 'text/html') END AS content_types,
  CASE WHEN k % 29 = 0 THEN '' WHEN k % 17 = 0 THEN '[CAUTION: Non-UBC Email]  ' || text ELSE text END AS text_plain,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 23 = 0 THEN '<div hidden><p style="display:none">x</div>' ELSE html END AS text_html,
  mal
FROM f
"""

DOMAIN_NS_SQL = r"""
SELECT DISTINCT from_email_domain AS domain,
  CASE CAST(length(from_email_domain) AS INT) % 2 WHEN 0 THEN ARR('ns1.host-a.net', 'ns2.host-a.net') ELSE ARR('ns2.host-a.net', 'ns1.host-a.net') END AS name_servers
FROM {emails} WHERE from_email_domain IS NOT NULL AND from_email_domain <> 'dom7.example.com'
"""

GRAMMAR_MATCHES_SQL = r"""
SELECT path, CAST(length(text_plain) % 23 AS INT) AS n_matches FROM {emails} WHERE length(text_plain) % 6 <> 0
"""

LANG_SEGMENTS_SQL = r"""
SELECT path, 'en' AS lang, CAST(length(text_plain) % 40 AS INT) AS words FROM {emails}
UNION ALL SELECT path, 'fr', CAST(length(text_plain) % 15 AS INT) FROM {emails}
UNION ALL SELECT path, 'de', CAST((length(text_plain) * 3) % 25 AS INT) FROM {emails}
"""

SCORES_SQL = r"""
SELECT path, CASE WHEN mal = 1 THEN 'malicious' ELSE 'benign' END AS target_1,
  ((length(text_plain) * 37 + mal * 11) % 101) / CAST(100 AS DOUBLE) AS p_malicious FROM {emails}
"""

LEGACY_SCORES_SQL = r"""
SELECT path, CASE WHEN mal = 1 THEN 'malicious' ELSE 'benign' END AS label,
  CAST(length(text_plain) % 4 AS INT) AS ceo_fraud, CAST(length(text_plain) % 3 AS INT) AS legitimate,
  CAST(length(text_plain) % 5 AS INT) AS phishing, CAST(length(text_plain) % 2 AS INT) AS spam FROM {emails}
"""


def _render(sql: str, dialect: str, **tables: str) -> str:
    arr = "array(" if dialect == "spark" else "list_value("
    out = sql.replace("ARR(", arr)
    for name, ref in tables.items():
        out = out.replace("{" + name + "}", ref)
    return out


def duck_emails_cte(*extra: str) -> str:
    """``WITH emails AS (...)[, name AS (...)]`` prefix for oracle SQL.

    ``extra`` names lookups to add: domain_ns, grammar_matches, lang_segments,
    scores, legacy_scores.
    """
    parts = ["emails AS (" + _render(EMAILS_SQL, "duckdb", documents="documents",
                                      labels="labels", pages="pages") + ")"]
    lookup = {"domain_ns": DOMAIN_NS_SQL, "grammar_matches": GRAMMAR_MATCHES_SQL,
              "lang_segments": LANG_SEGMENTS_SQL, "scores": SCORES_SQL,
              "legacy_scores": LEGACY_SCORES_SQL}
    for name in extra:
        parts.append(f"{name} AS (" + _render(lookup[name], "duckdb", emails="emails") + ")")
    return "WITH " + ",\n".join(parts) + "\n"


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata-shaped row per document (FIXTURES.md section 3)."""
    sql = _render(EMAILS_SQL, "spark", documents="{documents}", labels="{labels}",
                  pages="{pages}")
    return spark.sql(sql, documents=read_table(spark, sf_dir, "documents"),
                     labels=read_table(spark, sf_dir, "labels"),
                     pages=read_table(spark, sf_dir, "pages"))


def _lookup(spark: SparkSession, sql: str, mails: DataFrame) -> DataFrame:
    return spark.sql(_render(sql, "spark", emails="{emails}"), emails=mails)


def domain_ns(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """(domain, name_servers) dimension standing in for WHOIS answers."""
    return _lookup(spark, DOMAIN_NS_SQL, mails)


def grammar_matches(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """(path, n_matches) standing in for grammar-checker answers."""
    return _lookup(spark, GRAMMAR_MATCHES_SQL, mails)


def lang_segments(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """(path, lang, words) standing in for language-detector segments.

    Same rows as ``LANG_SEGMENTS_SQL`` (the DuckDB form), produced in one pass
    over the mails with ``explode`` instead of a three-branch union."""
    n = F.length("text_plain")
    segs = F.array(
        F.struct(F.lit("en").alias("lang"), (n % 40).cast("int").alias("words")),
        F.struct(F.lit("fr").alias("lang"), (n % 15).cast("int").alias("words")),
        F.struct(F.lit("de").alias("lang"), ((n * 3) % 25).cast("int").alias("words")))
    return mails.select("path", F.explode(segs).alias("s")).select("path", "s.lang", "s.words")


def scores(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """(path, target_1, p_malicious) classifier output for metric jobs."""
    return _lookup(spark, SCORES_SQL, mails)


def legacy_scores(spark: SparkSession, mails: DataFrame) -> DataFrame:
    """(path, label, four class scores) of the legacy scorer."""
    return _lookup(spark, LEGACY_SCORES_SQL, mails)
