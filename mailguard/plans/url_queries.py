"""URL feature queries (U1-U10) over the mail bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions import urls as U
from mailguard.plans import duck as D
from mailguard.plans.registry import register
from mailguard.sources import fixtures as FX


def d_with_scheme(u: str) -> str:
    return f"(CASE WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') THEN {u} ELSE 'http://' || {u} END)"


def d_auth(u: str) -> str:
    return f"regexp_extract({d_with_scheme(u)}, {D.q(U.AUTHORITY)}, 1)"


D_URLS = (f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text_plain, ''), {D.q(U.TEXT_URL)}, 1), "
          f"lambda u: {d_with_scheme('u')}) || list_filter({D.hyperlinks('text_html')}, lambda h: h <> '')))")

URLS_SQL = FX.duck_emails_cte() + f", u AS (SELECT path, {D_URLS} AS urls FROM emails)\n"


def urls_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.emails(spark, sf_dir).select("path", U.extract_urls("text_plain", "text_html").alias("urls"))


@register("url_features", URLS_SQL + f"""
SELECT path, array_to_string(urls, ' ') AS urls_text, CAST(len(urls) AS BIGINT) AS url_count,
  len(list_filter(urls, lambda u: regexp_matches({d_with_scheme('u')}, {D.q(U.IP_URL)}))) > 0 AS ip_addr_urls,
  len(list_filter(urls, lambda u: starts_with(u, 'http://'))) > 0 AS http_urls_present,
  len(list_filter(urls, lambda u: contains(u, '@'))) > 0 AS url_at_symbol,
  len(list_filter(urls, lambda u: regexp_matches(string_split({d_auth('u')}, '@')[-1], ':[0-9]+$'))) > 0 AS url_port_number,
  len(list_filter(urls, lambda u: length(u) > 75)) > 0 AS any_long_urls,
  len(list_filter(urls, lambda u: regexp_matches(u, {D.q(U.NOT_WS)}) AND len(string_split({d_auth('u')}, '.')) > 3)) > 0
    AS url_multiple_subdomains
FROM u
""", ops=("U1", "U2", "U5", "U6", "U7", "U8", "U9", "U10", "P7"))
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of every mail (text and HTML links) with the prototype URL flags."""
    u = urls_df(spark, sf_dir)
    return u.select(
        "path", F.array_join("urls", " ").alias("urls_text"), U.url_count("urls").cast("long").alias("url_count"),
        U.has_ip_url("urls").alias("ip_addr_urls"), U.has_http_only("urls").alias("http_urls_present"),
        U.has_at_symbol("urls").alias("url_at_symbol"), U.has_port_number("urls").alias("url_port_number"),
        U.has_long_url("urls").alias("any_long_urls"),
        U.has_multiple_subdomains("urls").alias("url_multiple_subdomains"))


# Stand-in for HTTP probe answers (FIXTURES.md): one row per distinct URL.
PROBE_SQL = """SELECT url, CASE length(url) % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status,
  CASE length(url) % 2 WHEN 0 THEN url || '/' ELSE url || 'x' END AS final_url FROM {urls}"""


@register("url_probe_features", URLS_SQL + f"""
, du AS (SELECT DISTINCT unnest(urls) AS url FROM u),
probe AS ({PROBE_SQL.format(urls='du')}),
x AS (SELECT path, unnest(urls) AS url FROM u),
j AS (SELECT x.path, p.status, p.final_url, x.url FROM x LEFT JOIN probe p ON p.url = x.url)
SELECT u.path, coalesce(bool_or(j.status = 200), false) AS all_urls_accessible,
  coalesce(bool_or(j.status IS NOT NULL AND regexp_replace(lower(j.final_url), '/+$', '')
       <> regexp_replace(lower({d_with_scheme('j.url')}), '/+$', '')), false) AS urls_redirected
FROM u LEFT JOIN j ON j.path = u.path GROUP BY u.path
""", ops=("U3", "U4", "U1"))
def url_probe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any reachable URL (status 200) and any redirected URL per mail, from a
    probe-answer table joined on the distinct URLs."""
    u = urls_df(spark, sf_dir)
    x = u.select("path", F.explode("urls").alias("url"))
    probe = spark.sql(PROBE_SQL.format(urls="{urls}"), urls=x.select("url").distinct())
    j = x.join(probe, "url", "left")
    flags = j.groupBy("path").agg(
        F.bool_or(F.col("status") == 200).alias("acc"),
        F.bool_or(F.col("status").isNotNull()
                  & (U.normalized(F.col("final_url")) != U.normalized(U.with_scheme(F.col("url"))))).alias("red"))
    return (u.select("path").join(flags, "path", "left")
            .select("path", F.coalesce("acc", F.lit(False)).alias("all_urls_accessible"),
                    F.coalesce("red", F.lit(False)).alias("urls_redirected")))
