"""Queries over the e-mail feature plan (R1 and the H*/C* expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions import content as C
from mailguard.functions import headers as H
from mailguard.functions import netmath as N
from mailguard.operators import features as FE
from mailguard.plans import duck as D
from mailguard.plans.registry import register
from mailguard.sources import fixtures as FX
from mailguard.sources.tables import read_table


def features_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = FX.emails(spark, sf_dir)
    return FE.email_features(spark, mails, FX.domain_ns(spark, mails),
                             FX.grammar_matches(spark, mails), FX.lang_segments(spark, mails))


# -- DuckDB rendering of the metadata + feature plan ------------------------

def _duck_meta_ctes() -> str:
    folder = f"regexp_extract(e.path, {D.q('^/data/dataset/([^/]+)/')}, 1)"
    tc, mm, oth = D.content_counts("content_types")
    return f""",
meta AS (
  SELECT e.*, {D.text_clean('e.text_plain')} AS text_clean,
         {D.hyperlinks('e.text_html')} AS text_hyperlinks,
         lm.target_1, lm.target_2, lm.target_3
  FROM emails e LEFT JOIN {D.label_map_values()} ON {folder} = lm.folder
  WHERE lm.target_3 IS DISTINCT FROM 'self_phishing'),
staged AS (
  SELECT *, {D.routing('received')} AS _routing,
         {D.received_domain(D.first_server_transfer('received'))} AS _hop_domain,
         CAST({tc} AS BIGINT) AS _tc, CAST({mm} AS BIGINT) AS _mm, CAST({oth} AS BIGINT) AS _oth,
         CAST({D.word_count('text_clean')} AS BIGINT) AS word_count
  FROM meta)
"""


def _duck_features_select() -> str:
    return f"""
SELECT s.path,
  coalesce(s.subject, '') AS subject,
  {D.url_in_subject('s.subject')} AS url_present_in_subject,
  CAST(len(s._routing) AS BIGINT) AS routing_length_before_ubc,
  {D.has_dmarc_authentication('s.authentication_results')} AS dmarc_authentication_present,
  {D.dkim_match('s.dkim_signature', 's.from_email_domain')} AS dkim_sender_domains_match,
  {D.to_from_match('s.from_email', 's.to_email')} AS to_from_addresses_match,
  {D.spf_match('s.received_spf', 's.from_email')} AS sender_email_spf_match,
  {D.different_reply('s.from_email_domain', 's.reply_to_domain')} AS different_reply_domains,
  CAST({D.internal_count('s._routing')} AS BIGINT) AS internal_server_transfer_count,
  {D.name_servers_match('nh.name_servers', 'nf.name_servers')} AS name_server_match,
  {D.auth_word('s.authentication_results', 'dkim')} AS dkim_result,
  {D.spf_result('s.received_spf')} AS spf_result,
  {D.auth_word('s.authentication_results', 'dmarc')} AS dmarc_result,
  s.text_clean, s.word_count,
  {D.readable('s.text_clean', 's.text_html')} AS readable_proportion,
  {D.whitespace_ratio('s.text_plain')} AS whitespace_ratio,
  {D.alphabet_proportion('s.text_clean')} AS alphabet_proportion,
  {D.grammar_rate('s.text_plain', 's.content_language', 'g.n')} AS grammar_error_rate,
  coalesce(ls.share, 0.0) AS english_french_proportion,
  s._tc AS text_content_count, s._mm AS multimedia_content_count, s._oth AS others_content_count,
  {D.hyperlink_prop('s.text_hyperlinks', 's.word_count')} AS hyperlink_proportion,
  {D.non_ascii('s.text_clean')} AS non_ascii_present,
  {D.hidden_text('s.text_html')} AS hidden_text_present,
  (s.text_clean = '' AND s._mm = 0 AND s._oth = 0 AND len(s.text_hyperlinks) = 0) AS empty_body,
  CAST({D.html_parsing_error('s.text_html')} AS BIGINT) AS html_parsing_error,
  CASE WHEN (s.text_clean = '' AND s._mm = 0 AND s._oth = 0 AND len(s.text_hyperlinks) = 0)
       THEN 'malicious' ELSE s.target_1 END AS target_1,
  s.target_2, s.target_3
FROM staged s
LEFT JOIN (SELECT path, sum(n_matches) AS n FROM grammar_matches GROUP BY path) g ON g.path = s.path
LEFT JOIN (
  SELECT path, sum(CASE WHEN lang IN ('en', 'fr') THEN words ELSE 0 END) / sum(words) AS share
  FROM (SELECT path, lower(lang) AS lang, sum(words) AS words FROM lang_segments
        WHERE words > 5 GROUP BY path, lower(lang) HAVING sum(words) > 10) t
  GROUP BY path) ls ON ls.path = s.path
LEFT JOIN domain_ns nf ON nf.domain = s.from_email_domain
LEFT JOIN domain_ns nh ON nh.domain = s._hop_domain
"""


FEATURES_SQL = (FX.duck_emails_cte("domain_ns", "grammar_matches", "lang_segments")
                + _duck_meta_ctes() + _duck_features_select())

INT_FEATURES = ("routing_length_before_ubc", "internal_server_transfer_count", "word_count",
                "text_content_count", "multimedia_content_count", "others_content_count",
                "html_parsing_error")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in INT_FEATURES else F.col(c)
                       for c in df.columns])


@register("email_features", FEATURES_SQL,
          ops=("R1", "IO2", "J1", "F1", "D6", "P5", "P7", "P12", "H2", "H3", "H4", "H5", "H7",
               "H8", "H9", "H10", "H11", "H12", "H13", "H14", "H17", "H18", "H19", "H20",
               "H21", "H22", "H23", "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9",
               "C11", "C12", "C13", "J2"))
def email_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28-feature table with targets, one row per non-self-phishing mail."""
    return _longs(features_df(spark, sf_dir))


DMARC_SUMMARY_SQL = (FX.duck_emails_cte("domain_ns", "grammar_matches", "lang_segments")
                     + _duck_meta_ctes() + ", feats AS (" + _duck_features_select() + ")\n" + """
SELECT dmarc_result, target_1, count(*) AS mails,
       round(avg(word_count), 6) AS mean_words,
       round(avg(CASE WHEN dkim_sender_domains_match THEN 1.0 ELSE 0.0 END), 6) AS dkim_match_share
FROM feats GROUP BY dmarc_result, target_1
""")


def dmarc_summary(feats: DataFrame) -> DataFrame:
    """Per DMARC result x class: mail count, mean word count, DKIM-match share."""
    return (feats.groupBy("dmarc_result", "target_1")
            .agg(F.count(F.lit(1)).alias("mails"),
                 F.round(F.avg("word_count"), 6).alias("mean_words"),
                 F.round(F.avg(F.col("dkim_sender_domains_match").cast("double")), 6)
                 .alias("dkim_match_share")))


@register("dmarc_target_summary", DMARC_SUMMARY_SQL, ops=("R1", "H5", "H8", "C4", "A1"))
def dmarc_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per dmarc_result x target_1, mails, mean words, DKIM-match share."""
    return dmarc_summary(features_df(spark, sf_dir))


# -- per-family queries over the metadata table --------------------------------

def meta_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.build_metadata(spark, FX.emails(spark, sf_dir))


META_SQL = FX.duck_emails_cte() + _duck_meta_ctes()


@register("header_auth_features", META_SQL + f"""
SELECT path,
  from_email IS NOT NULL AS has_from,
  authentication_results IS NOT NULL AS has_auth_results,
  {D.has_dmarc_authentication('authentication_results')} AS dmarc_authentication_present,
  {D.auth_word('authentication_results', 'dkim')} AS dkim_result,
  {D.spf_result('received_spf')} AS spf_result,
  {D.auth_word('authentication_results', 'dmarc')} AS dmarc_result,
  {D.auth_method_result('authentication_results', 'spf')} AS auth_spf,
  {D.auth_method_result('authentication_results', 'dkim')} AS auth_dkim,
  {D.auth_method_result('authentication_results', 'dmarc')} AS auth_dmarc,
  {D.dkim_domain('dkim_signature')} AS dkim_domain,
  {D.dkim_match('dkim_signature', 'from_email_domain')} AS dkim_sender_domains_match,
  {D.to_from_match('from_email', 'to_email')} AS to_from_addresses_match,
  {D.spf_email('received_spf')} AS spf_email,
  {D.spf_match('received_spf', 'from_email')} AS sender_email_spf_match,
  {D.different_reply('from_email_domain', 'reply_to_domain')} AS different_reply_domains
FROM staged
""", ops=("H1", "H2", "H3", "H4", "H5", "H6", "H7", "H8", "H9", "H10", "H11", "H12"))
def header_auth_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication and sender-consistency header features per mail."""
    m = meta_df(spark, sf_dir)
    return m.select(
        "path",
        H.has_header_value("from_email").alias("has_from"),
        H.has_header_value("authentication_results").alias("has_auth_results"),
        H.has_dmarc_authentication("authentication_results").alias("dmarc_authentication_present"),
        H.get_dkim_result("authentication_results").alias("dkim_result"),
        H.get_spf_result("received_spf").alias("spf_result"),
        H.get_dmarc_result("authentication_results").alias("dmarc_result"),
        H.auth_method_result("authentication_results", "spf").alias("auth_spf"),
        H.auth_method_result("authentication_results", "dkim").alias("auth_dkim"),
        H.auth_method_result("authentication_results", "dmarc").alias("auth_dmarc"),
        H.extract_dkim_domain("dkim_signature").alias("dkim_domain"),
        H.dkim_domain_matches_sender("dkim_signature", "from_email_domain").alias("dkim_sender_domains_match"),
        H.to_from_match("from_email", "to_email").alias("to_from_addresses_match"),
        H.extract_spf_email("received_spf").alias("spf_email"),
        H.spf_email_matches_sender("received_spf", "from_email").alias("sender_email_spf_match"),
        H.check_different_reply_domain("from_email_domain", "reply_to_domain").alias("different_reply_domains"),
    )


@register("received_routing", META_SQL + f""",
hop AS (SELECT *, {D.first_server_transfer('received')} AS first_hop FROM staged),
hop2 AS (SELECT *, {D.received_ip('first_hop')} AS first_hop_ip FROM hop)
SELECT path, first_hop,
  {D.received_domain('first_hop')} AS first_hop_domain,
  first_hop_ip,
  {D.ip_is_private('first_hop_ip')} AS first_hop_ip_private,
  {D.from_org('received[1]')} AS first_header_from_org,
  CAST(len(_routing) AS BIGINT) AS routing_length_before_ubc,
  CAST({D.internal_count('_routing')} AS BIGINT) AS internal_server_transfer_count,
  CAST(coalesce(len(received), 0) AS BIGINT) AS number_of_received,
  array_to_string(received, chr(10)) AS received_text
FROM hop2
""", ops=("H13", "H14", "H15", "H16", "H19", "H20", "H21", "H22", "H25", "P10"))
def received_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing features from the Received list per mail."""
    m = (meta_df(spark, sf_dir)
         .withColumn("first_hop", H.extract_first_server_transfer("received"))
         .withColumn("_routing", H.routing_before_org("received"))
         .withColumn("first_hop_ip", H.extract_ip_from_received_header("first_hop"))
         .withColumn("_first_header", F.get("received", 0)))
    return m.select(
        "path", "first_hop",
        H.extract_domain_from_received_header("first_hop").alias("first_hop_domain"),
        "first_hop_ip",
        N.ip_is_private("first_hop_ip").alias("first_hop_ip_private"),
        H.check_email_from_org("_first_header").alias("first_header_from_org"),
        F.size("_routing").cast("long").alias("routing_length_before_ubc"),
        H.internal_server_transfer_count("_routing").cast("long").alias("internal_server_transfer_count"),
        H.number_of_received("received").cast("long").alias("number_of_received"),
        F.array_join("received", "\n").alias("received_text"),
    )


@register("ip_address_classes", FX.duck_emails_cte() + f""",
ips AS (SELECT DISTINCT {D.received_ip('h')} AS ip FROM (SELECT unnest(received) AS h FROM emails) t)
SELECT ip, {D.ipv4_to_long('ip')} AS ipv4_value, {D.ipv6_to_hex('ip')} AS ipv6_hex,
  {D.ip_is_private('ip')} AS is_private,
  CASE WHEN {D.ipv4_to_long('ip')} IS NOT NULL THEN {D.ipv4_is_global('ip')}
       WHEN {D.ipv6_to_hex('ip')} IS NOT NULL THEN NOT {D.v6_is_private(D.ipv6_to_hex('ip'))} END AS is_global
FROM ips WHERE ip IS NOT NULL
""", ops=("H15", "H22"))
def ip_address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct IPs named in Received headers with their address class."""
    hdr = FX.emails(spark, sf_dir).select(F.explode("received").alias("h"))
    ips = (hdr.select(H.extract_ip_from_received_header("h").alias("ip"))
           .filter(F.col("ip").isNotNull()).distinct())
    return ips.select("ip", N.ipv4_to_long("ip").alias("ipv4_value"),
                      N.ipv6_to_hex("ip").alias("ipv6_hex"),
                      N.ip_is_private("ip").alias("is_private"),
                      N.ip_is_global("ip").alias("is_global"))


@register("content_features", META_SQL + f"""
SELECT path, text_clean,
  array_to_string(text_hyperlinks, ' ') AS hyperlinks_text,
  CAST(len(text_hyperlinks) AS BIGINT) AS n_hyperlinks,
  {D.non_ascii('text_clean')} AS non_ascii_present,
  {D.hidden_text('text_html')} AS hidden_text_present,
  CAST({D.html_parsing_error('text_html')} AS BIGINT) AS html_parsing_error,
  word_count,
  {D.readable('text_clean', 'text_html')} AS readable_proportion,
  {D.whitespace_ratio('text_plain')} AS whitespace_ratio,
  {D.alphabet_proportion('text_clean')} AS alphabet_proportion,
  _tc AS text_content_count, _mm AS multimedia_content_count, _oth AS others_content_count,
  (text_clean = '' AND _mm = 0 AND _oth = 0 AND len(text_hyperlinks) = 0) AS empty_body,
  {D.hyperlink_prop('text_hyperlinks', 'word_count')} AS hyperlink_proportion,
  {D.has_pdf('content_types')} AS has_pdf,
  coalesce(len(list_filter(content_types, lambda x: x[1:5] <> 'text/' AND x[1:10] <> 'multipart/')) > 0, false) AS has_attachment,
  coalesce(subject, '') AS subject_or_empty,
  {D.url_in_subject('subject')} AS url_present_in_subject,
  array_to_string(content_types, ' ') AS content_types_text
FROM staged
""", ops=("P5", "P7", "P11", "P12", "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C11", "C12",
          "C13", "C14", "H23", "H24"))
def content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and content features per mail."""
    m = (meta_df(spark, sf_dir).withColumn("_cc", C.content_count("content_types"))
         .withColumn("word_count", C.word_count("text_clean").cast("long")))
    return m.select(
        "path", "text_clean",
        F.array_join("text_hyperlinks", " ").alias("hyperlinks_text"),
        F.size("text_hyperlinks").cast("long").alias("n_hyperlinks"),
        C.non_ascii_present("text_clean").alias("non_ascii_present"),
        C.hidden_text_present("text_html").alias("hidden_text_present"),
        C.html_parsing_error("text_html").cast("long").alias("html_parsing_error"),
        "word_count",
        C.readable_proportion("text_clean", "text_html").alias("readable_proportion"),
        C.whitespace_ratio("text_plain").alias("whitespace_ratio"),
        C.alphabet_proportion("text_clean").alias("alphabet_proportion"),
        F.col("_cc.text").cast("long").alias("text_content_count"),
        F.col("_cc.multimedia").cast("long").alias("multimedia_content_count"),
        F.col("_cc.others").cast("long").alias("others_content_count"),
        C.is_body_empty("text_clean", F.col("_cc.multimedia"), F.col("_cc.others"),
                        "text_hyperlinks").alias("empty_body"),
        C.hyperlink_proportion("text_hyperlinks", "word_count").alias("hyperlink_proportion"),
        C.has_pdf("content_types").alias("has_pdf"),
        H.has_attachment(H.attachment_types("content_types")).alias("has_attachment"),
        C.empty_if_null("subject").alias("subject_or_empty"),
        H.url_present_in_subject("subject").alias("url_present_in_subject"),
        F.array_join("content_types", " ").alias("content_types_text"),
    )


@register("name_server_match", FX.duck_emails_cte("domain_ns") + _duck_meta_ctes() + f""",
hop AS (SELECT path, from_email_domain,
               {D.received_domain(D.first_server_transfer('received'))} AS hop_domain FROM staged)
SELECT h.path, h.hop_domain, nf.name_servers IS NOT NULL AS sender_ns_known,
  {D.name_servers_match('nh.name_servers', 'nf.name_servers')} AS name_server_match
FROM hop h LEFT JOIN domain_ns nf ON nf.domain = h.from_email_domain
LEFT JOIN domain_ns nh ON nh.domain = h.hop_domain
""", ops=("H13", "H14", "H17", "H18"))
def name_server_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name servers of sender and first-hop domains joined from the lookup table."""
    mails = FX.emails(spark, sf_dir)
    ns = FX.domain_ns(spark, mails)
    m = (FE.build_metadata(spark, mails)
         .withColumn("_hop", H.extract_first_server_transfer("received"))
         .withColumn("hop_domain", H.extract_domain_from_received_header("_hop"))
         .select("path", "from_email_domain", "hop_domain"))
    return FE.name_server_features(m, ns).select(
        "path", "hop_domain", F.col("_ns_from").isNotNull().alias("sender_ns_known"),
        "name_server_match")


@register("grammar_error_rate", FX.duck_emails_cte("grammar_matches") + _duck_meta_ctes() + f"""
SELECT s.path, g.n AS n_matches,
  {D.grammar_rate('s.text_plain', 's.content_language', 'g.n')} AS grammar_error_rate
FROM staged s LEFT JOIN (SELECT path, sum(n_matches) AS n FROM grammar_matches GROUP BY path) g
ON g.path = s.path
""", ops=("C8",))
def grammar_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammar error rate from the checker-answer table (left join on path)."""
    mails = FX.emails(spark, sf_dir)
    g = FX.grammar_matches(spark, mails).groupBy("path").agg(F.sum("n_matches").alias("n_matches"))
    m = FE.build_metadata(spark, mails).join(g, "path", "left")
    return m.select("path", "n_matches",
                    C.grammar_error_rate("text_plain", "content_language", "n_matches")
                    .alias("grammar_error_rate"))


@register("english_french_share", FX.duck_emails_cte("lang_segments") + """
SELECT e.path, coalesce(ls.share, 0.0) AS english_french_proportion
FROM emails e LEFT JOIN (
  SELECT path, sum(CASE WHEN lang IN ('en', 'fr') THEN words ELSE 0 END) / sum(words) AS share
  FROM (SELECT path, lower(lang) AS lang, sum(words) AS words FROM lang_segments
        WHERE words > 5 GROUP BY path, lower(lang) HAVING sum(words) > 10) t
  GROUP BY path) ls ON ls.path = e.path
""", ops=("C9",))
def english_french_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of English+French words per mail from language segments."""
    mails = FX.emails(spark, sf_dir)
    share = FE.lang_share(FX.lang_segments(spark, mails))
    return (mails.select("path").join(share, "path", "left")
            .select("path", F.coalesce("english_french_proportion", F.lit(0.0))
                    .alias("english_french_proportion")))


def _duck_stop_words() -> str:
    rows = ", ".join(f"({D.q(lang)}, {D.q(w)}, {FE.LANG_ORDER.index(lang)})"
                     for lang in FE.LANG_ORDER for w in FE.STOP_WORDS[lang])
    return f"(VALUES {rows}) AS sw(lang, word, priority)"


@register("language_segments_share", FX.duck_emails_cte() + f"""
, ln AS (SELECT path, generate_subscripts(string_split(coalesce(text_plain, ''), chr(10)), 1) AS line_no,
                unnest(string_split(coalesce(text_plain, ''), chr(10))) AS line FROM emails),
tk AS (SELECT path, line_no, regexp_extract_all(lower(line), '\\p{{L}}+') AS tokens FROM ln),
w AS (SELECT path, line_no, len(tokens) AS words FROM tk),
h AS (SELECT t.path, t.line_no, sw.lang, sw.priority, count(*) AS hits
      FROM (SELECT path, line_no, unnest(tokens) AS word FROM tk) t JOIN {_duck_stop_words()} ON sw.word = t.word
      GROUP BY ALL),
best AS (SELECT path, line_no, arg_min(lang, (-hits, priority)) AS lang FROM h GROUP BY path, line_no),
seg AS (SELECT b.path, b.lang, w.words FROM best b JOIN w USING (path, line_no)),
share AS (SELECT path, sum(CASE WHEN lang IN ('en', 'fr') THEN words ELSE 0 END) / sum(words) AS s
          FROM (SELECT path, lang, sum(words) AS words FROM seg WHERE words > 5 GROUP BY path, lang
                HAVING sum(words) > 10) t GROUP BY path)
SELECT e.path, coalesce(share.s, 0.0) AS english_french_proportion,
  (SELECT count(*) FROM seg WHERE seg.path = e.path) AS n_segments
FROM emails e LEFT JOIN share ON share.path = e.path
""", ops=("C10", "C9"))
def language_segments_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English+French share of every body from line segments labelled by a
    stop-word vote (the segmenter feeding C9)."""
    mails = FX.emails(spark, sf_dir)
    seg = FE.language_segments(spark, mails)
    share = FE.lang_share(seg)
    nseg = seg.groupBy("path").agg(F.count(F.lit(1)).alias("n_segments"))
    return (mails.select("path").join(share, "path", "left").join(nseg, "path", "left")
            .select("path", F.coalesce("english_french_proportion", F.lit(0.0)).alias("english_french_proportion"),
                    F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments")))


@register("html_visible_text", FX.duck_emails_cte() + f"""
SELECT path, {D.html_to_text('text_html')} AS visible_text FROM emails WHERE text_html IS NOT NULL
""", ops=("P6",))
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every HTML body (script, style and comments removed,
    tags dropped, basic entities decoded)."""
    return (FX.emails(spark, sf_dir).filter(F.col("text_html").isNotNull())
            .select("path", C.html_to_text("text_html").alias("visible_text")))


# Fixed inputs appended to the pages, by page_id modulo their number: unquoted, commented, quoted and
# upper-case links, crossed and wrongly ordered tags, and bytes that could not be decoded.
MARKUP_CASES = (
    "", "<a href=/plain?a=1&amp;b=2>x</a>", '<!-- <a href="/commented">c</a> -->', '<a title="a > b" href="/after">y</a>',
    "<b><i>z</b></i>", "</p><p>", "<A data-href='no' HREF='/single'>s</A><a name=\"href=x\">none</a>", "\ufffd",
    '<style>a > b {}</style><script>"<a href=/script>"</script>', '<br/><img src=x><a href="">empty</a>',
)


@register("markup_edge_cases", "WITH cases AS (SELECT [" + ", ".join(D.q(c) for c in MARKUP_CASES) + f"""] AS c),
p AS (SELECT page_id, CASE WHEN page_id % 37 <> 5 THEN html || c[page_id % {len(MARKUP_CASES)} + 1] END AS h FROM pages, cases)
SELECT page_id, array_to_string({D.hyperlinks('h')}, ' ') AS links, CAST({D.html_parsing_error('h')} AS BIGINT) AS html_parsing_error,
  {D.html_to_text('h')} AS visible_text FROM p
""", ops=("P6", "P7", "C3"))
def markup_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, nesting errors and visible text of the pages with awkward markup behind each."""
    case = F.get(F.array(*[F.lit(c) for c in MARKUP_CASES]), (F.col("page_id") % len(MARKUP_CASES)).cast("int"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 37 != 5, F.concat("html", case)).alias("h"))
    return pages.select("page_id", F.array_join(C.hyperlinks("h"), " ").alias("links"),
                        C.html_parsing_error("h").cast("long").alias("html_parsing_error"), C.html_to_text("h").alias("visible_text"))
