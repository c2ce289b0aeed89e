"""Raw-mail source queries: .eml files and zip archives written from the
stand-in rows, listed and read back by tasks and parsed (IO1, IO5, IO10-IO12,
P1-P4, P6, P8, P9, R3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions import headers as H
from mailguard.sources import files as IO
from mailguard.sources import fixtures as FX
from mailguard.sources import mime as MM
from mailguard.plans.registry import register


def corpus(spark: SparkSession, sf_dir: str, make_zip: bool = False) -> str:
    """The stand-in mails as .eml files (or zips) in the shared checkpoint
    directory.  Written once per input folder: a completion marker makes
    later queries reuse the finished corpus instead of rewriting it."""
    import hashlib
    import os

    from pyarrow import fs as pafs
    key = hashlib.sha1(f"{os.path.abspath(sf_dir)}|zip={make_zip}".encode()).hexdigest()[:16]
    root = f"{IO.checkpoint_dir(spark).rstrip('/')}/corpus-{key}"
    fs, base = MM.shared_fs(root)
    marker = f"{base}/_COMPLETE"
    if fs.get_file_info(marker).type == pafs.FileType.NotFound:
        MM.write_messages(FX.emails(spark, sf_dir), root, make_zip=make_zip)
        with fs.open_output_stream(marker) as f:
            f.write(b"ok")
    return root


def parsed_corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    root = corpus(spark, sf_dir)
    parsed = MM.parse_messages(MM.read_messages(spark, root), *columns)
    return parsed.withColumn("path", F.expr(f"substring(path, {len(root.rstrip('/')) + 1})"))


@register("eml_roundtrip_metadata", FX.duck_emails_cte() + """
SELECT path, from_email, from_email_domain, to_email,
  CASE WHEN to_email IS NULL THEN NULL ELSE lower(split_part(to_email, '@', 2)) END AS to_email_domain,
  regexp_replace(subject, '[\r\n]', ' ', 'g') AS subject, array_to_string(received, chr(10)) AS received_text,
  authentication_results, received_spf,
  dkim_signature, nullif(reply_to_domain, '') AS reply_to_domain, content_language,
  array_to_string(content_types, ' ') AS content_types_text,
  CASE WHEN list_contains(content_types, 'text/html') THEN coalesce(text_html, '') END AS text_html,
  CASE WHEN list_contains(content_types, 'text/plain') AND text_plain <> '' THEN text_plain END AS plain_part,
  CAST(NULL AS VARCHAR) AS _error
FROM emails
""", ops=("IO1", "IO5", "P2", "P3", "P4", "P12", "R3"))
def eml_roundtrip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stand-in mail written as an .eml file, listed by tasks and
    parsed back into its metadata row (errors kept per message)."""
    p = parsed_corpus(spark, sf_dir, "path", "from_email", "from_email_domain", "to_email", "to_email_domain", "subject", "received",
                      "authentication_results", "received_spf", "dkim_signature", "reply_to_domain", "content_language", "content_types",
                      "text_html", "text_plain", "_error")
    return p.select(
        "path", "from_email", "from_email_domain", "to_email", "to_email_domain", "subject",
        F.array_join("received", "\n").alias("received_text"), "authentication_results",
        "received_spf", "dkim_signature", "reply_to_domain", "content_language",
        F.array_join("content_types", " ").alias("content_types_text"), "text_html",
        F.when(F.array_contains("content_types", "text/plain") & (F.col("text_plain") != ""),
               F.col("text_plain")).alias("plain_part"), "_error")


DISPLAY_NAME = r'^\s*"?([^"<]*?)"?\s*<[^<>]*>\s*$'


@register("eml_sender_fields", FX.duck_emails_cte() + """
SELECT path, CASE WHEN from_email IS NULL THEN NULL ELSE 'Sender ' || split_part(from_email, '@', 1) END AS from_name,
  from_email AS from_addr,
  CASE WHEN from_email IS NULL THEN NULL ELSE lower(split_part(from_email, '@', 2)) END AS from_domain,
  CASE WHEN from_email IS NULL THEN NULL WHEN reply_to_domain = 'evil.example.net' THEN 'evil.example.net'
       ELSE lower(split_part(from_email, '@', 2)) END AS return_path_domain,
  from_email IS NULL AS return_path_missing,
  from_email IS NOT NULL AND coalesce(reply_to_domain, '') <> 'evil.example.net' AS return_path_match,
  to_email, lower(split_part(to_email, '@', 2)) AS to_domain,
  CASE WHEN content_types[1] = 'text/plain' THEN '' ELSE array_to_string(list_filter(content_types[2:],
       lambda x: x NOT IN ('text/plain', 'text/html')), ' ') END AS attachment_types,
  content_types[1] <> 'text/plain' AND len(list_filter(content_types[2:], lambda x: x NOT IN ('text/plain', 'text/html'))) > 0 AS has_attachment,
  split_part(path, '/', -2) AS ticket_id,
  len(list_filter(content_types, lambda x: starts_with(x, 'multipart/'))) > 0 AS is_multipart
FROM emails
""", ops=("P1", "P2", "P3", "P8", "P9", "H24", "H26"))
def eml_sender_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display name, address and domain from the raw From header, the
    Return-Path domain and whether it is the sender's, the recipient, the
    attachments, the ticket id (parent folder) and the multipart flag."""
    p = parsed_corpus(spark, sf_dir, "path", "from_header", "return_path", "to_email", "to_email_domain", "attachment_types", "is_multipart")
    name = F.nullif(F.regexp_extract("from_header", DISPLAY_NAME, 1), F.lit(""))
    addr = F.coalesce(F.nullif(F.regexp_extract("from_header", r"<([^<>]*)>", 1), F.lit("")),
                      F.trim("from_header"))
    parts = F.split(addr, "@")
    dom = F.when(F.size(parts) == 2, F.nullif(F.lower(F.element_at(parts, 2)), F.lit("")))
    rp = F.regexp_replace("return_path", r"^<|>$", "")
    return p.select(
        "path", F.when(F.col("from_header").isNotNull(), F.coalesce(name, F.col("from_header")))
        .alias("from_name"), addr.alias("from_addr"), dom.alias("from_domain"),
        H.return_path_domain(rp).alias("return_path_domain"), F.col("return_path").isNull().alias("return_path_missing"),
        H.return_path_matches(rp, dom).alias("return_path_match"), "to_email", F.col("to_email_domain").alias("to_domain"),
        F.array_join("attachment_types", " ").alias("attachment_types"),
        H.has_attachment("attachment_types").alias("has_attachment"),
        F.element_at(F.split("path", "/"), -2).alias("ticket_id"), "is_multipart")


@register("eml_header_map", FX.duck_emails_cte() + """
SELECT path, regexp_replace(subject, '[\r\n]', ' ', 'g') AS subject,
  CAST(coalesce(len(received), 0) AS BIGINT) AS n_received, false AS has_dropped_headers
FROM emails
""", ops=("IO11",))
def eml_header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header map per message (X-* and IronPort-* dropped, encoded words in the
    subject decoded): subject and Received count read from the map."""
    p = parsed_corpus(spark, sf_dir, "path", "headers")
    keys = F.map_keys("headers")
    return p.select(
        "path", F.coalesce(F.get(F.col("headers")["Subject"], 0), F.lit("")).alias("subject"),
        F.coalesce(F.size(F.col("headers")["Received"]), F.lit(0)).cast("long").alias("n_received"),
        F.exists(keys, lambda k: F.lower(k).startswith("x-") | F.lower(k).startswith("ironport-"))
        .alias("has_dropped_headers"))


@register("eml_text_parts", FX.duck_emails_cte() + """
SELECT path, CAST(len(list_filter(content_types, lambda x: x IN ('text/plain', 'text/html'))) AS BIGINT) AS n_text_parts,
  array_to_string(list_filter(content_types, lambda x: x IN ('text/plain', 'text/html')), ' ') AS text_part_types
FROM emails
""", ops=("IO12",))
def eml_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded (base64) text parts of every message: count and types."""
    p = parsed_corpus(spark, sf_dir, "path", "parts")
    return p.select("path", F.size("parts").cast("long").alias("n_text_parts"),
                    F.array_join(F.transform("parts", lambda x: x["content_type"]), " ")
                    .alias("text_part_types"))


@register("zip_archive_members", FX.duck_emails_cte() + """
SELECT regexp_replace(path, '[.]eml$', '.zip') || '!0_message.eml' AS member, from_email FROM emails
""", ops=("IO10",))
def zip_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip archives (one .eml and one .txt each) exploded to their .eml
    members, parsed; the .txt members are skipped."""
    root = corpus(spark, sf_dir, make_zip=True)
    members = MM.read_zip_members(spark, root)
    parsed = MM.parse_messages(members, "path", "from_email")
    return parsed.select(F.expr(f"substring(path, {len(root.rstrip('/')) + 1})").alias("member"),
                         "from_email")
