"""Metadata and feature jobs.

The whole feature plan is one lazy DataFrame: native expressions for the
per-message features, then equi-joins with the lookup tables that stand in
for the reference's network calls (WHOIS, grammar checker, language
detector).  Lookups keyed by path are aggregated to one row per path before
the join so the join cannot multiply mails; the domain dimension is joined on
the domain key, and AQE turns it into a broadcast only when its measured size
is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions import content as C
from mailguard.functions import headers as H

# Corpus folder -> (target_3, target_2, target_1).
LABEL_MAP = [
    ("CEO_Fraud_-_Gift_Cards", "gift_cards", "ceo_fraud", "malicious"),
    ("CEO_Fraud_-_Payroll_Update", "payroll_update", "ceo_fraud", "malicious"),
    ("CEO_Fraud_-_Wire_Transfers", "wire_transfers", "ceo_fraud", "malicious"),
    ("Phishing_-_3rd_Party", "third_party", "phishing", "malicious"),
    ("Phishing_-_Outbound", "outbound", "phishing", "malicious"),
    ("Phishing_–_UBC", "ubc", "phishing", "malicious"),
    ("Phishing_UBC_-_Outbound", "ubc_outbound", "phishing", "malicious"),
    ("Self-Phishing", "self_phishing", "phishing", "malicious"),
    ("Spearphishing", "spearphishing", "phishing", "malicious"),
    ("Reply_Chain_Attack", "reply-chain-attack", "reply-chain-attack", "malicious"),
    ("Legitimate_Email_Confirmed", "legitimate_email_confirmed", "legitimate", "benign"),
    ("Spam_-_False_Positives", "spam_false_positive", "legitimate", "benign"),
    ("Spam_–_Inbound", "inbound", "spam", "benign"),
    ("Spam_–_Outbound", "outbound", "spam", "benign"),
]
DATASET_ROOT = "/data/dataset"


def label_map(spark: SparkSession) -> DataFrame:
    """IO2: the 14-row folder -> targets table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(LABEL_MAP, "folder string, target_3 string, target_2 string, target_1 string")


def folder_of(path, root: str = DATASET_ROOT) -> Column:
    """First folder below the corpus root."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, "^" + root.rstrip("/").replace(".", r"\.") + "/([^/]+)/", 1)


def email_list(spark: SparkSession, paths: DataFrame, root: str = DATASET_ROOT) -> DataFrame:
    """IO1+IO2: (path) -> (path, target_1, target_2, target_3) for labelled folders."""
    lm = F.broadcast(label_map(spark))
    return (paths.withColumn("folder", folder_of("path", root))
            .join(lm, "folder", "inner")
            .select("path", "target_1", "target_2", "target_3"))


def label_emails(spark: SparkSession, mails: DataFrame, root: str = DATASET_ROOT) -> DataFrame:
    """Mails + target_1..3 from the folder in the path (broadcast 14-row map)."""
    lm = F.broadcast(label_map(spark))
    return (mails.withColumn("_folder", folder_of("path", root))
            .join(lm, F.col("_folder") == lm["folder"], "left")
            .drop("_folder", lm["folder"]))


def drop_self_phishing(df: DataFrame) -> DataFrame:
    """drop target_3 = self_phishing (null targets are kept)."""
    return df.filter(~F.col("target_3").eqNullSafe("self_phishing"))


def build_metadata(spark: SparkSession, mails: DataFrame, targets: DataFrame | None = None,
                   root: str = DATASET_ROOT) -> DataFrame:
    """Metadata table: mails + text_clean (P5) + hyperlinks (P7) + targets, F1 applied.

    With an explicit e-mail list (``targets``: path, target_1..3) this is the
    left join on path (J1).  Without one the targets come from the folder in
    the path via the broadcast label map, which needs no shuffle of the mails.
    """
    meta = (mails
            .withColumn("text_clean", C.text_clean("text_plain"))
            .withColumn("text_hyperlinks", C.hyperlinks("text_html")))
    if targets is None:
        lm = F.broadcast(label_map(spark))
        meta = (meta.withColumn("_folder", folder_of("path", root))
                .join(lm, F.col("_folder") == lm["folder"], "left")
                .drop("_folder", lm["folder"]))
    else:
        meta = meta.join(targets, "path", "left")
    return drop_self_phishing(meta)


def lang_share(segments: DataFrame, min_segment_words: int = 5, min_language_words: int = 10,
               languages=("en", "fr")) -> DataFrame:
    """Share of words in the given languages per path.

    Segments with more than ``min_segment_words`` words count; languages
    totalling more than ``min_language_words`` words are kept and normalised.
    """
    per_lang = (segments.filter(F.col("words") > min_segment_words)
                .groupBy("path", F.lower("lang").alias("lang"))
                .agg(F.sum("words").alias("words"))
                .filter(F.col("words") > min_language_words))
    return (per_lang.groupBy("path")
            .agg((F.sum(F.when(F.col("lang").isin(*languages), F.col("words")).otherwise(0))
                  / F.sum("words")).alias("english_french_proportion")))


# Frequent function words used to vote on the language of a line.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "is", "in", "that", "it", "with", "for", "this", "are", "by", "on"),
    "fr": ("le", "la", "les", "des", "et", "est", "un", "une", "du", "dans", "que", "qui", "pour", "sur"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "den", "von", "zu", "auf", "für"),
    "es": ("el", "los", "las", "y", "es", "una", "del", "que", "en", "por", "con", "para", "se", "al"),
}
LANG_ORDER = ("en", "fr", "de", "es")


def stop_word_table(spark: SparkSession) -> DataFrame:
    """(lang, word, priority) rows of the voting lists (fixed size, broadcast)."""
    rows = [(lang, w, LANG_ORDER.index(lang)) for lang in LANG_ORDER for w in STOP_WORDS[lang]]
    return spark.createDataFrame(rows, "lang string, word string, priority int")


def language_segments(spark: SparkSession, mails: DataFrame, text: str = "text_plain") -> DataFrame:
    """C10 (re-aimed): every line of every text is a segment; its language is
    the list with most stop-word hits (ties -> en, fr, de, es) and its size
    the number of letter tokens.  Lines without a hit get no language."""
    lines = mails.select("path", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                         .alias("line_no", "line"))
    toks = lines.select("path", "line_no", F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+"), 0)
                        .alias("tokens"))
    words = toks.select("path", "line_no", F.size("tokens").alias("words"))
    hits = (toks.select("path", "line_no", F.explode("tokens").alias("word"))
            .join(F.broadcast(stop_word_table(spark)), "word")
            .groupBy("path", "line_no", "lang", "priority").agg(F.count(F.lit(1)).alias("hits")))
    best = hits.groupBy("path", "line_no").agg(
        F.min_by("lang", F.struct(-F.col("hits"), F.col("priority"))).alias("lang"))
    return best.join(words, ["path", "line_no"]).select("path", "lang", "words")


FEATURE_COLUMNS = [
    "subject", "url_present_in_subject", "routing_length_before_ubc",
    "dmarc_authentication_present", "dkim_sender_domains_match", "to_from_addresses_match",
    "sender_email_spf_match", "different_reply_domains", "internal_server_transfer_count",
    "name_server_match", "dkim_result", "spf_result", "dmarc_result", "text_clean",
    "word_count", "readable_proportion", "whitespace_ratio", "alphabet_proportion",
    "grammar_error_rate", "english_french_proportion", "text_content_count",
    "multimedia_content_count", "others_content_count", "hyperlink_proportion",
    "non_ascii_present", "hidden_text_present", "empty_body", "html_parsing_error",
]


def offline_features(meta: DataFrame) -> DataFrame:
    """R1 offline part: every feature computable from the metadata row alone.

    Shared intermediates (routing list, content counts, word count) are staged
    in a first projection so later expressions reuse them.
    """
    staged = meta.select(
        "*",
        H.routing_before_org("received").alias("_routing"),
        H.extract_first_server_transfer("received").alias("_first_hop"),
        C.content_count("content_types").alias("_cc"),
        C.word_count("text_clean").alias("word_count"),
    ).withColumn("_hop_domain", H.extract_domain_from_received_header("_first_hop"))
    return staged.select(
        "path", "from_email_domain", "_hop_domain", "text_plain", "content_language",
        C.word_count("text_plain").alias("_plain_words"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        H.url_present_in_subject("subject").alias("url_present_in_subject"),
        F.size("_routing").alias("routing_length_before_ubc"),
        H.has_dmarc_authentication("authentication_results").alias("dmarc_authentication_present"),
        H.dkim_domain_matches_sender("dkim_signature", "from_email_domain").alias("dkim_sender_domains_match"),
        H.to_from_match("from_email", "to_email").alias("to_from_addresses_match"),
        H.spf_email_matches_sender("received_spf", "from_email").alias("sender_email_spf_match"),
        H.check_different_reply_domain("from_email_domain", "reply_to_domain").alias("different_reply_domains"),
        H.internal_server_transfer_count("_routing").alias("internal_server_transfer_count"),
        H.get_dkim_result("authentication_results").alias("dkim_result"),
        H.get_spf_result("received_spf").alias("spf_result"),
        H.get_dmarc_result("authentication_results").alias("dmarc_result"),
        "text_clean", "word_count",
        C.readable_proportion("text_clean", "text_html").alias("readable_proportion"),
        C.whitespace_ratio("text_plain").alias("whitespace_ratio"),
        C.alphabet_proportion("text_clean").alias("alphabet_proportion"),
        F.col("_cc.text").alias("text_content_count"),
        F.col("_cc.multimedia").alias("multimedia_content_count"),
        F.col("_cc.others").alias("others_content_count"),
        C.hyperlink_proportion("text_hyperlinks", "word_count").alias("hyperlink_proportion"),
        C.non_ascii_present("text_clean").alias("non_ascii_present"),
        C.hidden_text_present("text_html").alias("hidden_text_present"),
        C.is_body_empty("text_clean", F.col("_cc.multimedia"), F.col("_cc.others"),
                        "text_hyperlinks").alias("empty_body"),
        C.html_parsing_error("text_html").alias("html_parsing_error"),
        "target_1", "target_2", "target_3",
    )


def name_server_features(df: DataFrame, domain_ns: DataFrame) -> DataFrame:
    """H17+H18: attach sender and first-hop name servers and compare them.

    ``df`` needs ``from_email_domain`` and ``hop_domain``.  The dimension has
    one row per domain, so the left joins never multiply rows.
    """
    ns_from = domain_ns.select(F.col("domain").alias("from_email_domain"),
                               F.col("name_servers").alias("_ns_from"))
    ns_hop = domain_ns.select(F.col("domain").alias("hop_domain"),
                              F.col("name_servers").alias("_ns_hop"))
    return (df.join(ns_from, "from_email_domain", "left").join(ns_hop, "hop_domain", "left")
            .withColumn("name_server_match", H.name_servers_match("_ns_hop", "_ns_from")))


def feature_table(meta: DataFrame, domain_ns: DataFrame, grammar: DataFrame,
                  segments: DataFrame) -> DataFrame:
    """Metadata -> the 28-feature row + targets, with D6 relabelling.

    Texts are counted before the joins, which then move none that no caller reads.
    Online features come from joins: name servers (H17/H18) on the sender and
    first-hop domains, grammar matches (C8) and language segments (C9) on path.
    """
    off = offline_features(meta)
    g = grammar.groupBy("path").agg(F.sum("n_matches").alias("_n_matches"))
    share = lang_share(segments)
    ns_from = domain_ns.select(F.col("domain").alias("from_email_domain"),
                               F.col("name_servers").alias("_ns_from"))
    ns_hop = domain_ns.select(F.col("domain").alias("_hop_domain"),
                              F.col("name_servers").alias("_ns_hop"))
    joined = (off.join(g, "path", "left").join(share, "path", "left")
              .join(ns_from, "from_email_domain", "left")
              .join(ns_hop, "_hop_domain", "left"))
    out = joined.select(
        "path",
        *[c for c in FEATURE_COLUMNS[:9]],
        H.name_servers_match("_ns_hop", "_ns_from").alias("name_server_match"),
        *FEATURE_COLUMNS[10:18],
        C.grammar_error_rate("text_plain", "content_language", "_n_matches", "_plain_words").alias("grammar_error_rate"),
        F.coalesce("english_french_proportion", F.lit(0.0)).alias("english_french_proportion"),
        *FEATURE_COLUMNS[20:],
        F.when(F.col("empty_body"), F.lit("malicious")).otherwise(F.col("target_1")).alias("target_1"),
        "target_2", "target_3",
    )
    return out


def email_features(spark: SparkSession, mails: DataFrame, domain_ns: DataFrame,
                   grammar: DataFrame, segments: DataFrame) -> DataFrame:
    """Metadata build + feature table from a mail frame with a ``path`` column."""
    meta = build_metadata(spark, mails)
    return feature_table(meta, domain_ns, grammar, segments)


def category_levels(train: DataFrame, cols: list[str]) -> DataFrame:
    """``column, level`` of every non-null level that ``train`` has; the fitted side of ``align_dummies``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols]))
    return train.select(pairs.alias("p")).select("p.*").where("level is not null").distinct()


def align_dummies(df: DataFrame, levels: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``key, column, level, value``: one 0/1 row per key and level of the fitted ``levels``.

    A level that only ``df`` has is dropped, one that only the fitted side has
    is 0, and so is a null.  ``levels`` becomes one array per column (the
    vocabulary of a categorical column), rows are not shuffled.
    """
    known = levels.groupBy("column").agg(F.sort_array(F.collect_set("level")).alias("levels"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("own")) for c in cols]))
    rows = df.select(key, pairs.alias("p")).select(key, "p.*").join(F.broadcast(known), "column")     # one row per column
    return (rows.select(key, "column", "own", F.explode("levels").alias("level"))
            .select(key, "column", "level", F.coalesce((F.col("own") == F.col("level")).cast("int"), F.lit(0)).alias("value")))
