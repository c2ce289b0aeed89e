"""Data-quality checks as single aggregates.

Each check is one pass producing one violation count per rule, so a check
over a huge table is one distributed aggregate and its result is tiny.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed target levels.
TARGET_1_LEVELS = ("benign", "malicious")
TARGET_2_LEVELS = ("ceo_fraud", "phishing", "reply-chain-attack", "legitimate", "spam")
TARGET_3_LEVELS = ("gift_cards", "payroll_update", "wire_transfers", "third_party", "outbound",
                   "ubc", "ubc_outbound", "spearphishing", "reply-chain-attack",
                   "legitimate_email_confirmed", "spam_false_positive", "inbound")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (rule, violations) where each rule is a predicate that must hold."""
    one = df.agg(*[F.count_if(~F.coalesce(pred, F.lit(False))).alias(name)
                   for name, pred in rules.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").cast("long").alias("violations"))
        for name in rules])).alias("r")).select("r.*")


def levels_rule(col: str, levels) -> Column:
    return F.col(col).isNotNull() & F.col(col).isin(*levels)


def metadata_rules() -> dict[str, Column]:
    """metadata frame contract (non-null bodies, allowed target levels)."""
    return {
        "text_plain_not_null": F.col("text_plain").isNotNull(),
        "text_clean_not_null": F.col("text_clean").isNotNull(),
        "content_types_not_null": F.col("content_types").isNotNull(),
        "target_1_level": levels_rule("target_1", TARGET_1_LEVELS),
        "target_2_level": levels_rule("target_2", TARGET_2_LEVELS),
        "target_3_level": levels_rule("target_3", TARGET_3_LEVELS),
    }


def feature_rules() -> dict[str, Column]:
    """feature frame contract (types are fixed by the plan; values checked)."""
    unit = ["readable_proportion", "whitespace_ratio", "alphabet_proportion", "grammar_error_rate",
            "english_french_proportion", "hyperlink_proportion"]
    counts = ["routing_length_before_ubc", "internal_server_transfer_count", "word_count",
              "text_content_count", "multimedia_content_count", "others_content_count"]
    flags = ["url_present_in_subject", "dmarc_authentication_present", "dkim_sender_domains_match",
             "to_from_addresses_match", "sender_email_spf_match", "different_reply_domains",
             "name_server_match", "non_ascii_present", "hidden_text_present", "empty_body"]
    rules: dict[str, Column] = {}
    for c in unit:
        rules[f"{c}_in_0_1"] = F.col(c).between(0, 1)
    for c in counts:
        rules[f"{c}_ge_0"] = F.col(c) >= 0
    for c in flags:
        rules[f"{c}_not_null"] = F.col(c).isNotNull()
    for c in ("dkim_result", "spf_result", "dmarc_result"):
        rules[f"{c}_not_null"] = F.col(c).isNotNull()
    rules["html_parsing_error_level"] = F.col("html_parsing_error").isin(-1, 0, 1)
    rules["target_1_level"] = levels_rule("target_1", TARGET_1_LEVELS)
    rules["target_2_level"] = levels_rule("target_2", TARGET_2_LEVELS)
    rules["target_3_level"] = levels_rule("target_3", TARGET_3_LEVELS)
    return rules


def email_list_rules() -> dict[str, Column]:
    """the e-mail list has three non-null string targets and a path."""
    return {f"{c}_not_null": F.col(c).isNotNull() for c in ("path", "target_1", "target_2", "target_3")}


def prediction_rules(prob: str = "probability") -> dict[str, Column]:
    """F8: probabilities in [0, 1] and summing to 1 within 0.01."""
    b, m = F.col(f"{prob}.benign"), F.col(f"{prob}.malicious")
    return {"benign_in_0_1": b.between(0, 1), "malicious_in_0_1": m.between(0, 1),
            "sum_near_1": (b + m).between(0.99, 1.01)}


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """keys of ``a`` missing from ``b`` and keys of ``b`` missing from ``a``,
    from one full outer join of the distinct keys and one aggregate."""
    ka = a.select(F.col(key).alias("_ka")).distinct()
    kb = b.select(F.col(key).alias("_kb")).distinct()
    j = ka.join(kb, F.col("_ka") == F.col("_kb"), "full_outer")
    return j.agg(F.count_if(F.col("_kb").isNull()).alias("missing_in_second"),
                 F.count_if(F.col("_ka").isNull()).alias("missing_in_first"))


def non_null_counts(df: DataFrame) -> DataFrame:
    """non-null count per column (one pass); a column with 0 is dropped."""
    one = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null"),
                 (F.col(f"`{c}`") == 0).alias("dropped")) for c in df.columns])).alias("r")
    ).select("r.*")


def drop_all_null(df: DataFrame) -> DataFrame:
    """the frame without its all-null columns."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if row[c] == 0])


def all_hold(rules_df: DataFrame) -> bool:
    """True when every rule has zero violations (small driver-side read)."""
    return rules_df.agg(F.sum("violations")).first()[0] == 0


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
