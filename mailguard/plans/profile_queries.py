"""Profile, ranking, sampling and set-operation queries (A*, W*, O*, S*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions import content as C
from mailguard.operators import features as FE
from mailguard.operators import profile as P
from mailguard.operators import sampling as SM
from mailguard.plans import duck as D
from mailguard.plans.registry import register
from mailguard.sources import fixtures as FX
from mailguard.sources.tables import read_table

FOLDER_SQL = f"regexp_extract(e.path, {D.q('^/data/dataset/([^/]+)/')}, 1)"
LABELLED = FX.duck_emails_cte() + f""",
labelled AS (SELECT e.*, lm.target_1, lm.target_2, lm.target_3
             FROM emails e LEFT JOIN {D.label_map_values()} ON {FOLDER_SQL} = lm.folder)
"""
TARGET_1_LEVELS = ["benign", "malicious"]
PROFILE_COLUMNS = ["from_email", "from_email_domain", "to_email", "subject",
                   "authentication_results", "received_spf", "dkim_signature",
                   "reply_to_domain", "content_language", "text_html"]
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.label_emails(spark, FX.emails(spark, sf_dir))


@register("target_value_counts", LABELLED + """
SELECT target_3, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labelled WHERE target_3 IS NOT NULL GROUP BY target_3
""", ops=("A1", "A2", "O3", "IO2"))
def target_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails per fine-grained class with normalised share, sorted by class."""
    return P.value_counts(labelled(spark, sf_dir), "target_3", normalize=True).orderBy("target_3")


@register("language_value_counts", FX.duck_emails_cte() + """
SELECT content_language, count(*) AS n FROM emails GROUP BY content_language
""", ops=("A1",))
def language_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts keeping missing values as their own group (dropna=False)."""
    return P.value_counts(FX.emails(spark, sf_dir), "content_language", dropna=False)


@register("multipart_target_crosstab", LABELLED + """
, t AS (SELECT len(list_filter(content_types, lambda x: starts_with(x, 'multipart/'))) > 0 AS is_multipart,
               target_1 FROM labelled),
ct AS (SELECT is_multipart, count_if(target_1 = 'benign') AS benign,
              count_if(target_1 = 'malicious') AS malicious FROM t GROUP BY is_multipart)
SELECT *, round(benign / (benign + malicious), 3) * 100 AS benign_pct,
          round(malicious / (benign + malicious), 3) * 100 AS malicious_pct FROM ct
""", ops=("A3", "A4", "P8"))
def multipart_target_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts by multipart flag, pivoted, with row percentages."""
    df = labelled(spark, sf_dir).withColumn(
        "is_multipart", F.exists("content_types", lambda x: x.startswith("multipart/")))
    ct = P.crosstab(df, "is_multipart", "target_1", TARGET_1_LEVELS)
    return P.row_percent(ct.select("is_multipart", *[F.col(c).cast("long").alias(c)
                                                     for c in TARGET_1_LEVELS]), TARGET_1_LEVELS)


@register("domain_target_top20", LABELLED + """
, top AS (SELECT from_email_domain FROM labelled WHERE from_email_domain IS NOT NULL
          GROUP BY from_email_domain ORDER BY count(*) DESC, from_email_domain LIMIT 20)
SELECT from_email_domain, count_if(target_1 = 'benign') AS benign,
       count_if(target_1 = 'malicious') AS malicious
FROM labelled WHERE from_email_domain IN (SELECT from_email_domain FROM top)
GROUP BY from_email_domain
""", ops=("A5", "O1", "F2"))
def domain_target_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosstab of the 20 most frequent sender domains against the class."""
    ct = P.top_n_crosstab(labelled(spark, sf_dir), "from_email_domain", "target_1",
                          TARGET_1_LEVELS, 20)
    return ct.select("from_email_domain", *[F.col(c).cast("long").alias(c) for c in TARGET_1_LEVELS])


def _duck_profile(cols: list[str], src: str) -> str:
    parts = [f"""SELECT '{c}' AS "column",
  count(DISTINCT md5(CAST({c} AS VARCHAR))) + CASE WHEN count_if({c} IS NULL) > 0 THEN 1 ELSE 0 END AS n_unique,
  count_if({c} IS NULL) AS n_missing, round(count_if({c} IS NULL) / count(*) * 100, 2) AS missing_pct
FROM {src}""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("email_column_profile", FX.duck_emails_cte() + _duck_profile(PROFILE_COLUMNS, "emails"),
          ops=("A6", "A7", "A8"))
def email_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct, missing count and missing % of every header/body column."""
    return P.column_profile(FX.emails(spark, sf_dir), PROFILE_COLUMNS)


@register("content_type_counts", FX.duck_emails_cte() + """
SELECT value, count(*) AS n FROM (SELECT unnest(content_types) AS value FROM emails) t
WHERE value IS NOT NULL AND value <> '' GROUP BY value
""", ops=("A10", "F3"))
def content_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded MIME part types with their counts (empty and null dropped)."""
    return P.explode_counts(FX.emails(spark, sf_dir), "content_types")


@register("lineitem_describe", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS count,
  round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 9) AS p25, round(quantile_cont({c}, 0.5), 9) AS p50,
  round(quantile_cont({c}, 0.75), 9) AS p75, max({c}) AS max FROM lineitem""" for c in LINEITEM_NUMERIC),
          ops=("A11",))
def lineitem_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Describe numeric line-item columns (count, mean, std, min, quartiles, max)."""
    return P.describe(read_table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)


@register("lineitem_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC), ops=("A12",))
def lineitem_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation matrix of numeric line-item columns (long form)."""
    return P.correlation_pairs(read_table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)


@register("language_share_by_class", LABELLED + """
, c AS (SELECT target_1, content_language, count(*) AS n FROM labelled GROUP BY ALL)
SELECT *, sum(n) OVER (PARTITION BY target_1) AS class_total,
       round(n / sum(n) OVER (PARTITION BY target_1), 6) AS share FROM c
""", ops=("A13", "W1"))
def language_share_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language tag within each class (group total beside rows)."""
    return P.class_share(labelled(spark, sf_dir), "target_1", "content_language")


def _duck_hist(src: str, value: str, group: str, bins: int, lo: str, hi: str) -> str:
    width = f"(CASE WHEN {hi} > {lo} THEN ({hi} - {lo}) / {bins} ELSE 1.0 END)"
    return f"""
, bounds AS (SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi FROM {src}),
b AS (SELECT {group}, CAST(least(floor(({value} - lo) / {width.replace(lo, 'lo').replace(hi, 'hi')}) + 1, {bins}) AS INT) AS bin,
             {width.replace(lo, 'lo').replace(hi, 'hi')} AS w, lo
      FROM {src}, bounds WHERE {value} IS NOT NULL),
c AS (SELECT {group}, bin, count(*) AS n, any_value(w) AS w, any_value(lo) AS lo FROM b GROUP BY ALL)
SELECT {group}, bin, n, round(n / (sum(n) OVER (PARTITION BY {group}) * w), 9) AS density,
       round(lo + (bin - 1) * w, 9) AS bin_lo FROM c
"""


@register("word_count_histogram", LABELLED + f"""
, wc AS (SELECT target_1, CAST({D.word_count(D.text_clean('text_plain'))} AS DOUBLE) AS words FROM labelled)
""" + _duck_hist("wc", "words", "target_1", 30, "min(words)", "max(words)").replace(
    "CAST(min(words) AS DOUBLE) AS lo, CAST(max(words) AS DOUBLE) AS hi FROM wc",
    "CAST(min(words) AS DOUBLE) AS lo, CAST(max(words) AS DOUBLE) AS hi FROM wc"), ops=("A14", "C4", "P5"))
def word_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-bin word-count histogram and density per class."""
    df = labelled(spark, sf_dir).select(
        "target_1", C.word_count(C.text_clean("text_plain")).cast("double").alias("words"))
    return P.histogram(df, "words", "target_1", 30)


@register("score_histogram", FX.duck_emails_cte("scores") + """
, b AS (SELECT target_1, CAST(least(floor(p_malicious / 0.05) + 1, 20) AS INT) AS bin FROM scores
        WHERE p_malicious IS NOT NULL),
c AS (SELECT target_1, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT target_1, bin, n, round(n / (sum(n) OVER (PARTITION BY target_1) * 0.05), 9) AS density,
       round(CAST(0.0 AS DOUBLE) + (bin - 1) * CAST(0.05 AS DOUBLE), 9) AS bin_lo FROM c
""", ops=("A15",))
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-bin histogram of P(malicious) in [0, 1] per true class."""
    sc = FX.scores(spark, FX.emails(spark, sf_dir))
    return P.histogram(sc, "p_malicious", "target_1", 20, 0.0, 1.0)


@register("email_feature_kinds", FX.duck_emails_cte() + f"""
, p AS ({_duck_profile(["content_language", "reply_to_domain", "subject", "mal"], "emails")})
SELECT "column", n_unique, CASE WHEN n_unique = 2 THEN 'binary' WHEN n_unique < 20 THEN 'categorical'
  WHEN "column" IN ('mal') THEN 'numeric' ELSE 'text' END AS kind FROM p
""", ops=("A16",))
def email_feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic column typing: binary / categorical / numeric / text."""
    return P.feature_types(FX.emails(spark, sf_dir),
                           ["content_language", "reply_to_domain", "subject", "mal"], {"mal"})


@register("score_five_numbers", FX.duck_emails_cte("scores") + """
SELECT target_1, min(p_malicious) AS min, round(quantile_cont(p_malicious, 0.25), 6) AS q1,
  round(quantile_cont(p_malicious, 0.5), 6) AS median, round(quantile_cont(p_malicious, 0.75), 6) AS q3,
  max(p_malicious) AS max FROM scores GROUP BY target_1
""", ops=("A17",))
def score_five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summary of the classifier score per class."""
    return P.five_numbers(FX.scores(spark, FX.emails(spark, sf_dir)), "p_malicious", "target_1")


@register("folder_top_label", LABELLED + """
, c AS (SELECT split_part(folder, '_', 1) AS topic_id, target_3 AS label, count(*) AS n
        FROM labelled GROUP BY ALL)
SELECT topic_id, arg_min(label, (-n, label)) AS label, max(n) AS n FROM c GROUP BY topic_id
""", ops=("A18",))
def folder_top_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent fine class per folder-name prefix."""
    return P.top_label_per_topic(labelled(spark, sf_dir), "folder", "target_3")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("event_type_counts", "SELECT user_id, " + ", ".join(
    f"count_if(event_type = '{v}') AS n_{v}" for v in EVENT_TYPES) + " FROM events GROUP BY user_id",
          ops=("A19",))
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of each label value per group (count_if per value)."""
    return P.conditional_counts(read_table(spark, sf_dir, "events"), "user_id", "event_type",
                                EVENT_TYPES)


@register("scores_ranked", FX.duck_emails_cte("scores") + """
SELECT path, p_malicious, rank() OVER (ORDER BY p_malicious DESC) AS rank FROM scores
""", ops=("W2",))
def scores_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail with the SQL rank of its score (descending)."""
    sc = FX.scores(spark, FX.emails(spark, sf_dir)).select("path", "p_malicious")
    return P.rank_desc(sc, "p_malicious")


def _duck_quota_sample(src: str, strata: list[str], key: str, quota_sql: str, seed: str = "42",
                       buckets: int = SM.DEFAULT_BUCKETS, flag: str = "_selected", prefix: str = "") -> str:
    """DuckDB rendering of ``sampling.quota_sample`` (same algorithm).  CTE
    names get ``prefix``; the result CTE is ``{prefix}sampled`` and the
    per-stratum cell table ``{prefix}c2`` (usable in ``quota_sql``)."""
    p = prefix
    st = ", ".join(strata)
    stc = (st + ", ") if strata else ""
    part = f"PARTITION BY {st}" if strata else ""
    on = " AND ".join(f"a.{s} IS NOT DISTINCT FROM q.{s}" for s in strata)
    on = (on + " AND ") if strata else ""
    rn_part = ", ".join(f"q.{s}" for s in strata)
    rn_part = (rn_part + ", ") if strata else ""
    return f"""
, {p}qb AS (SELECT *, md5(CAST({key} AS VARCHAR) || '{seed}') AS _h FROM {src}),
{p}qc AS (SELECT *, CAST(('0x' || substr(_h, 1, 8)) AS BIGINT) % {buckets} AS _bucket FROM {p}qb),
{p}cells AS (SELECT {stc}_bucket, count(*) AS _cell_n FROM {p}qc GROUP BY ALL),
{p}c2 AS (SELECT *, sum(_cell_n) OVER ({part}) AS _stratum_n FROM {p}cells),
{p}c3 AS (SELECT *, {quota_sql.replace("c2.", p + "c2.")} AS _quota FROM {p}c2),
{p}c4 AS (SELECT *, floor(_quota * _cell_n / _stratum_n) AS _floor,
              _quota * _cell_n / _stratum_n - floor(_quota * _cell_n / _stratum_n) AS _rem FROM {p}c3),
{p}c5 AS (SELECT *, _quota - sum(_floor) OVER ({part}) AS _left,
              row_number() OVER ({part} ORDER BY _rem DESC, _bucket) AS _rr FROM {p}c4),
{p}alloc AS (SELECT {stc}_bucket, CAST(_floor + CASE WHEN _rr <= _left THEN 1 ELSE 0 END AS BIGINT) AS _cell_quota
             FROM {p}c5),
{p}sampled AS (SELECT q.*, row_number() OVER (PARTITION BY {rn_part}q._bucket ORDER BY q._h, q.{key})
                 <= coalesce(a._cell_quota, 0) AS {flag}
            FROM {p}qc q LEFT JOIN {p}alloc a ON {on}a._bucket = q._bucket)
"""


@register("per_folder_sample", LABELLED + _duck_quota_sample(
    "labelled", ["folder"], "path", "least(5, _stratum_n)", flag="_keep") + """
SELECT folder, path, target_1 FROM sampled WHERE _keep
""", ops=("W3",))
def per_folder_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5 mails per folder, chosen by a seeded hash order."""
    return SM.per_group_sample(labelled(spark, sf_dir), "folder", 5, "path").select(
        "folder", "path", "target_1")


@register("longest_mails_top50", FX.duck_emails_cte() + """
SELECT path, length(text_plain) AS n_chars FROM emails ORDER BY n_chars DESC, path LIMIT 50
""", ops=("O2",))
def longest_mails_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 longest bodies (sort descending, head 50; ties by path)."""
    return (FX.emails(spark, sf_dir).select("path", F.length("text_plain").alias("n_chars"))
            .orderBy(F.col("n_chars").desc(), "path").limit(50))


@register("top_subjects", FX.duck_emails_cte() + """
SELECT subject, count(*) AS n FROM emails WHERE subject IS NOT NULL
GROUP BY subject ORDER BY n DESC, subject LIMIT 15
""", ops=("O1",))
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most frequent subjects (ties by subject)."""
    return P.top_n_values(FX.emails(spark, sf_dir), "subject", 15)


SPLIT_SQL = LABELLED + ", lab AS (SELECT * FROM labelled WHERE target_3 IS DISTINCT FROM 'self_phishing')" \
    + _duck_quota_sample("lab", ["target_3"], "path", "round(0.3 * _stratum_n)", flag="_test") \
    + ", split AS (SELECT *, CASE WHEN _test THEN 'test' ELSE 'train' END AS split FROM sampled)\n"


def split_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = FE.drop_self_phishing(labelled(spark, sf_dir))
    return SM.stratified_split(lab, ["target_3"], 0.3, "path")


@register("stratified_split_counts", SPLIT_SQL + """
SELECT split, target_3, count(*) AS n FROM split GROUP BY ALL
""", ops=("D1", "S1", "S3"))
def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/30 split stratified on target_3: rows per (split, class)."""
    s = split_df(spark, sf_dir)
    train = s.filter(F.col("split") == "train").drop("split")
    test = s.filter(F.col("split") == "test").drop("split")
    both = P.stack_frames(train, test, "split")
    return both.groupBy("split", "target_3").agg(F.count(F.lit(1)).alias("n"))


@register("split_label_union", SPLIT_SQL + """
SELECT DISTINCT target_3 FROM split WHERE split = 'train'
UNION SELECT DISTINCT target_3 FROM split WHERE split = 'test'
""", ops=("S2",))
def split_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the class labels seen in train and in test."""
    s = split_df(spark, sf_dir)
    return P.union_distinct(s.filter("split = 'train'").select("target_3"),
                            s.filter("split = 'test'").select("target_3"))


@register("domain_class_table_top10", LABELLED + """
, c AS (SELECT from_email_domain, count_if(target_1 = 'benign') AS benign,
               count_if(target_1 = 'malicious') AS malicious FROM labelled
        WHERE from_email_domain IS NOT NULL GROUP BY from_email_domain)
SELECT *, benign + malicious AS total FROM c ORDER BY malicious DESC, from_email_domain LIMIT 10
""", ops=("A9", "A3", "O2"))
def domain_class_table_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails per (sender domain, class) reshaped wide with a total, the 10
    domains with most malicious mail."""
    lab = labelled(spark, sf_dir).filter(F.col("from_email_domain").isNotNull())
    ct = P.crosstab(lab, "from_email_domain", "target_1", TARGET_1_LEVELS)
    ct = ct.select("from_email_domain", *[F.col(c).cast("long").alias(c) for c in TARGET_1_LEVELS])
    return (ct.withColumn("total", F.col("benign") + F.col("malicious"))
            .orderBy(F.col("malicious").desc(), "from_email_domain").limit(10))


@register("plain_and_stratified_splits", LABELLED
          + _duck_quota_sample("labelled", [], "path", "round(0.3 * _stratum_n)", flag="_test", prefix="p_")
          + _duck_quota_sample("labelled", ["target_1"], "path", "round(0.2 * _stratum_n)", seed="7",
                               flag="_test", prefix="s_") + """
SELECT 'plain_70_30' AS scheme, CASE WHEN _test THEN 'test' ELSE 'train' END AS split,
       CAST(NULL AS VARCHAR) AS target_1, count(*) AS n FROM p_sampled GROUP BY ALL
UNION ALL
SELECT 'stratified_80_20', CASE WHEN _test THEN 'test' ELSE 'train' END, target_1, count(*)
FROM s_sampled GROUP BY ALL
""", ops=("D3", "D1"))
def plain_and_stratified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain 70/30 split and an 80/20 split stratified on the class: rows per part."""
    lab = labelled(spark, sf_dir)
    plain = SM.stratified_split(lab, [], 0.3, "path")
    strat = SM.stratified_split(lab, ["target_1"], 0.2, "path", seed="7")
    a = plain.groupBy(F.lit("plain_70_30").alias("scheme"), "split",
                      F.lit(None).cast("string").alias("target_1")).agg(F.count(F.lit(1)).alias("n"))
    b = strat.groupBy(F.lit("stratified_80_20").alias("scheme"), "split", "target_1").agg(
        F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)
