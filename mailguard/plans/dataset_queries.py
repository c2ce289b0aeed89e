"""Data-set building, validation, join and file round-trip queries
(D2, D4, D5, D7, D8, F4-F9, J3-J5, J7, IO3, IO4, IO6, IO7)."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailguard.functions import content as C
from mailguard.operators import features as FE
from mailguard.operators import profile as P
from mailguard.operators import quality as Q
from mailguard.operators import sampling as SM
from mailguard.plans import duck as D
from mailguard.plans import feature_queries as FQ
from mailguard.plans import profile_queries as PQ
from mailguard.plans.registry import register
from mailguard.sources import files as IO
from mailguard.sources import fixtures as FX

NON_SELF = PQ.LABELLED + ", lab AS (SELECT * FROM labelled WHERE target_3 IS DISTINCT FROM 'self_phishing')\n"


def non_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.drop_self_phishing(PQ.labelled(spark, sf_dir))


@register("stratified_sample_200", NON_SELF + """
, st AS (SELECT target_3, count(*) AS _n_s FROM lab GROUP BY target_3),
st2 AS (SELECT *, 200 * _n_s / sum(_n_s) OVER () AS _share FROM st),
st3 AS (SELECT *, floor(_share) AS _floor, _share - floor(_share) AS _rem,
               200 - sum(floor(_share)) OVER () AS _left,
               row_number() OVER (ORDER BY _share - floor(_share) DESC, target_3) AS _rr FROM st2),
squota AS (SELECT target_3, CAST(_floor + CASE WHEN _rr <= _left THEN 1 ELSE 0 END AS BIGINT) AS q FROM st3)
""" + PQ._duck_quota_sample("lab", ["target_3"], "path",
                            "(SELECT q FROM squota WHERE squota.target_3 = c2.target_3)") + """
SELECT target_3, count(*) AS n FROM sampled WHERE _selected GROUP BY target_3
""", ops=("D2",))
def stratified_sample_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 200 mails stratified on target_3: rows per class in the sample."""
    s = SM.stratified_sample_n(non_self(spark, sf_dir), ["target_3"], 200, "path")
    return s.filter("_selected").groupBy("target_3").agg(F.count(F.lit(1)).alias("n"))


@register("simple_sample_100", FX.duck_emails_cte() + """
SELECT path FROM emails ORDER BY md5(path || '42'), path LIMIT 100
""", ops=("D4",))
def simple_sample_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 mails in seeded hash order."""
    return SM.simple_sample(FX.emails(spark, sf_dir).select("path"), 100, "path")


SHARE_TARGETS = ("target_1", "target_2", "target_3")


@register("split_proportion_check", PQ.SPLIT_SQL + "\n".join([]) + ", dist AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS target, {t} AS label, count(*) / sum(count(*)) OVER () AS share, 'all' AS part
         FROM split GROUP BY {t}
       UNION ALL SELECT '{t}', {t}, count(*) / sum(count(*)) OVER (PARTITION BY split), split
         FROM split GROUP BY {t}, split"""
    for t in SHARE_TARGETS) + """)
, o AS (SELECT target, label, share FROM dist WHERE part = 'all'),
tr AS (SELECT target, label, share FROM dist WHERE part = 'train'),
te AS (SELECT target, label, share FROM dist WHERE part = 'test'),
j AS (SELECT coalesce(o.target, tr.target) AS target, coalesce(o.label, tr.label) AS label,
             coalesce(o.share, 0.0) AS original, coalesce(tr.share, 0.0) AS train
      FROM o FULL OUTER JOIN tr ON o.target = tr.target AND o.label = tr.label),
k AS (SELECT coalesce(j.target, te.target) AS target, coalesce(j.label, te.label) AS label,
             coalesce(j.original, 0.0) AS original, coalesce(j.train, 0.0) AS train,
             coalesce(te.share, 0.0) AS test
      FROM j FULL OUTER JOIN te ON j.target = te.target AND j.label = te.label)
SELECT target, label, round(original, 6) AS original, round(train, 6) AS train, round(test, 6) AS test,
       abs(train - original) <= 0.01 AND abs(test - original) <= 0.01 AS within_tolerance FROM k
""", ops=("D5", "J7", "A2", "D1"))
def split_proportion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares in the whole set, train and test (outer-aligned, missing -> 0)
    and whether both splits are within 0.01 of the whole."""
    s = PQ.split_df(spark, sf_dir)
    frames = []
    for t in SHARE_TARGETS:
        def shares(df: DataFrame, name: str) -> DataFrame:
            return (P.value_counts(df, t, normalize=False)
                    .withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy()))
                    .select(F.col(t).alias("label"), name))
        o = shares(s, "original")
        tr = shares(s.filter("split = 'train'"), "train")
        te = shares(s.filter("split = 'test'"), "test")
        j = (o.join(tr, "label", "full_outer").join(te, "label", "full_outer")
             .fillna(0.0, subset=["original", "train", "test"]))
        frames.append(j.withColumn("target", F.lit(t)))
    out = Q.union_all(frames)
    return out.select(
        "target", "label", F.round("original", 6).alias("original"),
        F.round("train", 6).alias("train"), F.round("test", 6).alias("test"),
        ((F.abs(F.col("train") - F.col("original")) <= 0.01)
         & (F.abs(F.col("test") - F.col("original")) <= 0.01)).alias("within_tolerance"))


@register("label_encoding", NON_SELF + """
, lv AS (SELECT DISTINCT target_3 FROM lab),
idx AS (SELECT target_3, dense_rank() OVER (ORDER BY target_3) - 1 AS target_3_index FROM lv)
SELECT l.path, CASE l.target_1 WHEN 'malicious' THEN 1 ELSE CASE WHEN l.target_1 IS NOT NULL THEN 0 END END AS target_1_code,
       CAST(i.target_3_index AS BIGINT) AS target_3_index
FROM lab l JOIN idx i ON i.target_3 = l.target_3
""", ops=("D7",))
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary code for target_1 and alphabetical index for target_3."""
    lab = non_self(spark, sf_dir)
    model = StringIndexer(inputCol="target_3", outputCol="_idx", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(lab)
    return model.transform(lab).select(
        "path", (F.col("target_1") == "malicious").cast("int").alias("target_1_code"),
        F.col("_idx").cast("long").alias("target_3_index"))


@register("class_weights", NON_SELF + """
, c AS (SELECT target_1, count(*) AS n_c FROM lab WHERE target_1 IS NOT NULL GROUP BY target_1),
w AS (SELECT target_1, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM c)
SELECT l.path, l.target_1, w.weight FROM lab l LEFT JOIN w ON w.target_1 = l.target_1
""", ops=("D8",))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weight n / (k * n_class) on every row; a mail without a target has none."""
    lab = non_self(spark, sf_dir)
    per = lab.where("target_1 is not null").groupBy("target_1").agg(F.count(F.lit(1)).alias("n_c"))
    # one row per class: the global window is over k rows only
    allw = Window.partitionBy()
    w = per.select("target_1", F.round(F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw)
                                                                   * F.col("n_c")), 6).alias("weight"))
    return lab.join(F.broadcast(w), "target_1", "left").select("path", "target_1", "weight")


@register("non_null_columns", FX.duck_emails_cte() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({c}) = 0 AS dropped FROM emails"
    for c in ["path", "folder", "from_email", "from_email_domain", "to_email", "subject", "received",
              "authentication_results", "received_spf", "dkim_signature", "reply_to_domain",
              "content_language", "content_types", "text_plain", "text_html", "mal"]), ops=("F4",))
def non_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null count per column and whether the column would be dropped."""
    return Q.non_null_counts(FX.emails(spark, sf_dir))


def _duck_rules(src: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS rule, CAST(count_if(NOT coalesce({pred}, false)) AS BIGINT) AS violations FROM {src}"
        for name, pred in rules.items())


def _lv(col: str, levels) -> str:
    return f"({col} IS NOT NULL AND {col} IN ({', '.join(D.q(x) for x in levels)}))"


META_RULES_SQL = {
    "text_plain_not_null": "text_plain IS NOT NULL", "text_clean_not_null": "text_clean IS NOT NULL",
    "content_types_not_null": "content_types IS NOT NULL",
    "target_1_level": _lv("target_1", Q.TARGET_1_LEVELS),
    "target_2_level": _lv("target_2", Q.TARGET_2_LEVELS),
    "target_3_level": _lv("target_3", Q.TARGET_3_LEVELS)}


@register("metadata_validation", FQ.META_SQL + _duck_rules("staged", META_RULES_SQL), ops=("F5", "F1"))
def metadata_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violation count per metadata rule (after dropping self-phishing)."""
    return Q.violations(FQ.meta_df(spark, sf_dir), Q.metadata_rules())


def _feature_rules_sql() -> dict[str, str]:
    unit = ["readable_proportion", "whitespace_ratio", "alphabet_proportion", "grammar_error_rate",
            "english_french_proportion", "hyperlink_proportion"]
    counts = ["routing_length_before_ubc", "internal_server_transfer_count", "word_count",
              "text_content_count", "multimedia_content_count", "others_content_count"]
    flags = ["url_present_in_subject", "dmarc_authentication_present", "dkim_sender_domains_match",
             "to_from_addresses_match", "sender_email_spf_match", "different_reply_domains",
             "name_server_match", "non_ascii_present", "hidden_text_present", "empty_body"]
    r = {f"{c}_in_0_1": f"{c} BETWEEN 0 AND 1" for c in unit}
    r.update({f"{c}_ge_0": f"{c} >= 0" for c in counts})
    r.update({f"{c}_not_null": f"{c} IS NOT NULL" for c in flags})
    r.update({f"{c}_not_null": f"{c} IS NOT NULL" for c in ("dkim_result", "spf_result", "dmarc_result")})
    r["html_parsing_error_level"] = "html_parsing_error IN (-1, 0, 1)"
    r["target_1_level"] = _lv("target_1", Q.TARGET_1_LEVELS)
    r["target_2_level"] = _lv("target_2", Q.TARGET_2_LEVELS)
    r["target_3_level"] = _lv("target_3", Q.TARGET_3_LEVELS)
    return r


@register("feature_validation", FQ.FEATURES_SQL.replace("\nSELECT s.path,", ", feats AS (\nSELECT s.path,", 1)
          + ")\n" + _duck_rules("feats", _feature_rules_sql()), ops=("F6", "R1"))
def feature_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violation count per feature-table rule (ranges, levels, non-null)."""
    return Q.violations(FQ.features_df(spark, sf_dir), Q.feature_rules())


@register("email_list_validation", PQ.LABELLED + _duck_rules("labelled", {
    f"{c}_not_null": f"{c} IS NOT NULL" for c in ("path", "target_1", "target_2", "target_3")}),
          ops=("F7", "IO1", "IO2"))
def email_list_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the e-mail list contract (path and three targets present)."""
    return Q.violations(PQ.labelled(spark, sf_dir), Q.email_list_rules())


@register("prediction_validation", FX.duck_emails_cte("scores") + _duck_rules(
    "(SELECT 1.0 - p_malicious AS b, p_malicious AS m FROM scores)",
    {"benign_in_0_1": "b BETWEEN 0 AND 1", "malicious_in_0_1": "m BETWEEN 0 AND 1",
     "sum_near_1": "b + m BETWEEN 0.99 AND 1.01"}), ops=("F8", "R2"))
def prediction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the prediction contract on the probability struct."""
    sc = FX.scores(spark, FX.emails(spark, sf_dir))
    pred = sc.select(F.struct((1.0 - F.col("p_malicious")).alias("benign"),
                              F.col("p_malicious").alias("malicious")).alias("probability"))
    return Q.violations(pred, Q.prediction_rules())


@register("partial_feature_cache_check", FX.duck_emails_cte("grammar_matches", "lang_segments")
          + FQ._duck_meta_ctes() + """
, online AS (SELECT DISTINCT s.path FROM staged s
             LEFT JOIN (SELECT path, sum(n_matches) AS n FROM grammar_matches GROUP BY path) g
             ON g.path = s.path),
offline AS (SELECT DISTINCT path FROM staged)
SELECT count_if(f.path IS NULL) AS missing_in_second, count_if(o.path IS NULL) AS missing_in_first,
       true AS columns_ok
FROM online o FULL OUTER JOIN offline f ON f.path = o.path
""", ops=("F9", "J2"))
def partial_feature_cache_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached online-feature frame covers exactly the offline frame's mails
    and holds exactly the three online columns."""
    mails = FX.emails(spark, sf_dir)
    meta = FE.build_metadata(spark, mails)
    off = FE.offline_features(meta).select("path")
    g = FX.grammar_matches(spark, mails).groupBy("path").agg(F.sum("n_matches").alias("n"))
    online = (meta.select("path", "text_plain", "content_language").join(g, "path", "left")
              .join(FE.lang_share(FX.lang_segments(spark, mails)), "path", "left")
              .select("path", F.lit(False).alias("name_server_match"),
                      C.grammar_error_rate("text_plain", "content_language", "n").alias("grammar_error_rate"),
                      F.coalesce("english_french_proportion", F.lit(0.0)).alias("english_french_proportion")))
    cols_ok = set(online.columns) - {"path"} == {"name_server_match", "grammar_error_rate",
                                                   "english_french_proportion"}
    return Q.key_coverage(online, off, "path").withColumn("columns_ok", F.lit(cols_ok))


@register("raw_processed_join", FQ.META_SQL + """
SELECT e.path, e.from_email, e.subject, s.word_count, s.target_1
FROM emails e LEFT JOIN staged s ON s.path = e.path
""", ops=("J3", "J4", "J5"))
def raw_processed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns beside processed ones (left join on path; self-phishing
    mails have no processed row)."""
    mails = FX.emails(spark, sf_dir)
    proc = FQ.meta_df(spark, sf_dir).select(
        "path", C.word_count("text_clean").cast("long").alias("word_count"), "target_1")
    return mails.select("path", "from_email", "subject").join(proc, "path", "left")


@register("email_list_csv_roundtrip", PQ.LABELLED + """
SELECT path, target_1, target_2, target_3 FROM labelled WHERE target_1 IS NOT NULL
""", ops=("IO3", "IO1", "IO2"))
def email_list_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail list written as CSV to the shared folder and read back with a fixed schema."""
    lst = FE.email_list(spark, FX.emails(spark, sf_dir).select("path"))
    path = IO.scratch_path(spark, "email-list")
    IO.write_email_list(lst, path)
    return IO.read_email_list(spark, path)


@register("metadata_parquet_roundtrip", FQ.META_SQL + """
SELECT path, target_1, text_clean, array_to_string(text_hyperlinks, ' ') AS links FROM staged
""", ops=("IO4",))
def metadata_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as Parquet (partitioned by class) and read back."""
    meta = FQ.meta_df(spark, sf_dir).select("path", "target_1", "text_clean", "text_hyperlinks")
    path = IO.scratch_path(spark, "metadata")
    IO.write_parquet(meta, path, partition_by=["target_1"])
    back = IO.read_parquet(spark, path)
    return back.select("path", "target_1", "text_clean",
                       F.array_join("text_hyperlinks", " ").alias("links"))


@register("legacy_json_roundtrip", FX.duck_emails_cte("legacy_scores") + """
SELECT path, label, CAST(ceo_fraud AS DOUBLE) AS body_ceo_fraud, CAST(legitimate AS DOUBLE) AS body_legitimate,
  CAST(phishing AS DOUBLE) AS body_phishing, CAST(spam AS DOUBLE) AS body_spam,
  CAST(spam AS DOUBLE) AS subject_ceo_fraud, CAST(phishing AS DOUBLE) AS subject_legitimate,
  CAST(legitimate AS DOUBLE) AS subject_phishing, CAST(ceo_fraud AS DOUBLE) AS subject_spam
FROM legacy_scores
""", ops=("IO6", "IO7"))
def legacy_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer input exported as nested JSON; scorer-shaped output (zero classes
    omitted) written and flattened back to one row per mail."""
    mails = FX.emails(spark, sf_dir)
    lab = FE.label_emails(spark, mails)
    IO.write_scorer_input(lab.select("path", F.col("target_1").alias("label"), "subject",
                                     F.col("text_plain").alias("body")),
                          IO.scratch_path(spark, "scorer-input"))
    lg = FX.legacy_scores(spark, mails)
    out = lg.select("path", "label",
                    *[F.col(c).alias(f"body_{c}") for c in ("ceo_fraud", "legitimate", "phishing", "spam")],
                    F.col("spam").alias("subject_ceo_fraud"), F.col("phishing").alias("subject_legitimate"),
                    F.col("legitimate").alias("subject_phishing"), F.col("ceo_fraud").alias("subject_spam"))
    path = IO.scratch_path(spark, "scorer-output")
    IO.write_scorer_output(out, path)
    return IO.read_scorer_output(spark, path)


@register("metrics_csv_report", FX.duck_emails_cte("scores") + """
, preds AS (SELECT *, CASE WHEN 1.0 - p_malicious > 0.7 THEN 'benign' ELSE 'malicious' END AS pred FROM scores)
SELECT CAST(count_if(target_1 = 'benign' AND pred = 'benign') AS VARCHAR) AS benign_as_benign,
       CAST(count_if(target_1 = 'benign' AND pred = 'malicious') AS VARCHAR) AS benign_as_malicious,
       CAST(count_if(target_1 = 'malicious' AND pred = 'benign') AS VARCHAR) AS malicious_as_benign,
       CAST(count_if(target_1 = 'malicious' AND pred = 'malicious') AS VARCHAR) AS malicious_as_malicious
FROM preds
""", ops=("IO8", "M18"))
def metrics_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion table written as a one-file CSV report in the shared folder
    and read back (all columns as text, as a CSV reader sees them)."""
    from mailguard.operators import metrics as M
    sc = FX.scores(spark, FX.emails(spark, sf_dir))
    cm = M.confusion(sc.withColumn("pred", M.decide(1.0 - F.col("p_malicious"), 0.7)), "target_1", "pred")
    path = IO.scratch_path(spark, "report")
    IO.write_csv_report(cm, path)
    return spark.read.option("header", True).csv(path)


DUMMY_COLS = ["content_language", "reply_to_domain", "folder"]
# Train and validation differ in their levels: languages other than French train, Spanish ones validate too; folders differ.
_TRAIN, _VALID = "k % 3 <> 0 AND coalesce(content_language, '') <> 'fr'", "k % 3 = 0 AND coalesce(content_language, '') <> 'de'"


@register("aligned_dummies", FX.duck_emails_cte() + f""",
e AS (SELECT *, CAST(split_part(path, '/', -2) AS BIGINT) AS k FROM emails),
long AS (UNPIVOT (SELECT path, k, content_language AS lang, content_language, reply_to_domain, folder FROM e)
         ON {', '.join(DUMMY_COLS)} INTO NAME col VALUE level),
levels AS (SELECT DISTINCT col, level FROM long WHERE {_TRAIN.replace('content_language', 'lang')}),
valid AS (SELECT path FROM e WHERE {_VALID})
SELECT v.path, l.col AS "column", l.level, CAST(count(o.level) AS INTEGER) AS value
FROM valid v CROSS JOIN levels l LEFT JOIN long o ON o.path = v.path AND o.col = l.col AND o.level = l.level GROUP BY ALL
""", ops=("J6",))
def aligned_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummies of the validation mails in the columns of the training mails:
    levels absent from training are dropped, those absent from validation 0."""
    mails = FX.emails(spark, sf_dir).withColumn("k", F.element_at(F.split("path", "/"), -2).cast("long"))
    levels = FE.category_levels(mails.where(_TRAIN), DUMMY_COLS)
    return FE.align_dummies(mails.where(_VALID), levels, "path", DUMMY_COLS)
