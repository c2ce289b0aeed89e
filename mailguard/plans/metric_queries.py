"""Model-evaluation queries over classifier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.operators import features as FE
from mailguard.operators import metrics as M
from mailguard.operators import sampling as SM
from mailguard.plans import profile_queries as PQ
from mailguard.plans.registry import register
from mailguard.sources import fixtures as FX

SCORES = FX.duck_emails_cte("scores", "legacy_scores") + """
, preds AS (SELECT *, CASE WHEN 1.0 - p_malicious > 0.7 THEN 'benign' ELSE 'malicious' END AS pred
            FROM scores)
"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = FX.scores(spark, FX.emails(spark, sf_dir))
    return sc.withColumn("pred", M.decide(1.0 - F.col("p_malicious"), 0.7))


def _duck_cells(src: str, by: str = "") -> str:
    cells = ", ".join(f"count_if(target_1 = '{t}' AND pred = '{p}') AS {t}_as_{p}"
                      for t in M.CLASSES for p in M.CLASSES)
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"SELECT {sel}{cells} FROM {src}{grp}"


def _duck_metrics(cm: str, positive: str = "benign", by: str = "") -> str:
    o = "malicious" if positive == "benign" else "benign"
    tp, fn, fp = f"{positive}_as_{positive}", f"{positive}_as_{o}", f"{o}_as_{positive}"

    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}round({div(tp, f'{tp} + {fp}')}, 6) AS precision,
  round({div(tp, f'{tp} + {fn}')}, 6) AS recall,
  round({div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1,
  CAST({tp} + {fn} AS BIGINT) AS support,
  round({div('benign_as_malicious', 'benign_as_malicious + benign_as_benign')}, 6) AS false_malicious_rate,
  round({div('malicious_as_benign', 'malicious_as_benign + malicious_as_malicious')}, 6) AS false_benign_rate
FROM ({cm}) cm"""


@register("score_confusion", SCORES + _duck_cells("preds"), ops=("M18", "M24"))
def score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of the 0.7-on-benign decision rule."""
    return M.confusion(preds(spark, sf_dir), "target_1", "pred")


@register("score_classification_report", SCORES + ", cm AS (" + _duck_cells("preds") + ")\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS class,
  round(CASE WHEN {c}_as_{c} + {o}_as_{c} > 0 THEN {c}_as_{c} / ({c}_as_{c} + {o}_as_{c}) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN {c}_as_{c} + {c}_as_{o} > 0 THEN {c}_as_{c} / ({c}_as_{c} + {c}_as_{o}) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * {c}_as_{c} + {o}_as_{c} + {c}_as_{o} > 0
             THEN 2 * {c}_as_{c} / (2 * {c}_as_{c} + {o}_as_{c} + {c}_as_{o}) ELSE 0.0 END, 6) AS f1,
  CAST({c}_as_{c} + {c}_as_{o} AS BIGINT) AS support FROM cm"""
    for c, o in (("benign", "malicious"), ("malicious", "benign"))), ops=("M19",))
def score_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return M.classification_report(preds(spark, sf_dir), "target_1", "pred")


@register("score_model_metrics", SCORES + _duck_metrics(_duck_cells("preds")), ops=("M20",))
def score_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benign-class P/R/F1 with false-malicious and false-benign rates."""
    return M.model_metrics(preds(spark, sf_dir), "target_1", "pred")


@register("score_f1_malicious", SCORES + _duck_metrics(_duck_cells("preds"), positive="malicious"),
          ops=("M21",))
def score_f1_malicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics with the malicious class as the positive label."""
    return M.model_metrics(preds(spark, sf_dir), "target_1", "pred", positive="malicious")


@register("score_roc_auc", SCORES + """
SELECT round(avg(CASE WHEN a.p_malicious > b.p_malicious THEN 1.0
                      WHEN a.p_malicious = b.p_malicious THEN 0.5 ELSE 0.0 END), 6) AS roc_auc
FROM scores a JOIN scores b ON a.target_1 = 'malicious' AND b.target_1 <> 'malicious'
""", ops=("M22",))
def score_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC of P(malicious) (ties count one half)."""
    return M.roc_auc(preds(spark, sf_dir), "target_1", "p_malicious")


SWEEP_SQL = SCORES + """
, th AS (SELECT i / 100.0 AS threshold FROM range(1, 100) t(i)),
cnt AS (SELECT threshold,
          count_if(s.target_1 = 'malicious' AND s.p_malicious >= threshold) AS tp,
          count_if(s.target_1 <> 'malicious' AND s.p_malicious >= threshold) AS fp,
          count_if(s.target_1 = 'malicious' AND s.p_malicious < threshold) AS fn,
          count_if(s.target_1 <> 'malicious' AND s.p_malicious < threshold) AS tn
        FROM th, scores s GROUP BY threshold),
sweep AS (SELECT threshold,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS fpr FROM cnt)
"""


def sweep_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(spark, preds(spark, sf_dir), "target_1", "p_malicious")


@register("score_threshold_sweep", SWEEP_SQL + "SELECT * FROM sweep", ops=("M23",))
def score_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 and FPR for thresholds 0.01 ... 0.99 on P(malicious)."""
    return sweep_df(spark, sf_dir)


@register("score_nearest_thresholds", SWEEP_SQL + """
SELECT 'fpr~0.05' AS criterion, arg_min(threshold, (abs(fpr - 0.05), threshold)) AS threshold,
       arg_min(f1, (abs(fpr - 0.05), threshold)) AS f1, arg_min(fpr, (abs(fpr - 0.05), threshold)) AS fpr
FROM sweep
UNION ALL
SELECT 'f1~0.8', arg_min(threshold, (abs(f1 - 0.8), threshold)), arg_min(f1, (abs(f1 - 0.8), threshold)),
       arg_min(fpr, (abs(f1 - 0.8), threshold)) FROM sweep
""", ops=("W4", "M23"))
def score_nearest_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds whose FPR is nearest 0.05 and whose F1 is nearest 0.8."""
    sw = sweep_df(spark, sf_dir)
    return M.nearest_threshold(sw, "fpr", 0.05).unionByName(M.nearest_threshold(sw, "f1", 0.8))


LEGACY_PRED = """(CASE WHEN ceo_fraud = greatest(ceo_fraud, legitimate, phishing, spam) THEN 'malicious'
  WHEN legitimate = greatest(ceo_fraud, legitimate, phishing, spam) THEN 'benign'
  WHEN phishing = greatest(ceo_fraud, legitimate, phishing, spam) THEN 'malicious' ELSE 'benign' END)"""


def legacy_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = FX.legacy_scores(spark, FX.emails(spark, sf_dir))
    return lg.withColumn("pred", M.legacy_argmax("ceo_fraud", "legitimate", "phishing", "spam")) \
        .withColumnRenamed("label", "target_1")


@register("legacy_scorer_metrics", SCORES + f"""
, lp AS (SELECT path, label AS target_1, {LEGACY_PRED} AS pred FROM legacy_scores)
""" + _duck_metrics(_duck_cells("lp")), ops=("M25", "M20", "IO6"))
def legacy_scorer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy four-class scorer: argmax -> benign/malicious -> metrics."""
    return M.model_metrics(legacy_preds(spark, sf_dir), "target_1", "pred")


@register("model_comparison", PQ.SPLIT_SQL + f"""
, sc AS (SELECT path, CASE WHEN mal = 1 THEN 'malicious' ELSE 'benign' END AS target_1,
               ((length(text_plain) * 37 + mal * 11) % 101) / CAST(100 AS DOUBLE) AS p_malicious,
               length(text_plain) AS n FROM emails),
rows AS (
  SELECT 'stack' AS model, s.split AS dataset, sc.target_1,
         CASE WHEN 1.0 - sc.p_malicious > 0.7 THEN 'benign' ELSE 'malicious' END AS pred
  FROM split s JOIN sc ON sc.path = s.path
  UNION ALL
  SELECT 'legacy', s.split, sc.target_1,
         CASE WHEN n % 4 = greatest(n % 4, n % 3, n % 5, n % 2) THEN 'malicious'
              WHEN n % 3 = greatest(n % 4, n % 3, n % 5, n % 2) THEN 'benign'
              WHEN n % 5 = greatest(n % 4, n % 3, n % 5, n % 2) THEN 'malicious' ELSE 'benign' END
  FROM split s JOIN sc ON sc.path = s.path WHERE s.split = 'test')
""" + _duck_metrics(_duck_cells("rows", "model, dataset"), by="model, dataset"), ops=("M26", "D1", "J8"))
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics table model x data set: the scored model on train and test,
    the legacy scorer on test (inner joins on path)."""
    split = PQ.split_df(spark, sf_dir).select("path", F.col("split").alias("dataset"))
    st = preds(spark, sf_dir).select("path", "target_1", "pred").withColumn("model", F.lit("stack"))
    lg = (legacy_preds(spark, sf_dir).select("path", "target_1", "pred")
          .withColumn("model", F.lit("legacy")))
    rows = (st.join(split, "path").unionByName(
        lg.join(split.filter(F.col("dataset") == "test"), "path")))
    return M.model_metrics(rows, "target_1", "pred", by=["model", "dataset"])


@register("score_outcomes", SCORES + """
SELECT path, target_1, pred, target_1 = 'malicious' AND pred = 'malicious' AS is_tp,
  target_1 <> 'malicious' AND pred <> 'malicious' AS is_tn,
  target_1 <> 'malicious' AND pred = 'malicious' AS is_fp,
  target_1 = 'malicious' AND pred <> 'malicious' AS is_fn FROM preds
""", ops=("M27",))
def score_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-mail TP/TN/FP/FN flags (malicious = positive)."""
    return M.outcome_flags(preds(spark, sf_dir).select("path", "target_1", "pred"),
                           "target_1", "pred")


@register("soft_vote_scores", SCORES + """
SELECT s.path, round((s.p_malicious + CASE WHEN l.ceo_fraud + l.legitimate + l.phishing + l.spam > 0
    THEN (l.ceo_fraud + l.phishing) / (l.ceo_fraud + l.legitimate + l.phishing + l.spam) END) / 2.0, 6) AS p_vote
FROM scores s JOIN legacy_scores l ON l.path = s.path
""", ops=("M12", "J3"))
def soft_vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft vote: mean of P(malicious) and the legacy scorer's malicious share."""
    mails = FX.emails(spark, sf_dir)
    sc = FX.scores(spark, mails)
    lg = FX.legacy_scores(spark, mails)
    tot = F.col("ceo_fraud") + F.col("legitimate") + F.col("phishing") + F.col("spam")
    share = F.when(tot > 0, (F.col("ceo_fraud") + F.col("phishing")) / tot)
    return sc.join(lg, "path").select("path", F.round(M.soft_vote("p_malicious", share), 6)
                                      .alias("p_vote"))


def fold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir)
    folds = SM.kfold(p, ["target_1"], 5, "path")
    return M.model_metrics(folds, "target_1", "pred", by=["fold"])


FOLD_SQL = SCORES + PQ._duck_quota_sample("preds", ["target_1"], "path", "0", flag="_unused").split(
    ", c2 AS")[0] + """
, offs AS (SELECT target_1, _bucket, coalesce(sum(_cell_n) OVER (PARTITION BY target_1 ORDER BY _bucket
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset FROM cells),
folds AS (SELECT qc.*, CAST((row_number() OVER (PARTITION BY qc.target_1, qc._bucket ORDER BY qc._h, qc.path)
                 - 1 + o._offset) % 5 AS INT) AS fold
          FROM qc JOIN offs o ON o.target_1 = qc.target_1 AND o._bucket = qc._bucket)
"""


@register("fold_assignment_counts", FOLD_SQL + """
SELECT fold, target_1, count(*) AS n FROM folds GROUP BY ALL
""", ops=("D11",))
def fold_assignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 5-fold assignment: mails per (fold, class)."""
    folds = SM.kfold(preds(spark, sf_dir), ["target_1"], 5, "path")
    return folds.groupBy("fold", "target_1").agg(F.count(F.lit(1)).alias("n"))


@register("score_cv_summary", FOLD_SQL + ", per_fold AS (" + _duck_metrics(
    _duck_cells("folds", "fold"), by="fold") + """)
SELECT round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std,
       round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std
FROM per_fold
""", ops=("M13", "D11"))
def score_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and std of the benign F1 and recall over 5 stratified folds."""
    out = M.cv_summary(fold_f1(spark, sf_dir), ["f1", "recall"])
    return out.select("f1_mean", "f1_std", "recall_mean", "recall_std")
