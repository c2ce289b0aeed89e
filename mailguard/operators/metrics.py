"""Classification metrics as aggregates.

Every metric is one pass over (label, prediction) rows.  Threshold sweeps
and ROC-AUC take running sums over per-score counts (one row per distinct
score), range by range, so continuous scores do not meet in one task and no
threshold x row product is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.operators.ranking import running

CLASSES = ("benign", "malicious")


def decide(p_benign, threshold: float = 0.7) -> Column:
    """Benign iff P(benign) > threshold, else malicious."""
    p = F.col(p_benign) if isinstance(p_benign, str) else p_benign
    return F.when(p > F.lit(threshold), F.lit("benign")).otherwise(F.lit("malicious"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """The four cells of the 2x2 confusion matrix (explicit names)."""
    by = by or []
    cells = []
    for t in CLASSES:
        for p in CLASSES:
            cells.append(F.count_if((F.col(y) == t) & (F.col(pred) == p)).alias(f"{t}_as_{p}"))
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class; zero division -> 0."""
    cm = confusion(df, y, pred)
    rows = []
    for c in CLASSES:
        o = [x for x in CLASSES if x != c][0]
        tp, fn = F.col(f"{c}_as_{c}"), F.col(f"{c}_as_{o}")
        fp = F.col(f"{o}_as_{c}")
        prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
        rows.append(F.struct(F.lit(c).alias("class"), F.round(prec, 6).alias("precision"),
                             F.round(rec, 6).alias("recall"),
                             F.round(_div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
                             (tp + fn).cast("long").alias("support")))
    return cm.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def model_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None,
                  positive: str = "benign") -> DataFrame:
    """Precision, recall, F1 of ``positive`` plus the false-malicious
    rate (benign mail flagged malicious) and false-benign rate (malicious
    mail passed as benign)."""
    by = by or []
    other = [c for c in CLASSES if c != positive][0]
    cm = confusion(df, y, pred, by)
    tp, fn = F.col(f"{positive}_as_{positive}"), F.col(f"{positive}_as_{other}")
    fp = F.col(f"{other}_as_{positive}")
    bb, bm = F.col("benign_as_benign"), F.col("benign_as_malicious")
    mb, mm = F.col("malicious_as_benign"), F.col("malicious_as_malicious")
    return cm.select(
        *by,
        F.round(_div(tp, tp + fp), 6).alias("precision"),
        F.round(_div(tp, tp + fn), 6).alias("recall"),
        F.round(_div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        (tp + fn).cast("long").alias("support"),
        F.round(_div(bm, bm + bb), 6).alias("false_malicious_rate"),
        F.round(_div(mb, mb + mm), 6).alias("false_benign_rate"))


def outcome_flags(df: DataFrame, y: str, pred: str, positive: str = "malicious") -> DataFrame:
    """true/false positive/negative flags per row."""
    yp, pp = F.col(y) == positive, F.col(pred) == positive
    return df.select("*", (yp & pp).alias("is_tp"), (~yp & ~pp).alias("is_tn"),
                     (~yp & pp).alias("is_fp"), (yp & ~pp).alias("is_fn"))


def _score_counts(df: DataFrame, y: str, score: str, positive: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(y) == positive).alias("pos"),
        F.count_if(F.col(y) != positive).alias("neg"))


def threshold_sweep(spark: SparkSession, df: DataFrame, y: str, score: str,
                    positive: str = "malicious", steps: int = 99) -> DataFrame:
    """For t = 1/100 ... steps/100 predict positive iff score >= t and
    report F1 and FPR.

    Thresholds are merged into the per-score count table and a cumulative
    sum in descending score order gives, at each threshold row, the
    positives and negatives scoring at or above it.
    """
    counts = _score_counts(df, y, score, positive)
    th = spark.range(1, steps + 1).select((F.col("id") / F.lit(100.0)).alias("s"),
                                          F.lit(0).cast("long").alias("pos"),
                                          F.lit(0).cast("long").alias("neg"),
                                          F.lit(1).alias("_is_t"))
    events = counts.withColumn("_is_t", F.lit(0)).unionByName(th)
    upto = running(events, [F.col("s").desc(), F.col("_is_t")], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    cum = upto.filter(F.col("_is_t") == 1).withColumn("P", F.lit(total["P"])).withColumn("N", F.lit(total["N"]))
    fn = F.col("P") - F.col("tp")
    tn = F.col("N") - F.col("fp")
    return cum.select(
        F.col("s").alias("threshold"),
        F.round(_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn), 6).alias("f1"),
        F.round(_div(F.col("fp"), F.col("fp") + tn), 6).alias("fpr"))


def roc_auc(df: DataFrame, y: str, score: str, positive: str = "malicious") -> DataFrame:
    """ROC-AUC = P(score_pos > score_neg) + 0.5 P(tie) (Mann-Whitney),
    from per-score counts with a cumulative window over distinct scores."""
    counts = _score_counts(df, y, score, positive)
    c = running(counts, [F.col("s")], {"neg_upto": F.col("neg")}).withColumn("neg_below", F.col("neg_upto") - F.col("neg"))
    return c.agg(F.round((F.sum(F.col("pos") * F.col("neg_below") + 0.5 * F.col("pos") * F.col("neg"))
                          / (F.sum("pos") * F.sum("neg"))), 6).alias("roc_auc"))


def nearest_threshold(sweep: DataFrame, col: str, target: float) -> DataFrame:
    """Sweep row whose ``col`` is nearest ``target`` (ties -> lowest threshold)."""
    key = F.struct(F.abs(F.col(col) - F.lit(target)), F.col("threshold"))
    return sweep.agg(F.min_by(F.struct("threshold", "f1", "fpr"), key).alias("r")).select(
        F.lit(f"{col}~{target}").alias("criterion"), "r.*")


def legacy_argmax(ceo_fraud, legitimate, phishing, spam) -> Column:
    """Class of the largest of four scores (first column wins ties),
    mapped to benign (legitimate, spam) or malicious (ceo_fraud, phishing)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (ceo_fraud, legitimate, phishing, spam)]
    top = F.greatest(*cols)
    return (F.when(cols[0] == top, "malicious").when(cols[1] == top, "benign")
            .when(cols[2] == top, "malicious").otherwise("benign"))


def soft_vote(*probs) -> Column:
    """Mean of the members' probabilities."""
    cols = [F.col(p) if isinstance(p, str) else p for p in probs]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def cv_summary(fold_scores: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std of per-fold scores, and the ``mean (+/- std)`` text."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std")]
    out = fold_scores.agg(*aggs)
    return out.select("*", *[F.format_string("%.3f (+/- %.3f)", F.col(f"{c}_mean"), F.col(f"{c}_std"))
                             .alias(f"{c}_text") for c in cols])
