"""Streaming queries (R4 score on arrival, R5 windowed monitoring counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.operators import features as FE
from mailguard.operators import models as ML
from mailguard.plans import model_queries as MQ
from mailguard.plans.registry import register
from mailguard.sources import files as IO
from mailguard.sources import fixtures as FX
from mailguard.sources import mime as MM
from mailguard.sources.tables import table_path
from mailguard.streaming import jobs as S


@register("event_window_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
FROM events GROUP BY ALL
""", ops=("R5",))
def event_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts per type computed by a watermarked streaming
    aggregation over the events files (run to completion, update mode)."""
    path = table_path(sf_dir, "events")
    schema = spark.read.parquet(path).schema
    stream = S.event_stream(spark, S.table_glob(path), schema)
    agg = S.windowed_counts(stream, "ts", "event_type", "1 hour", "2 hours")
    out = IO.scratch_path(spark, "event-counts")
    S.run_update_to_folder(agg, out, IO.scratch_path(spark, "event-counts-ckpt"))
    latest = S.latest_counts(spark, out, ["w", "event_type"])
    return latest.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                         "event_type", "n")


@register("stream_scoring", ops=("R4", "R1", "R2", "R3", "IO4"))
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails arriving as files are scored by a streaming query that runs the
    batch feature plan and a model fitted on the training split."""
    data = MQ.training_frame(spark, sf_dir, "body_nontext")
    model = ML.pipeline_for("body_nontext", "logistic").fit(data.filter(F.col("split") == "train"))
    mails = FX.emails(spark, sf_dir)
    arrivals = IO.scratch_path(spark, "arrivals")
    mails.repartition(max(4, spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(arrivals)
    incoming = S.event_stream(spark, arrivals, mails.schema)
    scored = S.score_stream(spark, incoming, model, "body_nontext", "logistic",
                            FX.domain_ns(spark, mails), FX.grammar_matches(spark, mails),
                            FX.lang_segments(spark, mails))
    out = IO.scratch_path(spark, "scored")
    S.run_append_to_parquet(scored, out, IO.scratch_path(spark, "scored-ckpt"))
    return spark.read.parquet(out)


# A mail whose sender name decodes to a line break, which no address may hold.
BROKEN_MAIL = (b"From: =?utf-8?q?a=0Ab?= <x@example.org>\r\nTo: y@example.org\r\nSubject: s\r\n\r\nbody\r\n")
BROKEN_PATH = "/data/dataset/Spearphishing/broken/0_message.eml"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    path = IO.scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fitted_stack(spark: SparkSession, sf_dir: str, base: str = "logistic") -> tuple:
    """Base models of all families and the final model, on the training split."""
    train = MQ.training_frame(spark, sf_dir).where(F.col("split") == "train")
    _, bases, final = ML.oof_stack(train, base=base, final="logistic", k=3)
    return bases, final


@register("mail_file_stream", FX.duck_emails_cte() + f"""
SELECT path, true AS scored, false AS failed FROM emails
UNION ALL SELECT '{BROKEN_PATH}', false, true
""", ops=("R4", "R3", "R1", "R2", "IO5", "M10"))
def mail_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails arriving as .eml files, one of them broken, through parser, feature
    plan and the stack of all families: whether each has a probability that
    adds up to 1, or an error."""
    stack = fitted_stack(spark, sf_dir)
    mails = FX.emails(spark, sf_dir)
    lookups = (stored(FX.domain_ns(spark, mails), "domain-ns"), stored(FX.grammar_matches(spark, mails), "grammar"),
               stored(FX.lang_segments(spark, mails), "segments"))
    root = IO.scratch_path(spark, "mail-arrivals")
    MM.write_messages(mails, root)
    fs, base = MM.shared_fs(root)
    fs.create_dir((base + BROKEN_PATH).rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(base + BROKEN_PATH) as f:
        f.write(BROKEN_MAIL)
    out = IO.scratch_path(spark, "mail-scores")
    S.score_mail_files(spark, root, stack, "logistic", *lookups, out, IO.scratch_path(spark, "mail-scores-ckpt"))
    p = F.col("probability")
    sums = F.abs(p["benign"] + p["malicious"] - 1) < 1e-9
    return spark.read.parquet(out).select(
        F.concat(F.lit("/data/"), F.substring_index("path", "/data/", -1)).alias("path"),
        F.coalesce(sums & p["malicious"].between(0, 1), F.lit(False)).alias("scored"), F.col("_error").isNotNull().alias("failed"))
