"""Structured Streaming jobs.

* R4 -- score on arrival: a file source of incoming mail rows goes through
  the *same* feature plan as the batch job (stream-static joins with the
  lookup tables) and a fitted ``PipelineModel``; results land in a Parquet
  sink with a checkpoint, so a restarted query resumes exactly once.
* R4 with R3 -- mail arriving as ``.eml`` files, listed in tasks into a log
  that is streamed; every micro-batch is parsed once and scored by the function that scores a
  batch, and a mail that cannot be parsed becomes a row with its error.
* R5 -- monitoring: tumbling-window counts per key with a watermark, written
  in update mode through ``foreachBatch``; every micro-batch's updated rows
  are stored under their batch id and the reader keeps the newest value per
  window, which makes re-runs of a batch idempotent.

Both use the cluster's shared checkpoint folder for state and sinks.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.operators import features as FE
from mailguard.operators import models as ML
from mailguard.session import materialise
from mailguard.sources import mime as MM


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour",
                    watermark: str = "2 hours") -> DataFrame:
    """Events per (tumbling window, key); late rows within ``watermark``
    still update their window, older state is dropped.  A zone-less event
    time is read as wall-clock time in the session zone (watermarks need a
    zoned timestamp)."""
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, width).alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n")))


def run_update_to_folder(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an aggregating stream to completion (``availableNow``) in update
    mode; each batch's changed rows are written under ``batch=<id>``
    (overwritten if the batch is replayed)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{out_path}/batch={batch_id}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_counts(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Newest value per key across the stored micro-batches."""
    rows = spark.read.parquet(out_path)
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def event_stream(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source over the files that the glob ``path`` matches or holds.

    Each micro-batch takes all files present.  ``files_per_trigger`` limits it,
    but then the watermark moves between files: only set it where files arrive
    in the order of their event times, or older files are late and dropped."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_glob(path: str) -> str:
    """A glob that matches exactly ``path``.  The file source insists that a
    plain path is a folder; a glob may match one file as well."""
    return f"{path[:-1]}[{path[-1]}]"


def score_stream(spark: SparkSession, incoming: DataFrame, model: PipelineModel, family: str,
                 model_name: str, domain_ns: DataFrame, grammar: DataFrame,
                 segments: DataFrame) -> DataFrame:
    """Streaming mail rows -> metadata -> features (the batch plan) ->
    model -> probability struct.  A mail whose row fails to score gets its
    error text instead of a prediction (R3)."""
    meta = FE.build_metadata(spark, incoming)
    feats = ML.prepare(ML.with_label(FE.feature_table(meta, domain_ns, grammar, segments)))
    scored = model.transform(feats)
    p = ML.malicious_score(scored, family, model_name)
    return scored.select(
        "path", F.struct((1.0 - p).alias("benign"), p.alias("malicious")).alias("probability"),
        F.when(p.isNull(), F.lit("no score")).alias("_error"))


def score_mails(parsed: DataFrame, stack: tuple, base: str, domain_ns: DataFrame, grammar: DataFrame, segments: DataFrame) -> DataFrame:
    """R1 + R2 + R3: ``path, probability, _error`` of parsed mails; one that was not parsed has its error and no
    probability.  ``stack``: the fitted base models and the final model of ``models.oof_stack``."""
    meta = parsed.where("_error is null").select(
        "*", *[F.lit(None).cast("string").alias(f"target_{i}") for i in (1, 2, 3)])
    feats = ML.prepare(FE.feature_table(meta, domain_ns, grammar, segments))
    p = F.col("p_malicious")
    scored = ML.score_stack(feats, *stack, base).select(
        "path", F.struct((1.0 - p).alias("benign"), p.alias("malicious")).alias("probability"), F.lit(None).cast("string").alias("_error"))
    failed = parsed.where("_error is not null").select(
        "path", F.lit(None).cast(scored.schema["probability"].dataType).alias("probability"), "_error")
    return scored.unionByName(failed)


def log_arrivals(spark: SparkSession, root: str, log: str, glob: str) -> None:
    """Add the mail files below ``root`` that the table ``log`` does not name yet; listed and compared in tasks."""
    spark.createDataFrame([], "path string").write.mode("ignore").parquet(log)
    new = materialise(MM.list_files(spark, root, glob).join(spark.read.schema("path string").parquet(log), "path", "left_anti"))
    if not new.isEmpty():
        new.write.mode("append").parquet(log)


def score_mail_files(spark: SparkSession, root: str, stack: tuple, base: str, domain_ns: DataFrame, grammar: DataFrame,
                     segments: DataFrame, out_path: str, checkpoint: str, glob: str = "*.eml") -> None:
    """Score every mail file that has arrived below ``root`` and not been scored yet.

    Tasks list the files into a log beside ``checkpoint``, and the stream reads
    the log: Spark's own file source keeps every mail file's status on the
    driver and lists the folders there.  Runs until all files present are done.
    Each micro-batch is stored under its id, so one that is run again after a
    failure replaces its rows.  The lookups are static frames; pass stored tables.
    """
    log = f"{checkpoint.rstrip('/')}-arrivals"
    log_arrivals(spark, root, log, glob)

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = materialise(MM.parse_messages(MM.read_files(batch, root)).drop("parts", "headers"))
        score_mails(parsed, stack, base, domain_ns, grammar, segments).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    arrived = event_stream(spark, log, T.StructType([T.StructField("path", T.StringType())]))
    q = (arrived.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_append_to_parquet(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
