"""CSV, Parquet and JSON readers/writers.

Intermediate files go to the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.session import checkpoint_dir

EMAIL_LIST_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True)
                                  for c in ("path", "target_1", "target_2", "target_3")])

# Class names used by the legacy scorer's JSON.
LEGACY_CLASSES = ("CEO Fraud", "Legitimate", "Phishing", "Spam")
SCORES_MAP = T.MapType(T.StringType(), T.DoubleType())
LEGACY_OUTPUT_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
    T.StructField("body", SCORES_MAP), T.StructField("subject", SCORES_MAP)])))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_email_list(df: DataFrame, path: str) -> None:
    """IO3: CSV with header; standard quoting so paths may hold commas/quotes."""
    (df.select(*[f.name for f in EMAIL_LIST_SCHEMA.fields]).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').csv(path))


def read_email_list(spark: SparkSession, path: str) -> DataFrame:
    """IO3: the e-mail list with a fixed schema (no inference)."""
    return (spark.read.schema(EMAIL_LIST_SCHEMA).option("header", True)
            .option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """IO4: Parquet, optionally partitioned (e.g. by target_1 for big tables)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """IO8: small result tables as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scorer_input(df: DataFrame, path: str) -> None:
    """IO7: legacy scorer input, nested label -> path -> {subjects, bodies}.

    Written as JSON Lines, one object of that nested shape per message, so no
    label's mails are ever gathered into one record; ``read_scorer_*`` and
    any JSON merger treat the lines as one mapping.
    """
    rec = F.create_map(F.col("label"), F.create_map(F.col("path"), F.struct(
        F.array(F.col("subject")).alias("subjects"), F.array(F.col("body")).alias("bodies"))))
    df.select(F.to_json(rec).alias("value")).write.mode("overwrite").text(path)


def write_scorer_output(df: DataFrame, path: str) -> None:
    """Scorer output in the legacy shape (label -> path -> {body, subject}
    class-score maps), one JSON line per message; zero scores are omitted as
    the scorer does for classes it did not report."""
    def scores(prefix: str):
        m = F.map_from_arrays(F.array(*[F.lit(c) for c in LEGACY_CLASSES]),
                              F.array(*[F.col(f"{prefix}_{c.lower().replace(' ', '_')}").cast("double")
                                        for c in LEGACY_CLASSES]))
        return F.map_filter(m, lambda k, v: v != 0)
    rec = F.create_map(F.col("label"), F.create_map(F.col("path"), F.struct(
        scores("body").alias("body"), scores("subject").alias("subject"))))
    df.select(F.to_json(rec).alias("value")).write.mode("overwrite").text(path)


def read_scorer_output(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """IO6: flatten scorer JSON to one row per path with eight class scores
    (a class missing from a map scores 0).  ``whole_file`` reads files that
    hold one big JSON object (one task per file); the default reads JSON Lines."""
    raw = spark.read.text(path, wholetext=whole_file)
    parsed = raw.select(F.from_json("value", LEGACY_OUTPUT_SCHEMA).alias("m"))
    by_label = parsed.select(F.explode("m").alias("label", "mails"))
    rows = by_label.select("label", F.explode("mails").alias("path", "d"))
    cols = []
    for part in ("body", "subject"):
        for c in LEGACY_CLASSES:
            cols.append(F.coalesce(F.col(f"d.{part}")[c], F.lit(0.0))
                        .alias(f"{part}_{c.lower().replace(' ', '_')}"))
    return rows.select("path", "label", *cols)
