"""Corpus pipeline: toxicity, SimHash near-duplicates, repeated passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``docs``, columns
beyond those of ``documents`` among them, whatever their names.  Each calls one
operator of ``mailguard.llm`` and acts on what it finds:

1. ``toxicity`` drops documents that score 0.5 or more;
2. ``simhash`` keeps the document of the smallest id of every group;
3. ``suffix`` removes the bytes of repeated 200-byte strings from the texts;
4. ``pii`` replaces personal data by the kind in angle brackets;
5. ``packing`` returns the pieces of the sequences, with their token ids.

Null text stays null until ``suffix``, which makes it empty; documents that
lose their whole text stay, with an empty one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm import packing, pii, simhash, suffix_dedup, toxicity
from mailguard.llm.common import cut, table
from mailguard.llm.entry import tokenizer_path
from mailguard.llm.labelled import fold

ORACLE_SQL = None    # a network, a fixpoint over links and a tokenizer are not SQL

_FAR = 1 << 62       # stand-in ids of rows without one lie above all others


def _with_text(docs: DataFrame, carried: str, text: Column) -> DataFrame:
    """The columns of ``docs`` out of the struct ``carried``, with a new ``text`` and its ``n_chars``."""
    names = [f.name for f in docs.schema[carried].dataType.fields]
    rows = docs.withColumn("new_text", text)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return rows.select(*(new.get(n, F.col(carried)[n]).alias(n) for n in names))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the operator's toxicity threshold of 0.5; the network learns from ``labels``."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=fold("doc_id", 5) != 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = toxicity.score_documents(rows, net, id_col="row")
    return scored.where("score < 0.5").select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of SimHash near-duplicates.

    A row without an id gets a stand-in made from its text, above all ids, so
    it stays only in groups without ids.  Rows of one id and one text count
    once; different texts of one id stay or go together.
    """
    own = F.xxhash64("text").bitwiseAND(F.lit(_FAR - 1)).bitwiseOR(F.lit(_FAR))
    rows = docs.select(F.coalesce(F.col("doc_id"), own).alias("key"), F.struct(*docs.columns).alias("row"))
    groups = simhash.near_duplicates(rows.select("key", F.col("row.text").alias("text")), shingle=3, distance=3, id_col="key")
    keep = groups.where(F.col("key") == F.col("component_id")).select("key").distinct()
    return (rows.join(keep, "key", "left_semi").withColumn("text_hash", F.xxhash64("row.text"))
            .dropDuplicates(["key", "text_hash"]).select("row.*"))


def _whole_characters(kept: pd.Series) -> pd.Series:
    """Text of the bytes; parts of characters whose other bytes were removed go too."""
    return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start more than once in the corpus."""
    out = suffix_dedup.remove_repeats(docs, threshold=200, carry=[c for c in docs.columns if c != "text"])
    text = F.pandas_udf(_whole_characters, T.StringType())
    rows = out.withColumn("carried", F.col("carried").withField("text", F.lit(None).cast("string")))
    return _with_text(rows, "carried", text("kept")).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    rest = [F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    found = pii.find_documents(docs.select(F.struct(*rest).alias("row"), "text"), id_col="row")
    return _with_text(found, "row", F.col("redacted"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of at most 2048 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix", suffix_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
