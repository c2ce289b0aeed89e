"""Lines that many documents share (operator 11), all in DataFrame functions.

Documents are split into lines and exploded; a line's key is hashed to 128
bits.  Counting goes by (hash, document) first and by hash after it, so a line
that every document holds is combined before each shuffle.  The positions that
a document loses come back to it as one list, and the text is put together
again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailguard.llm.common import cut
from mailguard.operators.joins import weighted_lookup

# The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Line without blanks at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)      # lower() is far quicker than translate()
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def remove_repeats(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: texts without the lines that at least ``min_docs`` documents hold.

    Keys of ``min_chars`` code points or more count; each stays in all its
    lines of the largest id that holds it.  Null and empty texts are one empty
    line.  Every row of ``docs`` comes back: rows that share an id count as
    one document and keep or lose a key together.  Rows without an id count as
    one document, below all ids.  An empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Hashes of the long lines are stored: they are read three times, and splitting the texts is most of the work.
    lines = cut(rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
             .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), F.col("key")).alias("h2")))
    shared = cut(lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("rows"))
                 .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner"), F.sum("rows").alias("rows"))
                 .where(F.col("docs") >= min_docs).drop("docs"))
    lost = (weighted_lookup(lines, shared, ["h1", "h2"], "rows").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
            .groupBy(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th")).agg(F.collect_set("pos").alias("gone")))
    rows = rows.withColumn("th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th"))
    every = rows.join(lost, same, "left").select("doc_id", F.split("text", "\n").alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return every.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                        F.array_join(kept, "\n").alias("kept"))
