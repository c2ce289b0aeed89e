"""Oversampling of the rarer class on exact nearest neighbours.

Every choice comes from MD5 over the row's id and the number of the new row,
so results repeat on any cluster and SQL can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailguard.operators.neighbours import k_nearest, vectors
from mailguard.operators.ranking import positions
from mailguard.session import materialise


def hash32(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _sides(df: DataFrame, label: str, minority: object, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Materialised ``id, v`` of the minority and of the other labelled rows; one row per id."""
    def side(rows: DataFrame) -> DataFrame:
        return materialise(vectors(rows, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")))
    is_rare = F.col(label) == F.lit(minority)
    return side(df.where(is_rare)), side(df.where(~is_rare))


def _new_rows(rare: DataFrame, quotas: DataFrame, k: int) -> DataFrame:
    """``base_id, step, neighbour_id, u, vector``: ``quota`` points of each row's own, each on the way to one of its ``k``
    nearest rows of the minority; a row without neighbours is repeated as it is."""
    near = (k_nearest(rare, rare, k, "id", "v").groupBy("id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour_id"))).alias("near")))
    steps = (quotas.where("quota > 0").join(rare, "id").join(near, "id", "left")
             .withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota")))))
    pick = F.pmod(hash32(F.col("id"), F.col("step"), F.lit("n")), F.size("near")).cast("int")
    picked = steps.select("id", "step", "v", F.when(F.size("near") > 0, F.get("near", pick)["neighbour_id"]).alias("neighbour_id"),
                          (hash32(F.col("id"), F.col("step"), F.lit("u")) / F.lit(float(1 << 32))).alias("u"))
    there = rare.select(F.col("id").alias("neighbour_id"), F.col("v").alias("w"))
    return picked.join(there, "neighbour_id", "left").select(
        F.col("id").alias("base_id"), "step", "neighbour_id", "u",
        F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + F.col("u") * (y - x))).alias("vector"))


def _order(*first: Column) -> list[Column]:
    return [*first, F.md5(F.col("id").cast("string").cast("binary")), F.col("id")]


def smote(df: DataFrame, label: str, minority: object, k: int = 5, ratio: float = 1.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``base_id, step, neighbour_id, u, vector``: new rows that raise the minority to ``ratio`` times the majority.

    Exactly ``round(ratio * majority) - minority`` rows (none below 0), dealt
    evenly, the remainder by the hash of the id.  Rows without a label or with
    an unusable vector (null, or null or non-finite components) take no part.
    An empty minority gives no rows.
    """
    rare, rest = _sides(df, label, minority, id_col, vector_col)
    m = rare.count()
    n = max(0, round(ratio * rest.count()) - m) if m else 0
    quotas = positions(rare.select("id"), _order(), "at").select(
        "id", (F.lit(n // max(m, 1)) + (F.col("at") <= n % max(m, 1)).cast("int")).cast("long").alias("quota"))
    return _new_rows(rare, quotas, k)


def adasyn_quotas(df: DataFrame, label: str, minority: object, k: int = 5, ratio: float = 1.0, id_col: str = "vec_id",
                  vector_col: str = "embedding") -> DataFrame:
    """``id, n_majority, quota``: how many new rows D10 makes of each minority row.

    ``n_majority`` of a row's ``k`` nearest rows of both classes belong to the
    majority; the ``round(ratio * majority) - minority`` new rows are dealt in
    proportion to it by largest remainder, ties by the hash of the id.  Where
    no row has such a neighbour there are none.
    """
    rare, rest = _sides(df, label, minority, id_col, vector_col)
    every = rare.withColumn("other", F.lit(0)).unionByName(rest.withColumn("other", F.lit(1)))
    near = k_nearest(every, rare, k, "id", "v").join(every.select(F.col("id").alias("neighbour_id"), "other"), "neighbour_id")
    dense = materialise(near.groupBy("id").agg(F.sum("other").alias("n_majority")))
    total = dense.agg(F.sum("n_majority")).first()[0] or 0
    n = max(0, round(ratio * rest.count()) - rare.count()) if total else 0
    share = dense.withColumn("part", F.col("n_majority") * F.lit(n))
    total = max(total, 1)
    share = share.withColumn("base", F.floor(F.col("part") / total)).withColumn("over", F.col("part") % total)
    left = n - (share.agg(F.sum("base")).first()[0] or 0)
    return positions(share, _order(F.col("over").desc()), "at").select(
        "id", "n_majority", (F.col("base") + (F.col("at") <= left).cast("int")).cast("long").alias("quota"))


def adasyn(df: DataFrame, label: str, minority: object, k: int = 5, ratio: float = 1.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """New rows as those of ``smote``, more of them where the majority is near (see ``adasyn_quotas``)."""
    rare, _ = _sides(df, label, minority, id_col, vector_col)
    return _new_rows(rare, materialise(adasyn_quotas(df, label, minority, k, ratio, id_col, vector_col)), k)
