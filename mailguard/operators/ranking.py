"""Ranks, running sums and exact quantiles over a total order, without a one-task window.

Rows are range partitioned by the order and the sums of each range are added
up (one row per partition); a window inside each range does the rest.  Rows
that are equal in the whole order share a range, so add a key to spread ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailguard.session import materialise


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` plus, per ``name -> value`` of ``sums``, the sum of ``value`` over all rows up to and with this one.

    Ties of the whole order get some order among themselves.  Null values add
    nothing.  An empty frame stays empty.
    """
    parts = materialise(df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
                        .repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
               .select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = parts.join(F.broadcast(offsets), "_part")      # one row per partition
    return every.select(*df.columns, *[(F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` plus the 1-based place of each row in the total order."""
    return running(df, order, {name: F.lit(1).cast("long")})


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group, share, quantile``: exact quantiles per group, linear between neighbours.

    Works on counts per (group, value), so the state of a task is bounded by
    its range of values, however large the group.  Null values are left out; a
    null group is a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    upto = materialise(running(counts, [F.col(group), F.col("_x")], {"_upto": F.col("_n")})
                       .withColumn("_before", F.col("_upto") - F.col("_n")))
    sizes = upto.groupBy(group).agg(F.sum("_n").alias("_size"), F.min("_before").alias("_start"))
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn(
        "_at", F.col("share") * (F.col("_size") - 1))
    asked = wanted.select(F.col(group).alias("_g"), "share", "_at", (F.col("_start") + F.floor("_at")).alias("_lo"),
                          (F.col("_start") + F.ceil("_at")).alias("_hi"))
    hits = (upto.join(asked, F.col(group).eqNullSafe(F.col("_g")))
            .where("(_before <= _lo and _lo < _upto) or (_before <= _hi and _hi < _upto)"))
    low, part = F.min("_x"), F.first(F.col("_at") - F.floor("_at"))
    return hits.groupBy(group, "share").agg((low + (F.max("_x") - low) * part).alias("quantile"))
