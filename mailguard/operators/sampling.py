"""Exact, deterministic splits, samples and folds.

Rows are ordered by ``md5(key || seed)`` (hex), an order any engine can
reproduce.  To stay parallel when one stratum holds a large share of the
rows, every stratum is cut into hash buckets: ranks are taken inside
(stratum, bucket) cells, and each stratum's quota is handed out to its
buckets by largest remainder, so the total per stratum is exact while no
single task sees a whole stratum.  The per-cell count table has
strata x buckets rows whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 64


def order_key(key, seed: str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(seed)))


def bucket_of(hkey: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(hkey, 1, 8), 16, 10).cast("long"), F.lit(buckets))


CELL = ["_stratum", "_bucket"]


def _largest_remainder(cells: DataFrame, quota_col: str) -> DataFrame:
    """Split each stratum's integer quota over its cells in proportion to
    cell size: floor shares plus one extra for the largest remainders
    (ties -> lower bucket)."""
    w = Window.partitionBy("_stratum")
    share = F.col(quota_col) * F.col("_cell_n") / F.col("_stratum_n")
    c = (cells.withColumn("_stratum_n", F.sum("_cell_n").over(w))
         .withColumn("_floor", F.floor(share))
         .withColumn("_rem", share - F.col("_floor")))
    rank_w = Window.partitionBy("_stratum").orderBy(F.col("_rem").desc(), F.col("_bucket"))
    c = c.withColumn("_left", F.col(quota_col) - F.sum("_floor").over(w))
    return c.withColumn("_cell_quota",
                        (F.col("_floor") + F.when(F.row_number().over(rank_w) <= F.col("_left"), 1)
                         .otherwise(0)).cast("long"))


def _stratum(strata: list[str]) -> Column:
    """The strata columns as one struct key: never null itself and equal to
    itself in joins when a field is null, so null strata are strata too."""
    return F.struct(F.lit(0).alias("_all"), *[F.col(c) for c in strata])


def _cells(df: DataFrame, strata: list[str], key: str, seed: str, buckets: int) -> DataFrame:
    """``df`` with its stratum, hash key and bucket (rows without a key: bucket 0)."""
    return (df.withColumn("_stratum", _stratum(strata))
            .withColumn("_h", order_key(key, seed))
            .withColumn("_bucket", F.coalesce(bucket_of(F.col("_h"), buckets), F.lit(0))))


def _rank_in_cell(key: str) -> Column:
    return F.row_number().over(Window.partitionBy(*CELL).orderBy("_h", key))


def quota_sample(df: DataFrame, strata: list[str], quota: Column, key: str, seed: str = "42",
                 buckets: int = DEFAULT_BUCKETS, flag: str = "_selected") -> DataFrame:
    """Flag exactly ``quota`` rows per stratum (``quota`` is an expression of
    ``_stratum_n``, the stratum size).  Returns ``df`` plus a boolean ``flag``.

    The allocation is joined on the key the ranking window partitions by, so
    the rows are shuffled once; AQE broadcasts it only at a measured size."""
    cells_df = _cells(df, strata, key, seed, buckets)
    counts = cells_df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_cell_n"))
    sw = Window.partitionBy("_stratum")
    counts = counts.withColumn("_stratum_n", F.sum("_cell_n").over(sw)).withColumn("_quota", quota)
    alloc = _largest_remainder(counts.drop("_stratum_n"), "_quota").select(*CELL, "_cell_quota")
    out = (cells_df.join(alloc, CELL, "left")
           .withColumn(flag, _rank_in_cell(key) <= F.coalesce("_cell_quota", F.lit(0))))
    return out.drop("_h", *CELL, "_cell_quota")


def stratified_split(df: DataFrame, strata: list[str], test_size: float, key: str,
                     seed: str = "42", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add ``split`` in {train, test}; test gets round(test_size * n) rows
    of every stratum (HALF_UP), all the rest go to train."""
    q = F.round(F.lit(test_size) * F.col("_stratum_n")).cast("long")
    out = quota_sample(df, strata, q, key, seed, buckets, "_test")
    return out.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def stratified_sample_n(df: DataFrame, strata: list[str], n: int, key: str, seed: str = "42",
                        buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Flag exactly ``n`` rows overall (``_selected``), allocated to strata
    by largest remainder of ``n * n_s / N`` (ties -> stratum order), then to
    buckets likewise."""
    st = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n_s"))
    # One row per stratum: the single-partition windows below see a tiny table.
    tot = Window.partitionBy()
    share = F.lit(n) * F.col("_n_s") / F.sum("_n_s").over(tot)
    st = (st.withColumn("_floor", F.floor(share)).withColumn("_rem", share - F.col("_floor"))
          .withColumn("_left", F.lit(n) - F.sum("_floor").over(tot)))
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), *[F.col(c) for c in strata])
    st = st.withColumn("_stratum_quota", (F.col("_floor") + F.when(
        F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)).cast("long"))
    quotas = st.select(_stratum(strata).alias("_stratum"), "_stratum_quota")
    cells_df = _cells(df, strata, key, seed, buckets)
    counts = (cells_df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_cell_n"))
              .join(quotas, "_stratum"))
    alloc = _largest_remainder(counts, "_stratum_quota").select(*CELL, "_cell_quota")
    out = (cells_df.join(alloc, CELL, "left")
           .withColumn("_selected", _rank_in_cell(key) <= F.coalesce("_cell_quota", F.lit(0))))
    return out.drop("_h", *CELL, "_cell_quota")


def kfold(df: DataFrame, strata: list[str], k: int, key: str, seed: str = "42",
          buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Stratified fold ids 0..k-1 = (rank of the row inside its stratum) mod k.

    The rank inside a stratum is the rank inside its bucket plus the sizes of
    the stratum's earlier buckets, so it is exact without a stratum-wide window.
    """
    cells_df = _cells(df, strata, key, seed, buckets)
    counts = cells_df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_cell_n"))
    ow = (Window.partitionBy("_stratum").orderBy("_bucket")
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*CELL, F.coalesce(F.sum("_cell_n").over(ow), F.lit(0)).alias("_offset"))
    out = (cells_df.join(offsets, CELL, "left")
           .withColumn("fold", F.pmod(_rank_in_cell(key) - 1 + F.col("_offset"), F.lit(k))
                       .cast("int")))
    return out.drop("_h", *CELL, "_offset")


def per_group_sample(df: DataFrame, group: str, n: int, key: str, seed: str = "42",
                     buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """At most ``n`` rows per group (the first ``n`` in hash order)."""
    q = F.least(F.lit(n), F.col("_stratum_n")).cast("long")
    return quota_sample(df, [group], q, key, seed, buckets, "_keep").filter("_keep").drop("_keep")


def simple_sample(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """``n`` rows in hash order (a distributed top-k, not a global sort)."""
    return df.withColumn("_h", order_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")
