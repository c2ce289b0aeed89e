"""Profiles and summaries.

All of them are single-pass aggregates or windows over aggregated (small)
tables.  Windows that need a global order run on per-value counts, never on
raw rows, so their input is bounded by the number of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailguard.operators.joins import weighted_lookup
from mailguard.operators.ranking import exact_quantiles, running
from mailguard.session import materialise


def value_counts(df: DataFrame, col: str, dropna: bool = True, normalize: bool = False) -> DataFrame:
    """A1/A2: rows per value (null kept as its own value unless ``dropna``),
    optionally with the share of all counted rows."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        # one row per distinct value: the global window sees the small table only
        out = out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    return out


def crosstab(df: DataFrame, row: str, col: str, levels: list[str]) -> DataFrame:
    """A3: counts of ``row`` x ``col`` pivoted over fixed ``levels``, missing -> 0."""
    return df.groupBy(row).pivot(col, levels).count().fillna(0, subset=levels)


def row_percent(ct: DataFrame, levels: list[str], suffix: str = "_pct") -> DataFrame:
    """A4: each cell / row total, rounded to 3 places, times 100."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in levels])
    return ct.select("*", *[(F.round(F.col(c) / total, 3) * 100).alias(c + suffix) for c in levels])


def top_n_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """O1: the ``n`` most frequent non-null values (ties -> smaller value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)).limit(n))


def top_n_crosstab(df: DataFrame, key: str, target: str, levels: list[str], n: int) -> DataFrame:
    """A5 + F2: crosstab restricted to the top-``n`` keys (left-semi join)."""
    top = top_n_values(df, key, n).select(key)
    return crosstab(df.join(F.broadcast(top), key, "left_semi"), key, target, levels)


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, distinct values (null counts as one value),
    missing count and missing percent (2 places).

    Values are unpivoted to (column, md5(value)) so one shuffle computes all
    distinct counts; hashing bounds the shuffled bytes for long text columns.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.md5(F.col(c).cast("string")).alias("h")) for c in cols])).alias("kv")
    ).select("kv.column", "kv.h")
    per_col = stacked.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("h").alias("_distinct_non_null"),
        F.count_if(F.col("h").isNull()).alias("n_missing"))
    return per_col.select(
        "column",
        (F.col("_distinct_non_null") + F.when(F.col("n_missing") > 0, 1).otherwise(0))
        .alias("n_unique"),
        "n_missing",
        F.round(F.col("n_missing") / F.col("rows") * 100, 2).alias("missing_pct"))


def all_null_columns(df: DataFrame) -> list[str]:
    """F4 helper: names of columns without a single non-null value (one pass)."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def explode_counts(df: DataFrame, col: str, drop_empty: bool = True) -> DataFrame:
    """A10 + F3: explode an array column and count values; null arrays give a
    null value, which ``drop_empty`` removes together with empty strings."""
    e = df.select(F.explode_outer(col).alias("value"))
    if drop_empty:
        e = e.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return e.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"),
            F.round(F.avg(x), 9).alias("mean"), F.round(F.stddev_samp(x), 9).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    one = df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in cols])).alias("d")).select("d.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
                     .alias("v")).select("v.*")
    return one.join(_quartiles(long, "column", "x", 9, ("p25", "p50", "p75")), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _quartiles(df: DataFrame, group: str, value: str, digits: int, names: tuple[str, str, str]) -> DataFrame:
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75])
    return q.groupBy(group).agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("quantile"))), digits).alias(n)
                                  for s, n in zip((0.25, 0.5, 0.75), names, strict=True)])


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair, one pass."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.round(F.col(f"`{a}|{b}`"), 6).alias("corr")) for a, b in pairs])).alias("p")
    ).select("p.*")


def class_share(df: DataFrame, target: str, category: str) -> DataFrame:
    """Count per (class, category) and its share of the class total."""
    counts = df.groupBy(target, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("class_total", F.sum("n").over(Window.partitionBy(target))) \
        .withColumn("share", F.round(F.col("n") / F.col("class_total"), 6))


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based equal-width bin; the maximum falls in the last bin (numpy rule)."""
    width = (hi - lo) / bins if hi > lo else 1.0
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")


def histogram(df: DataFrame, value: str, group: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Per-group counts in equal-width bins plus density
    (count / (group size * bin width)).  Bounds default to the data range
    (one small aggregate)."""
    if lo is None or hi is None:
        mm = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo = float(mm["lo"]) if lo is None else lo
        hi = float(mm["hi"]) if hi is None else hi
    width = (hi - lo) / bins if hi > lo else 1.0
    b = df.filter(F.col(value).isNotNull()).withColumn("bin", bin_index(F.col(value), lo, hi, bins))
    counts = b.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    return counts.withColumn("density", F.round(F.col("n") / (F.sum("n").over(w) * F.lit(width)), 9)) \
        .withColumn("bin_lo", F.round(F.lit(lo) + (F.col("bin") - 1) * F.lit(width), 9))


def feature_types(df: DataFrame, cols: list[str], numeric: set[str]) -> DataFrame:
    """Binary when 2 distinct values, categorical below 20, else numeric or text."""
    prof = column_profile(df, cols)
    kind = (F.when(F.col("n_unique") == 2, "binary")
            .when(F.col("n_unique") < 20, "categorical")
            .when(F.col("column").isin(*numeric) if numeric else F.lit(False), "numeric")
            .otherwise("text"))
    return prof.select("column", "n_unique", kind.alias("kind"))


def five_numbers(df: DataFrame, value: str, group: str) -> DataFrame:
    """Min, quartiles and max per group (box-plot data)."""
    x = F.col(value).cast("double")
    ends = df.groupBy(group).agg(F.min(x).alias("min"), F.max(x).alias("max"))
    q = _quartiles(df, group, value, 6, ("q1", "median", "q3")).withColumnRenamed(group, "_g")
    return ends.join(q, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "min", "q1", "median", "q3", "max")


def top_label_per_topic(df: DataFrame, topic: str, label: str) -> DataFrame:
    """Per topic prefix (text before the first ``_``), the most frequent
    label (ties -> smaller label) with its count."""
    counts = (df.withColumn("topic_id", F.split(F.col(topic), "_")[0])
              .groupBy("topic_id", label).agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("topic_id").agg(
        F.min_by(F.struct(F.col(label).alias("label"), F.col("n")),
                 F.struct(-F.col("n"), F.col(label))).alias("top")
    ).select("topic_id", "top.label", "top.n")


def conditional_counts(df: DataFrame, group: str, col: str, values: list[str]) -> DataFrame:
    """One ``count_if`` per listed value, per group."""
    return df.groupBy(group).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values])


def rank_desc(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """SQL ``rank()`` by ``value`` descending over the whole frame.

    rank = 1 + rows with a strictly larger value, from running sums over the
    per-value count table, joined back on the value (null ranks last).
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = materialise(running(counts, [F.col(value).desc()], {"_upto": F.col("_n")})
                        .select(F.col(value).alias("_value"), F.col("_n"), (F.col("_upto") - F.col("_n") + 1).cast("long").alias(out)))
    known = weighted_lookup(df.where(F.col(value).isNotNull()), ranks.withColumnRenamed("_value", value).where(F.col(value).isNotNull()),
                            [value], "_n", "left")
    last = ranks.where("_value is null").first()
    if last is None:
        return known
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(last[out]).cast("long")))


def nearest(df: DataFrame, col: str, target: float, cols: list[str]) -> DataFrame:
    """The row whose ``col`` is nearest ``target`` (ties -> first in ``cols`` order)."""
    key = F.struct(F.abs(F.col(col) - F.lit(target)), *[F.col(c) for c in cols])
    return df.agg(F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("r")).select("r.*")


def stack_frames(a: DataFrame, b: DataFrame, tag: str = "part", names=("train", "test")) -> DataFrame:
    """Rows of both frames with a tag column (by column name)."""
    return a.withColumn(tag, F.lit(names[0])).unionByName(
        b.withColumn(tag, F.lit(names[1])), allowMissingColumns=True)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct union."""
    return a.unionByName(b).distinct()
