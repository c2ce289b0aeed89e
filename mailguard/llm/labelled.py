"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, keep: Column, per_class: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, y, weight, taken``: at most ``per_class`` labelled rows of each class, by the hash of their id.

    ``weight`` restores the ratio of the classes among all labelled rows: the
    share of the row's class there over its share among the chosen; 1 where no
    bound cuts.  ``taken`` is the number of rows chosen of the row's class, for
    callers that leave out some of them (see ``restored``).

    Rows whose id or label is null, whose label is neither 0 nor 1, or that
    fail ``keep`` take no part; of repeated labels of one id the smallest
    counts.  The chosen ids are at most ``2 * per_class``, so that side of the
    join with the documents is broadcast.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("y"), keep.alias("keep"))
             .where("keep and id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}     # two rows at most
    held = {y: min(n, per_class) for y, n in counts.items()}
    every, taken = sum(counts.values()), sum(held.values())
    weight, own = F.lit(1.0), F.lit(0)
    for y, n in counts.items():
        own = F.when(F.col("y") == y, F.lit(held[y])).otherwise(own)
        if taken:
            weight = F.when(F.col("y") == y, F.lit(n * taken / (every * held[y]))).otherwise(weight)
    order = F.xxhash64("id")
    chosen = known.where("y = 0").orderBy(order, "id").limit(per_class).union(
        known.where("y = 1").orderBy(order, "id").limit(per_class))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(chosen), "id").select("id", "text", "y", weight.alias("weight"), own.cast("long").alias("taken"))


def restored(y: np.ndarray, weight: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Weights that keep the classes' ratio when only some of the ``taken`` rows of each class are left; 1 on average."""
    left = np.where(y > 0, (y > 0).sum(), (y <= 0).sum())
    out = weight * taken / np.maximum(left, 1)
    return out / out.mean() if len(out) else out
