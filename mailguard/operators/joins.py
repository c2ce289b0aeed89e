"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000    # at most so many keys are broadcast, whatever the size of the tables


def weighted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``lookup``, which has one row per key; ``weight`` says how many rows have that key.

    Keys that hold at least one part in ``HOT_KEYS`` of all weighted rows are
    at most ``HOT_KEYS`` in number and are broadcast, so their rows stay where
    they are.  Every other key holds less than that part and goes by shuffle.
    The result has the columns of both but ``weight``; ``how`` is ``inner`` or
    ``left``.  ``lookup`` should be materialised, as it is read three times.
    Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in lookup.columns if c not in (*keys, weight)]
    is_hot = F.col(weight) * HOT_KEYS >= F.lit(int(total))
    hot = lookup.where(is_hot).select(*keys, F.struct(*rest).alias("_hot"))
    cold = lookup.where(~is_hot).select(*keys, F.struct(*rest).alias("_cold"))
    seen = rows.join(F.broadcast(hot), keys, "left")
    found = seen.where("_hot is not null").select(*rows.columns, "_hot.*")
    missed = seen.where("_hot is null").drop("_hot").join(cold, keys, how)
    return found.unionByName(missed.select(*rows.columns, "_cold.*"))
