"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.session import checkpoint_dir
from mailguard.sources.tables import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain Parquet scan of a driver table."""
    return spark.read.parquet(table_path(sf_dir, name))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in ``spark.checkpoint.dir`` and cut the lineage (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ARROW_BYTES = 4 << 20    # of an Arrow batch sent to a Python worker; a longer row stays whole


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to Arrow batches of at most ``ARROW_BYTES``; a user's own setting stays.

    The default is a number of rows, whose texts can fill many times that on both sides.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if key not in conf.getAll:
        conf.set(key, str(ARROW_BYTES))
    return df


def give_back() -> None:
    """Return freed memory of this worker to the system: idle workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: dict[str, tuple[object, object]] = {}    # of this worker process: owner -> (key, value)


def hold(owner: str, key: object, make: Callable[[], object]) -> object:
    """Value of ``make()``, kept in this worker for later tasks of ``owner`` with the same key."""
    if owner not in _held or _held[owner][0] != key:
        _held.clear()
        _held[owner] = (key, make())
        give_back()
    return _held[owner][1]


def release(keep: str | None = None) -> None:
    """Drop what operators but ``keep`` hold in this worker: workers are used again by other operators' tasks."""
    others = [o for o in _held if o != keep]
    for o in others:
        del _held[o]
    if others:
        gc.collect()
    give_back()


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``text`` holds at most about ``max_bytes`` bytes.

    A single longer text stays whole, in a slice of its own.  What operators
    other than ``owner`` hold in the worker is dropped first; freed memory goes
    back to the system after the last slice.
    """
    release(owner)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list by min-label star contraction.

    ``edges`` has the long columns ``a`` and ``b``; self-loops and repeats are
    allowed.  Returns one row (``node``, ``component``) per node that has an
    edge; ``component`` is the smallest node id reachable.

    Every round links each node's larger neighbours (large star) and then its
    smaller ones (small star) to the smallest id seen; rounds are logarithmic
    in practice.  Each round is checkpointed; the stop test compares two
    aggregated numbers, never rows.  Nothing of the graph reaches the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.*").where("u <> v").distinct())
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.union(roots)

