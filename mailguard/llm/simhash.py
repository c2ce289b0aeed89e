"""SimHash near-duplicates with pigeonring filtering (operator 7).

A fingerprint has 64 bits in ``m = distance + 1`` segments on a ring.  If two
fingerprints differ in at most ``distance`` bits, then from some segment on,
every chain of ``l`` consecutive segments differs in at most
``l * distance / m`` bits.  So the first segment of the chain is equal and the
first two differ in at most one bit: that pair of segments is the join key,
with one bit of the second segment set where it is clear on the probing side.
Residents of a key are compared with one another and with its probes, never
two probes.  The longer chains are checked next, then the whole Hamming distance.

Buckets give a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailguard.llm.common import connected_components, cut, slices, small_batches

BITS = 64
BROADCAST_KEYS = 100_000   # hot keys (8 bytes and a count each) that may be broadcast; more are joined by shuffle


def fingerprint(text: str, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """SimHash of the word shingles of ``text``; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, block):
        part = words[at:at + block + shingle - 1]
        hashes = np.array([digest(join(x), seed) for x in zip(*(part[i:] for i in range(shingle)), strict=False)],
                          dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) per row; no shuffle."""
    d = small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            fps = np.array([fingerprint(t or "", shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return d.mapInArrow(run, "id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the ``distance + 1`` segments."""
    m = distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(seg: tuple[int, int]) -> int:
    return ((1 << seg[1]) - 1) << seg[0]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def keyed(fps: DataFrame, distance: int, probes: bool) -> DataFrame:
    """Rows ``chain, part, home, fp, rep``: the key's two segments as bits in place; with ``probes`` also
    the keys with one more bit set in the chain's second segment, where the fingerprint is no resident
    (``home`` false)."""
    segs, out = segments(distance), []
    for i, first in enumerate(segs):
        second = segs[(i + 1) % len(segs)]
        own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(first) | _mask(second))))
        out.append(F.struct(F.lit(i).alias("chain"), own.alias("part"), F.lit(True).alias("home")))
        if probes:
            out += [F.when(free, F.struct(F.lit(i).alias("chain"), key.alias("part"), F.lit(False).alias("home")))
                    for free, key in _one_more(own, i, distance)]
    return (fps.select("fp", "rep", F.explode(F.array(*out)).alias("k")).where("k is not null")
            .select("k.chain", "k.part", "k.home", "fp", "rep"))


def _one_more(part: Column, chain: int, distance: int) -> list[tuple[Column, Column]]:
    """(whether the bit is clear, the key with it set) for each bit of the chain's second segment."""
    segs = segments(distance)
    if len(segs) == 1:
        return []
    low, width = segs[(chain + 1) % len(segs)]
    flags = [F.lit(_signed(1 << bit)) for bit in range(low, low + width)]
    return [(part.bitwiseAND(flag) == F.lit(0), part.bitwiseOR(flag)) for flag in flags]


def crowded(fps: DataFrame, distance: int, block: int) -> DataFrame:
    """``chain, part, xs, ys`` of every key that more than ``block`` rows may have, residents or probes:
    the numbers of blocks that hold at most about ``block`` residents and ``block`` rows.

    The probes of a key are the residents of the keys with one bit less.  So a
    key of more than ``block`` rows has a source, itself or one of those, with
    more than its share of them; only such keys are spread to what they probe.
    """
    widest = max(width for _, width in segments(distance))
    share = block // (widest + 1)
    full = (keyed(fps, distance, probes=False).groupBy("chain", "part").agg(F.count("*").alias("n"))
            .where(F.col("n") > share))
    part = F.col("part")
    reached = [F.when(F.col("chain") == i, F.array(
        F.struct(part.alias("part"), F.col("n").alias("own")),
        *[F.when(free, F.struct(key.alias("part"), F.lit(0).cast("long").alias("own")))
          for free, key in _one_more(part, i, distance)])) for i in range(len(segments(distance)))]
    return (full.select("chain", "n", F.explode(F.coalesce(*reached)).alias("k")).where("k is not null")
            .groupBy("chain", "k.part").agg(F.sum("k.own").alias("own"), F.sum("n").alias("n"))
            .select("chain", "part", F.greatest(F.lit(1), F.ceil((F.col("own") + share) / block).cast("int")).alias("xs"),
                    F.ceil((F.col("n") + widest * share) / block).cast("int").alias("ys")))


def forest(fp: np.ndarray, home: np.ndarray, chain: int, distance: int) -> list[tuple[int, int]]:
    """Index pairs that span the links of the residents (``home``) of one bucket with one another and with
    its probes; two probes are never compared, as each pair has a bucket in which one of them resides.

    Breadth first; what has been reached is not compared again, so a bucket of
    near copies costs little more than its size.
    """
    segs = segments(distance)
    m = len(segs)
    masks = [np.uint64(sum(_mask(segs[(chain + j) % m]) for j in range(n))) for n in range(3, m)]
    budgets = [n * distance // m for n in range(3, m)]
    left, edges = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)]), []
    residents = int(home.sum())        # the first of ``left``
    while residents:
        queue, left, residents = [int(left[0])], left[1:], residents - 1
        while queue and len(left):
            at = queue.pop()
            pool = left if home[at] else left[:residents]
            diff = fp[pool] ^ fp[at]
            keep = np.ones(len(pool), bool)
            for mask, budget in zip(masks, budgets, strict=True):
                keep &= np.bitwise_count(diff & mask) <= budget
            near = np.zeros(len(left), bool)
            near[:len(pool)][keep] = np.bitwise_count(diff[keep]) <= distance
            if near.any():
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                residents -= int(near[:residents].sum())
                left = left[~near]
    return edges


def _bucket_edges(distance: int):
    """mapInArrow function over rows sorted by their first columns (the bucket), then ``home, fp, rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def settle(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            *key, home, fp, rep = cols
            new = np.zeros(len(fp), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            new[:1] = True
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fp))
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            a, b = [], []
            done = int(ends[-1]) if len(ends) else 0
            meet = ends - starts > 1
            if done:
                meet &= np.logical_or.reduceat(home[:done], starts)
            for s, e in zip(starts[meet], ends[meet], strict=True):
                u, first, place = np.unique(fp[s:e], return_index=True, return_inverse=True)
                if len(u) > 1:
                    reps, lives = rep[s:e][first], np.zeros(len(u), bool)
                    lives[place[home[s:e]]] = True
                    for x, y in forest(u.view(np.uint64), lives, int(key[0][s]), distance):
                        a.append(reps[x])
                        b.append(reps[y])
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            return [c[done:] for c in cols], out

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[-3] = cols[-3].astype(bool)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) and any(k[0] != k[-1] for k in held[:-3]):
                held, out = settle(held, False)
                if out.num_rows:
                    yield out
        if held is not None and len(held[0]):
            yield settle(held, True)[1]

    return run


def links(fps: DataFrame, distance: int = 3, hot_rows: int = 4096) -> DataFrame:
    """Edges ``a, b`` between representatives whose components are those of all links.

    ``fps``: distinct ``fp`` with its ``rep``.  A key that may have more than
    ``hot_rows`` rows, resident or probing, is dealt out as pairs of a block of
    residents and a block of rows, so no task gets it whole.
    """
    hot = cut(crowded(fps, distance, hot_rows))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    rows = keyed(fps, distance, probes=True)
    run = _bucket_edges(distance)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = (rows.join(hot, ["chain", "part"], "left_anti").repartition(n, "chain", "part")
            .sortWithinPartitions("chain", "part").select("chain", "part", "home", "fp", "rep").mapInArrow(run, "a long, b long"))
    x, y = F.pmod(F.xxhash64("fp"), F.col("xs")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("ys")).cast("int")
    resides = F.transform(F.sequence(F.lit(0), F.col("ys") - 1),
                          lambda j: F.struct(x.alias("x"), j.alias("y"), F.lit(True).alias("home")))
    meets = F.transform(F.sequence(F.lit(0), F.col("xs") - 1),
                        lambda i: F.struct(i.alias("x"), y.alias("y"), F.lit(False).alias("home")))
    warm = (rows.join(hot, ["chain", "part"])
            .select("chain", "part", "fp", "rep", F.explode(F.when(F.col("home"), F.concat(resides, meets)).otherwise(meets)).alias("k"))
            .select("chain", "part", "k.x", "k.y", "k.home", "fp", "rep")
            .repartition(n, "chain", "part", "x", "y").sortWithinPartitions("chain", "part", "x", "y")
            .mapInArrow(run, "a long, b long"))
    return cold.union(warm)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, hot_rows: int = 4096,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` per row.

    A-Z is lower-cased, words are runs without space and U+0009-U+000D, a
    shingle is ``shingle`` words joined by a space (all words, if fewer).
    Equal fingerprints form a class represented by its smallest id; links are
    looked for between classes only.  ``component_id`` is the smallest id
    reachable.  Null, empty and wordless texts have fingerprint 0 and link
    like any other.  A row without an id gets the component of its
    fingerprint (null if no row of it has an id); repeated rows repeat; an
    empty table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    edges = links(classes.where("rep is not null"), distance, hot_rows)
    comp = connected_components(edges)
    labelled = (classes.join(comp, classes["rep"] == comp["node"], "left")
                .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return (fps.join(labelled, "fp")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
