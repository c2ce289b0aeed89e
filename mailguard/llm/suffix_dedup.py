"""Removal of long repeated byte strings by distributed prefix doubling (operator 4).

Which positions have a ``threshold``-byte prefix (of their suffix) that starts
anywhere else too?  Ranks are 64-bit names of prefixes: equal prefixes have
equal names, so names made in different tasks agree and a name of twice the
length is made from two names at an offset.  Spark groups the (name, position)
rows of a round, drops positions whose name is unique, and the next round
works on the rest at a longer prefix:

1. ``SEED``-byte prefixes, doubled from single bytes.  Of the start positions
   whose ``threshold``-byte prefixes share their smallest seed name (the
   *anchor*), one row per anchor goes to Spark: equal strings have equal
   anchors at equal places, so a unique anchor settles all its starts as unique.
2. The string from the first start of an anchor to the end of its last start's
   prefix.  If it occurs again, all starts of the anchor repeat.
3. Starts of anchors that occur with different strings are ranked one by one:
   their full ``threshold``-byte prefixes, once for every different string of
   the anchor.

No round holds a row for every byte: the rows are about one per 85 bytes, and
about two anchors per end of a repeated run in the last round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm.common import cut, slices, small_batches
from mailguard.llm.hashing import _VALUES, BASE, Spans, mix

SEED = 32            # bytes of the first ranks that leave a task
SEGMENT = 1 << 20    # starts that a task ranks at once (memory bound; long texts go in overlapping segments)
BROADCAST_ROWS = 50_000


def seed_names(buf: np.ndarray, length: int = SEED) -> np.ndarray:
    """Names of all ``length``-byte prefixes, by doubling from single bytes."""
    names, n = mix(_VALUES[buf]), 1
    while n < length:
        names = names[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + names[n:]
        n *= 2
    return mix(names)


def anchors(buf: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, its name, and its first and last start, for all starts of one text segment."""
    names = seed_names(buf)
    width = threshold - SEED + 1          # seeds inside a threshold-byte string
    key = (names & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=np.uint64)
    low, n = key, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    rest = width - n
    if rest:
        low = np.minimum(low[:len(low) - rest], low[rest:])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:], len(at)) - 1
    return at[first], names[at[first]], first, last


def _texts(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, offset and bytes of every segment of every text of at least ``threshold`` bytes."""
    for i, t in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) >= threshold:
            buf = np.frombuffer(raw, np.uint8)
            for at in range(0, len(buf) - threshold + 1, SEGMENT):
                yield i, at, buf[at:at + SEGMENT + threshold - 1]


def _anchor_rows(keyed: DataFrame, threshold: int) -> DataFrame:
    """``id, th, name, string, place``: one row per anchor; ``place`` packs anchor, first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            rows, cols = [], []
            for i, offset, buf in _texts(b, threshold):
                at, name, first, last = anchors(buf, threshold)
                string = mix(Spans(buf).hash(first, last + threshold) + ((at - first) << 8).astype(np.uint64))
                place = ((at + offset) << 16) | ((at - first) << 8) | (at - last)
                rows.append(np.full(len(at), i))
                cols.append((name, string, place))
            if rows:
                i = pa.array(np.concatenate(rows))
                name, string, place = (np.concatenate(c) for c in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(i), b.column(1).take(i), pa.array(name.view(np.int64)), pa.array(string.view(np.int64)),
                     pa.array(place)], names=["id", "th", "name", "string", "place"])

    return keyed.mapInArrow(run, "id long, th long, name long, string long, place long")


def _strings(wanted: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the chosen anchors' strings: ``wanted`` has ``id, th, text, picks(name, string, place)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out: list[tuple] = []
            for i, th, t, picks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for p in picks:
                    at, lead, tail = p["place"] >> 16, p["place"] >> 8 & 255, p["place"] & 255
                    out.append((i, th, p["name"], lead, at - lead, raw[at - lead:at - tail + threshold]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else
                                             [pa.array([], k) for k in (pa.int64(),) * 5 + (pa.binary(),)],
                                             names=["id", "th", "name", "lead", "first", "bytes"])

    return wanted.mapInArrow(run, "id long, th long, name long, lead long, first long, bytes binary")


def _ranked(lead: np.ndarray, raw: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, start within it, and name of every threshold-byte prefix of the strings of one anchor."""
    sizes = np.array([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    base = np.cumsum(sizes) - sizes
    n = sizes - threshold + 1
    own = np.repeat(np.arange(len(raw)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = start + base[own]
    return own, start, mix(Spans(buf).hash(s, s + threshold) + (np.asarray(lead)[own] - start).astype(np.uint64))


def _runs(own: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(string, first start, last start) of the maximal runs of consecutive starts, both sorted."""
    if not len(own):
        return []
    cuts = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first = np.concatenate([[0], cuts])
    last = np.append(cuts, len(own)) - 1
    return list(zip(own[first].tolist(), start[first].tolist(), start[last].tolist(), strict=True))


def _compare(threshold: int):
    """mapInArrow over strings sorted by name: runs of starts whose prefix repeats within the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> list[tuple]:
            own, start, names = _ranked(np.array([h[3] for h in held]), [h[5] for h in held], threshold)
            _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
            keep = count[inverse] > 1
            out = [(held[k][0], held[k][1], held[k][4] + a, held[k][4] + z + threshold)
                   for k, a, z in _runs(own[keep], start[keep])]
            held.clear()
            return out

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][2] != row[2]:
                    out += settle()
                held.append(row)
            if out:
                yield _span_batch(out)
        if held:
            yield _span_batch(settle())

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "th", "start", "end"])


def _split_compare(strings: DataFrame, threshold: int) -> DataFrame:
    """As ``_compare`` for anchors with very many strings: one row per start, counted by name in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, th, name, lead, first, raw = (c.to_pylist() for c in part.columns)
                own, start, names = _ranked(np.array(lead), raw, threshold)
                begin = np.array(first)[own] + start
                i = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(1).take(i), part.column(2).take(i),
                                                  pa.array(names.view(np.int64)), pa.array(begin)],
                                                 names=["id", "th", "name", "prefix", "start"])

    rows = strings.mapInArrow(run, "id long, th long, name long, prefix long, start long")
    again = rows.groupBy("name", "prefix").count().where("count > 1").drop("count")
    return rows.join(again, ["name", "prefix"]).select("id", "th", "start", (F.col("start") + threshold).alias("end"))


def _merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame, threshold: int = 200, hot_strings: int = 4_000) -> DataFrame:
    """``id, th, start, end``: spans that cover exactly the repeated bytes (they may overlap).

    ``docs``: ``id``, ``th`` (hash of the text) and ``text``; rows with equal
    ``id`` and ``th`` are separate documents that get each other's spans.
    """
    if not SEED < threshold <= SEED + 224:
        raise ValueError("threshold must be within 33 and 256 bytes")
    rows = _anchor_rows(docs, threshold)
    names = (rows.groupBy("name").agg(F.count("*").alias("n"), F.min("string").alias("low"), F.max("string").alias("high"))
             .where("n > 1").select("name", (F.col("low") == F.col("high")).alias("same")))
    # On the flipped name both sides are shuffled for the join alone, so Spark can split a hot name's rows.
    flipped = names.select(F.bitwise_not("name").alias("flip"), "same")
    again = cut(rows.join(flipped, F.bitwise_not(rows["name"]) == flipped["flip"]).drop("flip"))
    mixed = again.where("not same")
    strings = (mixed.groupBy("name", "string")
               .agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "place")).alias("one")))
    strings = cut(strings)
    whole = again.where("same").select("id", "th", "place").union(
        mixed.join(strings.where("n > 1").select("name", "string"), ["name", "string"]).select("id", "th", "place"))
    at, lead, tail = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    settled = whole.select("id", "th", (at - lead).alias("start"), (at - tail + threshold).alias("end"))

    picks = (strings.select(F.col("one.id").alias("id"), F.col("one.th").alias("th"),
                            F.struct("name", "string", F.col("one.place").alias("place")).alias("p"))
             .groupBy("id", "th").agg(F.collect_list("p").alias("picks")))
    source = docs.join(picks, (docs["id"].eqNullSafe(picks["id"])) & (docs["th"] == picks["th"])).select(
        docs["id"], docs["th"], "text", "picks")
    found = cut(_strings(source, threshold))
    hot = cut(found.groupBy("name").count().where(F.col("count") > hot_strings).select("name"))
    near = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = (found.join(near, "name", "left_anti").select(*found.columns).repartition(n, "name").sortWithinPartitions("name")
            .mapInArrow(_compare(threshold), "id long, th long, start long, end long"))
    warm = _split_compare(found.join(near, "name", "left_semi").select(*found.columns), threshold)
    return settled.union(cold).union(warm)


def remove_repeats(docs: DataFrame, threshold: int = 200, hot_strings: int = 4_000, id_col: str = "doc_id",
                   text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``spans`` (start and end of removed runs, in bytes),
    ``kept`` (binary, the remaining bytes); with ``carry`` also ``carried``, a struct of those columns.

    A byte goes if a ``threshold``-byte string covering it also starts at
    another place of the same or another text, judged on the input.  Matches
    lie inside one text.  Null counts as empty; texts shorter than
    ``threshold`` stay whole; repeated rows are documents of their own (so
    they lose everything if long enough); rows with a null id are kept apart
    by their text; an empty table gives no rows; other columns are ignored.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"),
                       *([F.struct(*carry).alias("carried")] if carry else []))
    extra = docs.columns[3:]
    spans = repeated_spans(docs.select("id", "th", "text"), threshold, hot_strings)
    lists = spans.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = docs.join(lists, (docs["id"].eqNullSafe(lists["id"])) & (docs["th"] == lists["th"]), "left").select(
        docs["id"], "text", "spans", *extra)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                            T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType()), *(docs.schema[c] for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, "text", 4 << 20):
            sizes, runs, kept = [], [], []
            for t, pairs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                merged = _merge([(p["start"], p["end"]) for p in pairs or []])
                at, parts = 0, []
                for s, e in merged:
                    parts.append(raw[at:s])
                    at = e
                sizes.append(len(raw))
                runs.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind),
                                              pa.array(kept, pa.binary()), *b.columns[3:]], names=schema.names)

    return both.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def brute_force(texts: list[str | None], threshold: int = 200) -> list[tuple[int, list[tuple[int, int]], str]]:
    """Reference for small tables: (bytes, removed runs, SHA-256 of the rest) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - threshold + 1):
            seen[r[i:i + threshold]] = seen.get(r[i:i + threshold], 0) + 1
    out = []
    for r in raw:
        runs = _merge([(i, i + threshold) for i in range(len(r) - threshold + 1) if seen[r[i:i + threshold]] > 1])
        rest, at = b"", 0
        for s, e in runs:
            rest, at = rest + r[at:s], e
        out.append((len(r), runs, hashlib.sha256(rest + r[at:]).hexdigest()))
    return out
