"""Quality classifier: hashed word n-grams, logistic regression by FTRL (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailguard.llm.common import slices, small_batches
from mailguard.llm.hashing import Spans, join, mix, tokens
from mailguard.llm.labelled import restored, training_rows

SLOTS = 1 << 18   # hashed features; slot 0 is the bias
ECHO = np.uint64(1)   # the one feature of all 2-grams that repeat a word


def features(texts: list[str | None], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and text number of every word 1-gram and 2-gram (runs of letters, digits or symbols), and
    the weight 1 / sqrt(n) that each occurrence has in its text."""
    buf, starts = join(texts)
    s, e = tokens(buf)
    h = Spans(buf).hash(s, e)
    doc = np.searchsorted(starts, s, "right") - 1
    same = doc[1:] == doc[:-1]
    two = np.where(h[:-1] == h[1:], ECHO, mix(h[:-1] * np.uint64(3) + h[1:]))[same]
    slot = np.concatenate([h, two]) % np.uint64(slots - 1) + np.uint64(1)
    own = np.concatenate([doc, doc[1:][same]])
    n = np.bincount(own, minlength=len(texts))
    return slot.astype(np.int64), own, 1 / np.sqrt(np.maximum(n, 1))


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Sparse dot products through the logistic function; a text without words gets the bias alone."""
    slot, own, scale = features(texts, len(weights))
    dot = np.bincount(own, weights[slot], minlength=len(texts)) * scale + weights[0]
    return 1 / (1 + np.exp(-np.clip(dot, -60, 60)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, float]], slots: int = SLOTS, alpha: float = 0.3, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Follow-the-regularised-leader-proximal updates, one example (slots, values, label,
    example weight) at a time; the final weights."""
    z, n = np.zeros(slots), np.zeros(slots)

    def current(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y, share = rows[k]
            w = current(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -60, 60))) - y) * share * x
            sq = n[i]
            z[i] += g - (np.sqrt(sq + g * g) - np.sqrt(sq)) / alpha * w
            n[i] = sq + g * g
    return current(np.arange(slots))


def train(docs: DataFrame, labels: DataFrame, keep: Column, target: str = "quality", per_class: int = 3000,
          text_bytes: int = 64_000, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", **solver) -> np.ndarray:
    """Weights from at most ``per_class`` labelled rows of each class of at most ``text_bytes`` bytes.

    Both are documented bounds of the training sample alone.  The tasks turn
    texts into sparse vectors; only these reach the driver, which runs the
    updates.  Classes count in their ratio among all labelled rows, long ones
    included.  Without labelled rows all weights are 0 (every score 0.5).
    """
    short = docs.where(F.octet_length(text_col) <= text_bytes)
    rows = training_rows(short, labels, target, keep, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            slot, own, scale = features(b.column(1).to_pylist(), slots)
            key, count = np.unique(own * slots + slot, return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, b.num_rows) * slots)
            idx = [np.concatenate([[0], x % slots]).astype(np.int32) for x in np.split(key, cuts)]
            val = [np.concatenate([[1.0], c * f]).astype(np.float32) for c, f in zip(np.split(count, cuts), scale, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())),
                 b.column(2), b.column(3), b.column(4)], names=["id", "i", "x", "y", "weight", "taken"])

    got = rows.mapInArrow(run, "id string, i array<int>, x array<float>, y int, weight double, taken long").toArrow().sort_by("id")
    y, weight, taken = (np.array(got.column(c).to_pylist(), np.float64) for c in ("y", "weight", "taken"))
    idx, val = (_lists(got.column(c)) for c in ("i", "x"))
    return ftrl(list(zip(idx, val, y.astype(int).tolist(), restored(y, weight, taken).tolist(), strict=True)), slots, **solver)


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its flat values."""
    out = []
    for chunk in col.chunks:
        at = chunk.offsets.to_numpy()
        flat = chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def score_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row's whole text; no shuffle.

    The weights are broadcast (a fixed number of slots).  Null counts as empty
    and scores as the bias alone; repeated rows repeat; other columns, label
    columns among them, are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    d = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist(), held.value))],
                                             names=["id", "score"])

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
