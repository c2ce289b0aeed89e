"""Runs of words that repeat with a period (operator 13).

A run of period ``p`` and length ``n`` has ``n - p`` words in a row that equal
the word ``p`` further on.  Whatever the run, two neighbouring points of the
grid of step about ``p`` lie in them, so all periods together look at a
harmonic number of points.  Points whose words agree are extended to both sides
by longest common extensions (LCE), exactly, whatever their length: a
difference cover says which suffixes are sampled, only those are sorted, and
two positions are at most ``COVER - 1`` word comparisons away from a pair of
samples, whose common prefix is a minimum over the sorted order's, read from a
sparse table.

Spark deals the documents out; a task works on slices of them with numpy, all
documents of a slice in one array, between separators that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailguard.llm.common import slices, small_batches

# A difference set of 31; every remainder is a difference of two of its members.
COVER, MEMBERS = 31, (1, 5, 11, 24, 25, 27)
SLICE_BYTES = 1 << 20
QUERIES = 1 << 14      # common extensions looked up at a time
PROBES = 8             # words compared before a grid point is extended


class CoverLce:
    """Longest common extensions of positions in ``text``, an integer array whose last item occurs once."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        self.text = np.concatenate([text, np.full(2 * COVER, text.min() - 1, text.dtype)])
        member = np.full(COVER, -1)
        member[list(MEMBERS)] = np.arange(len(MEMBERS))
        self.member = member
        # For every difference of two positions: the remainder at which both are sampled.
        self.meet = np.empty(COVER, np.int64)
        for d in range(COVER):
            self.meet[d] = next(x for x in MEMBERS if (x + d) % COVER in MEMBERS)
        each = [np.arange(x, self.size, COVER) for x in MEMBERS]
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in each])])[:-1]
        self._sort(np.concatenate(each))

    def _sort(self, samples: np.ndarray) -> None:
        """Rank the sampled suffixes by doubling over blocks of ``COVER`` words, and the common prefixes of neighbours."""
        n = len(samples)
        blocks = self.text[samples[:, None] + np.arange(COVER)]
        order = np.lexsort(blocks.T[::-1])
        new = np.ones(n, bool)
        new[1:] = (blocks[order[1:]] != blocks[order[:-1]]).any(1)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels = [rank]
        while n and levels[-1].max() < n - 1:
            step, rank = 1 << (len(levels) - 1), levels[-1]
            # The block that ends a class holds the last item, so equal ranks never reach into the next class.
            later = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
            levels.append(np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
        self.rank = levels[-1]
        sa = np.empty(n, np.int64)
        sa[self.rank] = np.arange(n)
        a, b = sa[:-1].copy(), sa[1:].copy()
        lcp = np.zeros(len(a), np.int64)
        for t in range(len(levels) - 1, -1, -1):
            same = levels[t][a] == levels[t][b]
            lcp += same * (COVER << t)
            a, b = np.minimum(a + (same << t), n - 1), np.minimum(b + (same << t), n - 1)
        lcp += (blocks[a] != blocks[b]).argmax(1)
        self.table = [lcp]
        while len(self.table[-1]) > (width := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the samples at positions ``a`` and ``b``."""
        ra, rb = (self.rank[self.first[self.member[x % COVER]] + x // COVER] for x in (a, b))
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for t in np.unique(level):
            at = level == t
            row = self.table[t]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(t))])
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of items that agree from ``i`` and ``j`` on (``i != j``)."""
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), QUERIES):
            a, b = i[k:k + QUERIES], j[k:k + QUERIES]
            differs = self.text[a[:, None] + np.arange(COVER)] != self.text[b[:, None] + np.arange(COVER)]
            near = np.where(differs.any(1), differs.argmax(1), COVER)
            ahead = (self.meet[(b - a) % COVER] - a) % COVER     # both a + ahead and b + ahead are sampled
            far = near >= ahead
            near[far] = ahead[far] + self._between(a[far] + ahead[far], b[far] + ahead[far])
            out[k:k + QUERIES] = near
        return out


def grid_points(text: np.ndarray, sizes: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods at which a run may lie.

    ``text`` holds documents of ``sizes`` words, longest first, a separator
    after each.  A run's ``need - p`` equal words hold two neighbours of the
    grid of half that step, so both must equal the word ``p`` further on, and
    all words between them.
    """
    ends = np.cumsum(sizes + 1)
    found: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    for p in range(1, int(sizes[0]) // exponent + 1 if len(sizes) else 1):
        need = max(min_length, exponent * p)
        docs = int(np.searchsorted(-sizes, -need, side="right"))
        if not docs:
            break
        step, end = (need - p) // 2, ends[docs - 1]
        same = text[0:end - p:step] == text[p:end:step]
        at = np.flatnonzero(same[:-1] & same[1:]) * step
        for k in range(1, PROBES):
            if not len(at):
                break
            off = at + step * k // PROBES
            at = at[text[off] == text[off + p]]
        if len(at):
            found.append(at)
            periods.append(np.full(len(at), p))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(periods)


def find_runs(text: np.ndarray, sizes: np.ndarray, min_length: int = 24, exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and then period; ``text`` as for ``grid_points``."""
    at, period = grid_points(text, sizes, min_length, exponent)
    if not len(at):
        return at, at, at
    # Only documents with points are indexed, behind a separator of their own.
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(starts, at, side="right") - 1
    docs = np.unique(doc)
    words = np.concatenate([[-len(text) - 2], *(text[starts[d]:starts[d] + sizes[d] + 1] for d in docs)])
    shift = 1 + np.cumsum(sizes[docs] + 1) - (sizes[docs] + 1) - starts[docs]
    moved = shift[np.searchsorted(docs, doc)]
    i, j = at + moved, at + moved + period
    last = len(words)
    ahead = CoverLce(words).extend(i, j)
    back = CoverLce(words[::-1]).extend(last - i, last - j)
    start, end = i - back, j + ahead
    long = end - start >= np.maximum(min_length, exponent * period)
    start, end, period, moved = start[long], end[long], period[long], moved[long]
    # A stretch with several periods is one run, of the smallest; its maximal extension is the same for all.
    order = np.lexsort((period, end, start))
    start, end, period, moved = start[order], end[order], period[order], moved[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period, moved = start[new], end[new], period[new], moved[new]
    order = np.lexsort((period, start))
    return (start - moved)[order], (end - start)[order], period[order]


def _documents(texts: list[bytes | None], min_length: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text: number of words, its runs, and the words that stay joined by spaces."""
    words = [(t or b"").split() for t in texts]       # bytes: blanks are 0x20 and 0x09 to 0x0D
    ids: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat: list[int] = []
    for k, d in enumerate(order.tolist()):
        flat += [ids.setdefault(w, len(ids)) for w in words[d]]
        flat.append(-1 - k)
    by_size = sizes[order]
    start, length, period = find_runs(np.array(flat, np.int64), by_size, min_length, exponent)
    first = np.cumsum(by_size + 1) - by_size - 1
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    for d, own in enumerate(words):
        base = first[place[d]]
        lo, hi = np.searchsorted(start, [base, base + len(own)])
        runs = list(zip((start[lo:hi] - base).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
        if runs:
            depth = np.zeros(len(own) + 1, np.int64)
            for s, n, p in runs:
                depth[s + p] += 1
                depth[s + n] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        yield int(sizes[d]), runs, b" ".join(own)


def collapse_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of every text and the text with one period of each.

    Words are separated by spaces and the control characters 0x09 to 0x0D.  A
    run is a maximal stretch of smallest period ``q`` and at least
    ``max(min_length, exponent * q)`` words (``exponent`` 2 or more); ``runs``
    has their ``start, length, period`` by start, then period.  ``collapsed``
    joins by single spaces the words that no run holds after its first ``q``.
    Null and empty texts have no words and an empty result.  Every row comes
    back, repeated ones and those without an id too; an empty table gives no
    rows; other columns are ignored.  A text is handled whole by one task, in
    some 200 bytes a word.
    """
    if exponent < 2 or min_length < 3:
        raise ValueError("exponent must be 2 or more and min_length 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, "text", SLICE_BYTES):
            out = list(_documents(batch.column(1).cast(pa.binary()).to_pylist(), min_length, exponent))
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.array(runs, kind),
                 pa.array([t for _, _, t in out], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
