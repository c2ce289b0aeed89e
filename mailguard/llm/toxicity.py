"""Toxicity: a bidirectional gated recurrent network with attention pooling (operator 8).

Each word enters as the sum of a hashed word embedding and of the hashed
embeddings of its 5-byte windows (word edges count as a space).  A forward and
a backward GRU read windows of words that overlap; attention pools their
states into one logit per window.  A text scores as its highest window, and
training follows suit: each labelled text contributes the window that the
model finds most toxic at the time.  All of it is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm.common import slices, small_batches
from mailguard.llm.hashing import CLASSES, LETTER, Spans, join, mix, tokens
from mailguard.llm.labelled import restored, training_rows

WORD_SLOTS, CHAR_SLOTS, DIM, HIDDEN, ATTEND = 1 << 15, 1 << 16, 6, 8, 8
WINDOW, STRIDE, GRAM = 32, 26, 5
CHUNK, SLICE_BYTES = 1024, 1 << 18     # windows and text bytes that a worker scores at a time (memory bounds)


class Words:
    """Hashed words and character windows of some texts, all in flat arrays."""

    def __init__(self, texts: list[str | None]):
        buf, starts = join([t.lower() if t else t for t in texts])
        s, e = tokens(buf)
        letter = CLASSES[buf[s]] == LETTER
        s, e = s[letter], e[letter]
        self.word = (Spans(buf).hash(s, e) % np.uint64(WORD_SLOTS)).astype(np.int64)
        doc = np.searchsorted(starts, s, "right") - 1
        self.count = np.bincount(doc, minlength=len(texts))
        plain = np.where(CLASSES[buf] == LETTER, buf, 32).astype(np.uint64)
        n = max(0, len(plain) - GRAM + 1)
        code = np.zeros(n, np.uint64)
        for k in range(GRAM):
            code |= plain[k:k + n] << np.uint64(8 * k)
        gram = (mix(code) % np.uint64(CHAR_SLOTS)).astype(np.int64)
        per = np.maximum(0, e - s - GRAM + 3)          # windows inside " word "
        self.per = per
        first = np.repeat(s - 1 - np.concatenate([[0], np.cumsum(per)[:-1]]), per) if len(s) else np.zeros(0, np.int64)
        self.gram = gram[first + np.arange(per.sum())] if per.sum() else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(s)), per)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers per window (-1 beyond the text) and the text of each window.

        Every word is in a window; a text without words has one empty window.
        """
        base = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        n = 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(n)), n)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        grid = at[:, None] + np.arange(WINDOW)
        return np.where(grid < self.count[doc][:, None], grid + base[doc][:, None], -1), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward pass and gradients (float32)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.p = {
            "word": normal(WORD_SLOTS, DIM, scale=0.05), "char": normal(CHAR_SLOTS, DIM, scale=0.05),
            "x0": normal(DIM, 3 * h, scale=0.4), "x1": normal(DIM, 3 * h, scale=0.4),
            "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "u0": normal(h, 3 * h, scale=0.3), "u1": normal(h, 3 * h, scale=0.3),
            "a": normal(2 * h, ATTEND, scale=0.4), "a_b": np.zeros(ATTEND, np.float32), "v": normal(ATTEND, scale=0.4),
            "out": normal(2 * h, scale=0.4), "out_b": np.full(1, -1.0, np.float32),
        }

    def embed(self, w: Words) -> np.ndarray:
        x = self.p["word"][w.word]
        if len(w.gram):
            g = self.p["char"][w.gram]
            for k in range(DIM):
                x[:, k] += np.bincount(w.owner, g[:, k], minlength=len(x))
        return x

    def _gru(self, x: np.ndarray, mask: np.ndarray, way: int, trace: list | None) -> np.ndarray:
        """States (windows, words, hidden) of one direction; ``x`` is (windows, words, DIM)."""
        u, h = self.p[f"u{way}"], HIDDEN
        gates = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        state = np.zeros((len(x), h), x.dtype)
        out = np.empty((len(x), x.shape[1], h), x.dtype)
        for t in (range(x.shape[1]) if way == 0 else range(x.shape[1] - 1, -1, -1)):
            rec = state @ u
            zr = _sigmoid(gates[:, t, :2 * h] + rec[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(gates[:, t, 2 * h:] + r * rec[:, 2 * h:])
            m = mask[:, t, None]
            new = np.where(m, (1 - z) * cand + z * state, state)
            if trace is not None:
                trace.append((t, state, z, r, cand, rec[:, 2 * h:]))
            state = new
            out[:, t] = state
        return out

    def logits(self, emb: np.ndarray, grid: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window of ``grid`` (word numbers into ``emb``, -1 for none)."""
        mask = grid >= 0
        x = emb[np.where(mask, grid, 0)] if len(emb) else np.zeros((*grid.shape, DIM), np.float32)
        x = np.where(mask[:, :, None], x, 0).astype(x.dtype)
        traces: list[list] = [[], []]
        states = np.concatenate([self._gru(x, mask, k, traces[k] if keep is not None else None) for k in (0, 1)], axis=2)
        act = np.tanh(states @ self.p["a"] + self.p["a_b"])
        e = np.where(mask, act @ self.p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        alpha = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(1)
        out = pooled @ self.p["out"] + self.p["out_b"][0]
        if keep is not None:
            keep |= {"x": x, "mask": mask, "traces": traces, "states": states, "act": act, "alpha": alpha, "pooled": pooled}
        return out

    def gradients(self, emb: np.ndarray, grid: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the mean weighted log loss; that of the inputs x; and the windows' probabilities."""
        k: dict = {}
        prob = _sigmoid(self.logits(emb, grid, k))
        p, g, h = self.p, {}, HIDDEN
        d = ((prob - y) * weight / len(y)).astype(emb.dtype)
        g["out"], g["out_b"] = k["pooled"].T @ d, np.array([d.sum()])
        d_pool = d[:, None] * p["out"]
        d_states = k["alpha"][:, :, None] * d_pool[:, None, :]
        d_alpha = (k["states"] * d_pool[:, None, :]).sum(2)
        d_e = k["alpha"] * (d_alpha - (k["alpha"] * d_alpha).sum(1, keepdims=True))
        g["v"] = (k["act"] * d_e[:, :, None]).sum((0, 1))
        d_act = d_e[:, :, None] * p["v"] * (1 - k["act"] ** 2)
        g["a"] = np.einsum("nti,ntj->ij", k["states"], d_act)
        g["a_b"] = d_act.sum((0, 1))
        d_states = d_states + d_act @ p["a"].T
        d_x = np.zeros_like(k["x"])
        for way in (0, 1):
            u, back = p[f"u{way}"], np.zeros((len(y), h), emb.dtype)
            own = d_states[:, :, way * h:(way + 1) * h]
            g_u, d_gates = np.zeros_like(u), np.zeros((*k["mask"].shape, 3 * h), emb.dtype)
            for t, state, z, r, cand, rec in reversed(k["traces"][way]):
                total = back + own[:, t]
                m = k["mask"][:, t, None]
                d_new = np.where(m, total, 0)
                d_c = d_new * (1 - z) * (1 - cand ** 2)
                d_z = d_new * (state - cand) * z * (1 - z)
                d_r = d_c * rec * r * (1 - r)
                d_rec = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g_u += state.T @ d_rec
                back = np.where(m, d_new * z, total) + d_rec @ u.T
                d_gates[:, t] = np.concatenate([d_z, d_r, d_c], axis=1)
            g[f"u{way}"] = g_u
            g[f"x{way}"] = np.einsum("nti,ntj->ij", k["x"], d_gates)
            g[f"b{way}"] = d_gates.sum((0, 1))
            d_x += d_gates @ p[f"x{way}"].T
        return g, d_x, prob

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Highest window probability of every whole text."""
        w = Words(texts)
        grid, doc = w.windows()
        emb = self.embed(w)
        top = np.full(len(texts), -np.inf)
        for at in range(0, len(grid), CHUNK):
            np.maximum.at(top, doc[at:at + CHUNK], self.logits(emb, grid[at:at + CHUNK]))
        return _sigmoid(np.clip(top, -60, 60))


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 5, batch: int = 64, rate: float = 0.02,
        seed: int = 5) -> Network:
    """Adam on the most toxic window of each text; inputs start from the labels' log odds.

    The first component of every embedding starts as the clipped log odds of
    its slot among the training texts (the other components at random), so the
    first choice of windows is already informed.  An empty window counts as
    not toxic.  ``weight`` is that of each text in the loss.
    """
    net, rng = Network(), np.random.default_rng(seed)
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return net
    w = Words(texts)
    grid, doc = w.windows()
    token_doc = np.repeat(np.arange(len(texts)), w.count)
    for name, slot, own in (("word", w.word, token_doc), ("char", w.gram, token_doc[w.owner])):
        n = len(net.p[name])
        seen = np.unique(own * n + slot)
        pos = np.bincount(seen % n, y[seen // n], minlength=n)
        every = np.bincount(seen % n, minlength=n)
        odds = np.log((pos + 0.1) / y.sum() / ((every - pos + 1) / (1 - y).sum()))
        net.p[name][:, 0] = np.where(every >= 3, np.clip(odds, 0, 4), 0) * (1.0 if name == "word" else 0.5)
    order = np.argsort(doc, kind="stable")
    first = np.searchsorted(doc[order], np.arange(len(texts)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        emb = net.embed(w)
        value = np.concatenate([net.logits(emb, grid[at:at + CHUNK]) for at in range(0, len(grid), CHUNK)])
        if epoch == 0:   # by log odds alone, before the network has learned anything
            value = np.where(grid >= 0, np.append(emb[:, 0], 0)[grid], 0).max(1)
        best = np.lexsort((value, doc))[np.append(first[1:], len(doc)) - 1]
        pick = rng.permutation(len(texts))
        for at in range(0, len(pick), batch):
            own = pick[at:at + batch]
            rows = np.concatenate([grid[best[own]], np.full((1, WINDOW), -1)])
            target = np.append(y[own], 0).astype(np.float32)
            used, inverse = np.unique(rows[rows >= 0], return_inverse=True)
            sub = _subset(w, used)
            local = np.full_like(rows, -1)
            local[rows >= 0] = inverse
            g, d_x, _ = net.gradients(net.embed(sub), local, target, np.append(weight[own], 1))
            d_tok = np.zeros((len(used), DIM), np.float32)
            np.add.at(d_tok, inverse, d_x[local >= 0])
            step += 1
            for name, slot, grad in (("word", sub.word, d_tok), ("char", sub.gram, d_tok[sub.owner])):
                slots, back = np.unique(slot, return_inverse=True)
                total = np.zeros((len(slots), DIM), np.float32)
                np.add.at(total, back, grad)
                m, v = moments[name]
                m[slots] = 0.9 * m[slots] + 0.1 * total
                v[slots] = 0.99 * v[slots] + 0.01 * total ** 2
                net.p[name][slots] -= 0.3 * rate * m[slots] / (np.sqrt(v[slots]) + 1e-6)
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad ** 2 - v)
                net.p[name] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


def _subset(w: Words, used: np.ndarray) -> Words:
    """The chosen words alone, with their character windows."""
    out = Words.__new__(Words)
    ends = np.cumsum(w.per)
    out.word, out.per = w.word[used], w.per[used]
    out.owner = np.repeat(np.arange(len(used)), out.per)
    first = np.repeat(ends[used] - out.per - (np.cumsum(out.per) - out.per), out.per)
    out.gram = w.gram[first + np.arange(len(out.owner))]
    return out


def train(docs: DataFrame, labels: DataFrame, keep: Column, target: str = "toxic", per_class: int = 1000,
          text_bytes: int = 16_000, id_col: str = "doc_id", text_col: str = "text", **solver) -> Network:
    """Fit on at most ``per_class`` labelled rows of each class of at most ``text_bytes`` bytes.

    Both are documented bounds of the training sample alone (they bound what
    the driver holds); classes count in their ratio among all labelled rows,
    long ones included, and scoring reads whole texts of any length.  Without rows
    of both classes the network stays untrained, with scores near 0.27.
    """
    short = docs.where(F.octet_length(text_col) <= text_bytes)
    got = training_rows(short, labels, target, keep, per_class, id_col, text_col).toArrow().sort_by("id")
    y, weight, taken = (np.array(got.column(c).to_pylist(), dtype=np.float64) for c in ("y", "weight", "taken"))
    return fit(got.column("text").to_pylist(), y, restored(y, weight, taken), **solver)


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (of any type) and ``score`` (0 to 1) of every row's whole text; no shuffle.

    The network is broadcast (fixed size).  Null counts as empty; empty texts
    and texts without letters score as an empty window; repeated rows repeat;
    other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    d = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(b.column(1).to_pylist()))],
                                             names=["id", "score"])

    schema = T.StructType([d.schema["id"], T.StructField("score", T.DoubleType())])
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)
