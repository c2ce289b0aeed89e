"""Vectorised hashing of byte strings: whole slices of texts at once, no loop over words."""

from __future__ import annotations

import numpy as np

from mailguard.llm.common import hold

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x2545F4914F6CDD1D   # odd, so invertible modulo 2**64
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OWNER = "hashing"
STEP = 1 << 20    # tables of powers grow by so many entries


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * _MIX1
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for ``i <= n`` (the last tables are kept while the operator runs)."""

    def table(b: int) -> np.ndarray:
        x = np.full(n // STEP * STEP + STEP, b, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    up, down = hold(OWNER, n // STEP, lambda: (table(BASE), table(pow(BASE, -1, 1 << 64))))
    return up[:n + 1], down[:n + 1]


class Spans:
    """Hashes of any substrings of ``buf`` (uint8), from prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[buf] * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def join(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a space before, between and after; and each text's first byte."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = b" " + b" ".join(raw) + b" "
    sizes = np.array([0] + [len(r) + 1 for r in raw])
    return np.frombuffer(buf.lower() if lower else buf, np.uint8), np.cumsum(sizes)[:-1] + 1


SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[48:58] = DIGIT
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = LETTER


def tokens(buf: np.ndarray, classes: np.ndarray = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of one class but space."""
    c = classes[buf]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(buf)]])
    keep = c[starts] != SPACE
    return starts[keep], ends[keep]
