"""BPE encoding and decoding with a pair occurrence index (operator 10).

The texts of an Arrow batch are split at white space and its different pieces
numbered, both by Arrow.  Pieces of letters, alone or with a mark behind them,
are words; every other piece not met before is normalised and pre-tokenised by
the tokenizer file's own normalizer and pre-tokenizer.  All new words of the
batch are merged together:

* one symbol array holds the byte symbols of all words, linked by ``nxt`` and
  ``prv``;
* an index maps every mergeable pair to the positions where it occurs;
* the active pairs are applied in ascending rank, each at all its positions at
  once, and the lists of the pairs that a merge creates are updated.

Merging never crosses a word, so the batch result equals word-by-word BPE, and
words that an earlier batch has merged are not merged again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm.common import hold, slices, small_batches

# The tokenizer's white space is Python's without the four separators U+001C to U+001F.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
# Pieces of these characters only are already composed and lower-case character by character, so
# the tokenizer's split pattern can be applied to many of them at once; the rest go one by one
# through the tokenizer's own normalizer and pre-tokenizer.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
_WORDS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ENDS = ",.;:!?"          # marks that are a word of their own behind letters
NO_ID = 0xFFFFFFFF       # above every vocabulary id
PIECE_END = NO_ID.to_bytes(4, "little")
MEMO_PIECES = 500_000   # pieces whose ids a worker keeps; a memory bound, not a result bound
MEMO_WORDS = 300_000    # words whose ids a worker keeps; likewise


def byte_symbols() -> dict[str, int]:
    """Printable stand-in character of every byte (the byte-level BPE rule)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    for i, b in enumerate(x for x in range(256) if x not in set(kept)):
        out[chr(256 + i)] = b
    return out


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[start:start + size]`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return pool[at], ends


class PairIndexBpe:
    """Vocabulary, merges and the batch merger of one tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        tok, model = Tokenizer.from_str(spec), json.loads(spec)
        self.normalize, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")") if self.special else None
        end = model["model"].get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.byte_of = chars
        self.inner = np.zeros(256, np.int64)
        self.last = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        self.width = max(vocab.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        self.left = np.array([vocab[a] for a, _ in pairs])
        self.right = np.array([vocab[b] for _, b in pairs])
        self.new = np.array([vocab[a + b] for a, b in pairs])
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.fixed = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.memo: dict[str, bytes] = dict(self.fixed)
        self.words: dict[str, bytes] = {"\n": PIECE_END}
        self.check_pattern(model)

    def check_pattern(self, model: dict) -> None:
        """The joint split of plain pieces holds only for the pattern it states."""
        split = [x for x in model["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        if not split or "\\n|" + split[0]["pattern"].get("Regex", "") != _WORDS.pattern:
            raise ValueError("this tokenizer file splits words in another way")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair has none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        n = len(buf)
        sym = self.inner[buf]
        sym[ends - 1] = self.last[buf[ends - 1]]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[0] = -1
        prv[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(pos: np.ndarray, follow: np.ndarray) -> None:
            r = self.rank(sym[pos], sym[follow])
            keep = r >= 0
            pos, r = pos[keep], r[keep]
            if not len(r):
                return
            o = np.argsort(r, kind="stable")
            pos, r = pos[o], r[o]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            lows = [0, *cuts.tolist()]
            for lo, hi, rr in zip(lows, [*lows[1:], len(r)], r[lows].tolist(), strict=True):
                if rr in index:
                    index[rr].append(pos[lo:hi])
                else:
                    index[rr] = [pos[lo:hi]]
                    heapq.heappush(active, rr)

        at = np.flatnonzero(nxt >= 0)
        add(at, at + 1)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            # Two neighbouring merges list the pair between them twice.
            pos = lists[0] if len(lists) == 1 and a != b else np.unique(np.concatenate(lists))
            follow = nxt[pos]
            ok = (sym[pos] == a) & (follow >= 0) & (sym[follow] == b)
            if a == b and len(pos) > 1:
                pos, follow = pos[ok], follow[ok]
                chained = np.concatenate([[False], follow[:-1] == pos[1:]])  # overlaps the pair before it
                i = np.arange(len(pos))
                first = np.maximum.accumulate(np.where(chained, 0, i))
                ok = (i - first) % 2 == 0
            pos, follow = pos[ok], follow[ok]
            if not len(pos):
                continue
            sym[pos], sym[follow] = self.new[r], -1
            after = nxt[follow]
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            left = before >= 0
            add(np.concatenate([pos[has], before[left]]), np.concatenate([after[has], pos[left]]))
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        upto = np.cumsum(alive)[ends - 1] * 4
        starts = [0, *upto[:-1].tolist()]
        return [ids[s:e] for s, e in zip(starts, upto.tolist(), strict=True)]

    def learn_words(self, words: Iterable[str]) -> None:
        """Merge the words that the memo lacks, all of them in one pass over the pair index."""
        every = dict.fromkeys(words)
        if len(self.words) > MEMO_WORDS:                   # what this batch holds stays
            self.words = {"\n": PIECE_END} | {w: self.words[w] for w in every if w in self.words}
        ids = self.words
        new = [w for w in every if w not in ids]
        ids.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))

    def learn(self, pieces: list[str], words: list[str]) -> None:
        """Encode ``words`` and the pieces that the memo lacks."""
        fresh = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(fresh) > MEMO_PIECES:      # what this batch holds stays
            self.memo = self.fixed | {p: self.memo[p] for p in pieces if p in self.memo}
        plain, rest = [], []
        for p in fresh:
            (plain if (p.isprintable() if p.isascii() else _PLAIN.fullmatch(p)) else rest).append(p)
        found = _WORDS.findall("\n".join(plain).lower() + "\n") if plain else []   # a line feed ends each piece
        split = [[bytes([self.byte_of[c] for c in w]).decode() for w, _ in self.pre(self.normalize(p))] for p in rest]
        self.learn_words(chain(found, words, *split))
        ids = self.words
        joined = b"".join(map(ids.__getitem__, found))
        ends = np.flatnonzero(np.frombuffer(joined, "<u4") == NO_ID) * 4
        start = 0
        for p, end in zip(plain, ends.tolist(), strict=True):
            self.memo[p] = joined[start:end]
            start = end + 4
        for p, own in zip(rest, split, strict=True):
            self.memo[p] = b"".join([ids[i] for i in own])

    def pieces(self, text: str) -> list[str]:
        """White-space separated pieces; special tokens are pieces of their own."""
        odd = any(c in text for c in SEPARATORS)
        if self.special_re and "<|" in text:
            out: list[str] = []
            for part in self.special_re.split(text):
                out += [part] if part in self.special else _SPACE.split(part)
            return [p for p in out if p]
        return [p for p in _SPACE.split(text) if p] if odd else text.split()

    def split(self, texts: pa.Array) -> pa.ListArray:
        """``pieces`` of every text; empty pieces may stand between them."""
        odd = pc.match_substring_regex(texts, "<\\||[" + SEPARATORS + "]")
        if not pc.any(odd).as_py():
            return pc.utf8_split_whitespace(texts)
        own = pa.array([self.pieces(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        both = pa.concat_arrays([pc.utf8_split_whitespace(texts.filter(pc.invert(odd))), own])
        at = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        return both.take(pa.array(np.argsort(at)))

    def piece_ids(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after the other, and where each piece ends."""
        whole = pc.ascii_is_alpha(pieces)                                    # one word
        before = pc.utf8_slice_codeunits(pieces, 0, -1)
        mark = pc.index_in(pc.utf8_slice_codeunits(pieces, -1), pa.array(list(ENDS)))
        ended = pc.and_(pc.is_valid(mark), pc.ascii_is_alpha(before))        # one word and its mark
        simple = pc.or_(whole, ended)
        # The same letters may begin a sentence or end one: a word is looked up once for all its pieces.
        spelt = pc.ascii_lower(pc.if_else(whole, pieces, before).filter(simple)).dictionary_encode()
        words, others = spelt.dictionary.to_pylist(), pieces.filter(pc.invert(simple)).to_pylist()
        self.learn(others, [*words, *ENDS])
        blobs = [*map(self.words.__getitem__, ENDS), *map(self.words.__getitem__, words), *map(self.memo.__getitem__, others)]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(sizes) - sizes
        # Two parts a piece: its word or itself, and the mark behind it.
        simple, ended = simple.to_numpy(zero_copy_only=False), ended.to_numpy(zero_copy_only=False)
        part = np.empty((len(pieces), 2), np.int64)
        part[simple, 0] = spelt.indices.to_numpy() + len(ENDS)
        part[~simple, 0] = np.arange(len(others)) + len(ENDS) + len(words)
        part[:, 1] = pc.fill_null(mark, 0).to_numpy(zero_copy_only=False)
        size = sizes[part]
        size[~ended, 1] = 0
        ids, ends = gather(np.frombuffer(b"".join(blobs), "<u4"), starts[part].ravel(), size.ravel())
        return ids, ends[1::2]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Ids of every text, as bytes of little-endian unsigned 32-bit integers; a null text has none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = self.split(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        own, ends = self.piece_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        starts = np.concatenate([[0], ends])
        ids, upto = gather(own, starts[at], (ends - starts[:-1])[at])
        bounds = 4 * np.concatenate([[0], upto])[split.offsets.to_numpy()]
        data = ids.tobytes()
        for s, e in pairwise(bounds.tolist()):
            yield data[s:e]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' strings joined by spaces (the file names no decoder)."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])


OWNER = "bpe"


def load(spec: str) -> PairIndexBpe:
    """One merger per worker process and tokenizer; its memo lives until another operator's task uses the worker."""
    return hold(OWNER, hashlib.sha256(spec.encode()).hexdigest(), lambda: PairIndexBpe(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  slice_bytes: int = 4 << 20) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (binary, little-endian u32) and ``decoded`` (string) per row.

    No shuffle; one pass over the texts.  The tokenizer file is broadcast (its
    size is that of a fixed vocabulary).  Null text counts as empty (0 tokens);
    empty texts give 0 tokens and an empty decoded text; repeated rows give
    repeated results; other columns are ignored whatever their names.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    d = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    id_type = d.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for b in slices(batches, "text", slice_bytes, OWNER):
            ids = list(bpe.encode(b.column(1)))
            decoded = [bpe.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)
