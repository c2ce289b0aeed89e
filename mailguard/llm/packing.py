"""Cost-balanced sequence packing (operator 2).

A piece of ``n`` tokens costs ``linear * n + quadratic * n**2`` (projections
plus attention inside the piece).  Within a group of documents the sequences
to fill are fixed first, so that their capacities add up to the group's
tokens: full ones of ``length`` tokens and, for the remainder, one for each
power of two in it.  Documents over ``length`` give full sequences; everything
left is assigned in descending order to the lowest-cost sequence that still
holds it whole.  When none does, the piece is cut at the roomiest sequence and
its rest is assigned in turn.  No sequence needs padding beyond that to its
own power of two.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.llm import bpe
from mailguard.llm.common import slices, small_batches


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes that add up to ``tokens``: full ones, then descending powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(sizes: list[int], length: int, linear: float = 1.0,
         quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``; every token in exactly one piece."""
    room = np.array(capacities(sum(sizes), length), dtype=np.int64)
    cost, filled = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(filled[seq])))
        filled[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    todo: list[tuple[int, int, int]] = []   # (-size, document, start)
    used = 0
    for doc, n in enumerate(sizes):
        start = 0
        while n - start >= length:
            put(doc, start, length, used)
            used += 1
            start += length
        if n > start:
            todo.append((start - n, doc, start))
    heapq.heapify(todo)
    while todo:
        n, doc, start = heapq.heappop(todo)
        fits = np.where(room >= -n, cost, np.inf)
        seq = int(fits.argmin())
        if fits[seq] < np.inf:
            put(doc, start, -n, seq)
        else:
            seq = int(room.argmax())
            part = int(room[seq])
            put(doc, start, part, seq)
            heapq.heappush(todo, (n + part, doc, start + part))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048,
                   group_sequences: int = 256, linear: float = 1.0, quadratic: float = 1 / 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack; one row per piece, with its token ids.

    Columns: ``id_col``, ``start``, ``length``, ``ids`` (binary, little-endian
    u32), ``doc_tokens``, ``sequence_id``, ``offset``.  ``length`` must be a
    power of two.  ``end_id`` closes every document.

    One pass without a shuffle: each task packs what it tokenises, in groups of
    about ``group_sequences`` sequences (the memory bound), so the padding does
    not depend on the size of the input.  Sequence ids carry the partition
    number in their upper bits.  Null or empty text is the one id ``end_id``;
    repeated rows are packed as documents of their own; other columns are
    ignored whatever their names; an empty table gives no rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(tokenizer_path))
    d = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    schema = T.StructType([T.StructField(id_col, d.schema["id"].dataType)]
                          + [T.StructField(n, T.LongType()) for n in ("start", "length")]
                          + [T.StructField("ids", T.BinaryType())]
                          + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.load(spec.value)
        base = TaskContext.get().partitionId() << 33
        names: list = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            pieces = pack([len(x) // 4 for x in held], length, linear, quadratic)
            cols = list(zip(*pieces, strict=True))
            ids = [held[i][4 * s:4 * (s + n)] for i, s, n, _, _ in pieces]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in cols[0]], id_arrow), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([len(held[i]) // 4 for i in cols[0]], pa.int64()),
                 pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())], names=schema.names)
            base += max(cols[3]) + 1
            names.clear()
            held.clear()
            return out

        tokens = 0
        for b in slices(batches, "text", 4 << 20, bpe.OWNER):
            id_arrow = b.schema.field(0).type
            for name, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                names.append(name)
                held.append(ids + end)
                tokens += len(ids) // 4 + 1
                if tokens >= group_sequences * length:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return d.mapInArrow(run, schema)
