"""Embedding near-duplicates with an inverted multi-index (operator 3).

Two codebooks, one per half of the vectors, are fitted on a bounded sample;
their product grid has a cell for each pair of codewords, and every vector is
indexed in its cell.  For each vector the multi-sequence traversal visits cells
in ascending order of a lower bound of the distance to anything in them (the
sum of the halves' bounds, each the larger of the distance to the codewords'
bisector and the distance to the codeword less the cell's radius).  Where it
stops is measured: some query vectors are compared with all rows by brute
force, and the limit is the largest bound of the farthest link of any of them.
With too few linked ones among them for the target recall, every cell that can
hold a link is visited.  Candidates are verified by their cosine in double
precision.

Equal vectors are one class with a weight.  The vectors that meet in a cell are
compared in blocks of bounded size, which give link counts and a spanning
forest of the links, never the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailguard.llm.common import connected_components, cut
from mailguard.operators.joins import weighted_lookup

SAMPLE = 16_384     # vectors that codebooks are fitted on, at most
BLOCK = 1024        # rows of one side of a comparison
QUERIES = 16_384    # vectors that the recall is measured with, against all rows, at most
LEAST_CELLS = 4     # nearest cells visited whatever the measured limit


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means centres of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def spacing(centres: np.ndarray) -> np.ndarray:
    """Distances between the codewords."""
    return np.sqrt(_squares(centres, centres))


def bounds(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each row, and squared lower bounds of its distance to every codeword's cell;
    ``spaces`` is the codewords' ``spacing``."""
    sq = _squares(x, centres)
    own = sq.argmin(1)
    least = np.take_along_axis(sq, own[:, None], 1)
    apart = spaces[own]
    bisector = np.divide(sq - least, 2 * apart, out=np.zeros_like(sq), where=apart > 1e-9)
    low = np.maximum(np.maximum(bisector, np.sqrt(sq) - radii), 0)
    low[np.arange(len(x)), own] = 0
    return own, np.maximum(low - 1e-7, 0) ** 2


def _ascending(low: np.ndarray, limit: float, least: int) -> np.ndarray:
    """Codewords by ascending bound, as far as a cell of the traversal can have them."""
    near = np.flatnonzero(low <= limit)
    return near[low[near].argsort(kind="stable")] if len(near) >= least else low.argsort(kind="stable")


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float, least: int = 1) -> list[tuple[int, int]]:
    """Cells (i, j) in ascending ``a[i] + b[j]`` up to ``limit``, but ``least`` cells at the fewest."""
    oa, ob = _ascending(a, limit, least), _ascending(b, limit, least)
    sa, sb = a[oa].tolist(), b[ob].tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap and (heap[0][0] <= limit or len(out) < least):
        _, i, j = heapq.heappop(heap)
        out.append((int(oa[i]), int(ob[j])))
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a binary column of scaled ones."""
    x = np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: the vector over its largest component (so that squares stay finite), as the bytes of its
    doubles, so equal vectors group and join as plain bytes; null if it is null, empty, zero or holds a
    null or non-finite component, or if the id is null.  Materialised: it is read three times."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.columns
            sizes = pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
            # An inner null becomes NaN here; zero is added so that -0.0 and 0.0 have the same bytes.
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            out = []
            for known, s, e in zip(ids.is_valid().to_pylist(), ends - sizes, ends, strict=True):
                big = np.abs(x[s:e]).max() if e > s else 0.0
                out.append((x[s:e] / big + 0.0).astype("<f8").tobytes() if known and 0 < big < np.inf else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["id", "v"])

    return cut(rows.mapInArrow(run, "id long, v binary"))


def classes_of(rows: DataFrame) -> DataFrame:
    """``cid, rep`` (smallest id), ``n, v`` per distinct vector; materialised, so ``cid`` stays."""
    return cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
               .select(F.monotonically_increasing_id().alias("cid"), "rep", "n", "v"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample: int = SAMPLE, occupancy: int = 8,
                    block: int = BLOCK, target_recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding",
                    queries: int = QUERIES) -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row.

    ``n_links`` counts the other rows with cosine >= ``threshold``,
    ``component_id`` is the smallest id reachable by links, ``kept`` says that
    it is the row's own.  Every row is indexed; ``sample`` bounds only what the
    codebooks are fitted on, ``occupancy`` is the wanted number of vectors a
    cell and ``target_recall`` that of the rows whose links are all found (1:
    every cell that can hold one is visited; see ``_measured_limit``).  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; neither do vectors of different length, nor
    rows with a null id (no links, component null, kept false).  Rows that repeat an id
    link like any others.  An empty table gives no rows; other columns are
    ignored.
    """
    rows = scaled(vectors, id_col, vector_col)
    classes = classes_of(rows)
    dims = [r["d"] for r in classes.select((F.length("v") / 8).cast("int").alias("d")).distinct().orderBy("d").limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("over 1000 different vector lengths")
    found = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    for d in dims:
        found = found.union(_links(classes.where(F.length("v") == 8 * d), d, threshold, sample, occupancy, block, target_recall, queries))
    found = cut(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    grouped = (classes.select("cid", "rep", "n", "v").join(comp, F.col("cid") == F.col("node"), "left")
               .withColumn("component", F.coalesce("component", "cid")))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = (grouped.join(counts, "cid", "left").join(smallest, "component")
                .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.where("v is not null").join(labelled, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (linked.union(alone)
            .select(F.col("id").alias(id_col), "n_links", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _links(classes: DataFrame, dim: int, threshold: float, sample: int, occupancy: int, block: int,
           target_recall: float, queries: int) -> DataFrame:
    """``a, b, n``: rows (class, null, number of linked rows) and forest edges (class, class, 0)."""
    sc = classes.sparkSession.sparkContext
    total = classes.count()
    half = dim // 2
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("v").toArrow().column(0).combine_chunks()
    train = _matrix(picked, dim)
    k = max(1, min(len(train) // 8, round((total / occupancy) ** 0.5)))
    books = sc.broadcast((codebook(train[:, :half], k), codebook(train[:, half:], k)) if half else None)
    limit = 2 - 2 * threshold + 1e-9     # squared distance of unit vectors at the threshold

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.zeros(len(c)) for c in books.value]
        for big in batches:
            for at in range(0, big.num_rows, 512):
                x = _matrix(big.column(0).slice(at, 512), dim)
                for t, c, own in zip(top, books.value, (x[:, :half], x[:, half:]), strict=True):
                    sq = _squares(own, c)
                    np.maximum.at(t, sq.argmin(1), np.sqrt(sq.min(1)))
        rows = [(i, j, r) for i, t in enumerate(top) for j, r in enumerate(t)]
        i, j, r = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(r)], names=["i", "j", "r"])

    if not half:   # one component: all unit vectors are +1 or -1, classes of equal vectors say it all
        return classes.sparkSession.createDataFrame([], "a long, b long, n long")
    tops = classes.select("v").mapInArrow(radii, "i int, j int, r double").groupBy("i", "j").agg(F.max("r").alias("r"))
    reach = [np.zeros(k), np.zeros(k)]
    for i, j, r in tops.collect():       # two rows for each codeword
        reach[i][j] = r
    reach_b = sc.broadcast(reach)
    if target_recall < 1:
        asked = classes.orderBy(F.xxhash64("cid", F.lit(5)), "cid").limit(queries).select("cid", "v").toArrow()
        limit = _measured_limit(classes, asked, dim, books, reach_b, threshold, limit, target_recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c1, c2), (r1, r2) = books.value, reach_b.value
        s1, s2 = spacing(c1), spacing(c2)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                x = _matrix(b.column(2), dim)
                own1, low1 = bounds(x[:, :half], c1, r1, s1)
                own2, low2 = bounds(x[:, half:], c2, r2, s2)
                rows, cells, homes = [], [], []
                for i in range(len(x)):
                    home = int(own1[i]) * k + int(own2[i])
                    for p, q in multi_sequence(low1[i], low2[i], limit, LEAST_CELLS):
                        if p * k + q >= home:        # each pair of cells is met from the lower one
                            rows.append(i)
                            cells.append(p * k + q)
                            homes.append(p * k + q == home)
                for s in range(0, len(rows), 4096):
                    took = b.take(pa.array(rows[s:s + 4096]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cells[s:s + 4096], pa.int32()),
                                                      pa.array(homes[s:s + 4096])], names=["cid", "n", "v", "cell", "home"])

    visits = cut(classes.select("cid", "n", "v").mapInArrow(visit, "cid long, n long, v binary, cell int, home boolean"))
    sizes = cut(visits.groupBy("cell").agg(F.count_if("home").alias("own"), F.count("*").alias("rows")).where("own > 0 and rows > 1")
                .withColumn("weight", F.col("rows")))
    # A cell's residents and visitors meet in blocks (x, y): residents of block x with everybody of block y.
    dealt = (weighted_lookup(visits, sizes, ["cell"], "weight")
             .withColumn("xs", F.ceil(F.col("own") / block).cast("int")).withColumn("ys", F.ceil(F.col("rows") / block).cast("int"))
             .withColumn("hx", F.pmod(F.xxhash64("cid"), F.col("xs")).cast("int"))
             .withColumn("hy", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("ys")).cast("int")))
    left = dealt.where("home").select("cell", F.col("hx").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"),
                                      F.lit(True).alias("left"), "home", "cid", "n", "v")
    right = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.col("hy").alias("y"),
                         F.lit(False).alias("left"), "home", "cid", "n", "v")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (left.union(right).repartition(n, "cell", "x", "y").sortWithinPartitions("cell", "x", "y")
            .mapInArrow(_verify(dim, threshold), "a long, b long, n long"))


def _measured_limit(classes: DataFrame, asked: pa.Table, dim: int, books, reach, threshold: float, limit: float,
                    target: float) -> float:
    """Bound up to which every link of the vectors ``asked`` lies, measured against all rows.

    Each linked vector counts once, by its farthest link, however many links it
    has.  With n of them drawn at random, the expected share of linked vectors
    that have a link beyond the largest is 1 / (n + 1).  So fewer than
    1 / (1 - target) keep the whole ``limit``.
    """
    unit = _matrix(asked.column(1).combine_chunks(), dim)
    half = dim // 2
    held = classes.sparkSession.sparkContext.broadcast((asked.column(0).to_numpy(), unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c1, c2), (r1, r2), (cid, q) = books.value, reach.value, held.value
        s1, s2 = spacing(c1), spacing(c2)
        (q1, low1), (q2, low2) = bounds(q[:, :half], c1, r1, s1), bounds(q[:, half:], c2, r2, s2)
        far, q, order = np.full(len(q), -1.0), q.astype(np.float32), np.argsort(cid)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                x, own = _matrix(b.column(1), dim), b.column(0).to_numpy()
                # Single precision with a margin: a pair just below the threshold can only raise the bound.
                near = x.astype(np.float32) @ q.T >= threshold - 1e-5
                place = order[np.minimum(np.searchsorted(cid, own, sorter=order), len(cid) - 1)]
                same = np.flatnonzero(cid[place] == own)
                near[same, place[same]] = False
                j, i = np.nonzero(near)
                (x1, up1), (x2, up2) = bounds(x[:, :half], c1, r1, s1), bounds(x[:, half:], c2, r2, s2)
                # The traversal starts from the lower of the two cells.
                lower = q1[i] * len(c2) + q2[i] <= x1[j] * len(c2) + x2[j]
                low = np.where(lower, low1[i, x1[j]] + low2[i, x2[j]], up1[j, q1[i]] + up2[j, q2[i]])
                np.maximum.at(far, i, low)
        i = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(far[i])], names=["i", "far"])

    linked = (classes.select("cid", "v").mapInArrow(run, "i long, far double").groupBy("i").agg(F.max("far").alias("far"))
              .agg(F.count("*").alias("n"), F.max("far").alias("far")).first())
    if linked["n"] < 1 / (1 - target) - 1e-6:
        return limit
    return min(limit, 1.5 * linked["far"] + 1e-9)


def _verify(dim: int, threshold: float):
    """mapInArrow over rows sorted by (cell, x, y): link counts and forest edges of every block pair."""

    def settle(cols: list[np.ndarray], unit: np.ndarray) -> list[tuple]:
        left, home, rep, n = cols
        r, v = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(r) or not len(v):
            return []
        cos = unit[r] @ unit[v].T
        # Two residents meet in both orders; each order counts the right one's weight for the left one.
        link = (cos >= threshold) & (rep[r][:, None] != rep[v][None, :])
        out = [(int(rep[a]), None, int(w)) for a, w in zip(r, link @ n[v], strict=True) if w]
        back = (n[r] @ link) * ~home[v]
        out += [(int(rep[b]), None, int(w)) for b, w in zip(v, back, strict=True) if w]
        # Spanning forest: breadth first over rows, each reaching what is not reached yet.
        todo, fresh = set(range(len(r))), np.ones(len(v), bool)
        while todo:
            queue = [todo.pop()]
            while queue:
                i = queue.pop()
                for j in np.flatnonzero(link[i] & fresh).tolist():
                    fresh[j] = False
                    out.append((int(rep[r[i]]), int(rep[v[j]]), 0))
                    for k in np.flatnonzero(link[:, j]).tolist():
                        if k in todo:
                            todo.discard(k)
                            queue.append(k)
                            out.append((int(rep[r[k]]), int(rep[v[j]]), 0))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def flush() -> list[tuple]:
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            held.clear()
            return settle(cols[:4], cols[4])

        for b in batches:
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:3]], axis=1).astype(np.int64)
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)]
            cols[0], cols[1] = cols[0].astype(bool), cols[1].astype(bool)
            unit = _matrix(b.column(7), dim)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            out: list[tuple] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if e == s:
                    continue
                if held and tuple(key[s]) != current:
                    out += flush()
                current = tuple(key[s])
                held.append((*(c[s:e] for c in cols), unit[s:e]))
            if out:
                yield batch(out)
        if held:
            yield batch(flush())

    return run
