"""Exact top-k search with cover trees on both sides (operator 6).

Data and queries go through the same steps: rows are grouped around the same
pivots into blocks of bounded size, and a task builds one cover tree a block.
A node's children cover its rows at the next lower scale, scales being powers
of ``BASE``; a node whose children would mostly be single rows is a leaf.

Pairs are pruned by covering radii from the top down: a query block against the
balls of the pivots, then against the balls of those pivots' blocks, then tree
against tree.  A query node drops the data nodes whose bound is below the worst
kth score that its queries have; first the data block of highest bound gives
every query such a score.  Data trees stay in place while the query blocks that
need them stream past, so a task holds one of each.

Scores are integer inner products.  For balls with centres ``a`` and ``b`` and
radii ``r`` and ``s`` they are at most ``a.b + r|b| + s|a| + rs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailguard.llm.common import cut, give_back, small_batches

PIVOTS = 64              # farthest-first pivots, taken from a bounded sample
SAMPLE = 4096
BLOCK_BYTES = 1 << 19    # of the vectors of a data block, about; a query block has a quarter
STREAM = 64              # query blocks that pass one copy of a data tree
LEAF = 32
BASE = 1.3               # ratio of two scales


class CoverTree:
    """Nodes in arrays, children side by side; node ``i`` covers rows ``lo[i]:hi[i]`` within ``radius[i]`` of row ``centre[i]``."""

    PARTS = ("lo", "hi", "first", "last", "centre")

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.ids, self.x, self.nodes, self.radius = ids, x, nodes, radius
        self.lo, self.hi, self.first, self.last, self.centre = nodes
        self.middle = x[self.centre]
        self.norm = np.sqrt((self.middle ** 2).sum(1))

    @classmethod
    def grow(cls, ids: np.ndarray, x: np.ndarray) -> CoverTree:
        order = np.arange(len(x))
        root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        nodes, radius = [[0, len(x), 0, 0, root]], [0.0]
        i = 0
        while i < len(nodes):
            lo, hi, _, _, centre = nodes[i]
            rows = order[lo:hi]
            far = np.sqrt(((x[rows] - x[centre]) ** 2).sum(1))
            radius[i] = float(far.max())
            kids = cls._cover(x, rows, centre, far, radius[i]) if hi - lo > LEAF and radius[i] > 0 else []
            if kids:
                nodes[i][2:4] = len(nodes), len(nodes) + len(kids)
                at = lo
                for c, own in kids:
                    order[at:at + len(own)] = own
                    nodes.append([at, at + len(own), 0, 0, c])
                    radius.append(0.0)
                    at += len(own)
            i += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        table = np.array(nodes, np.int64).T
        table[4] = place[table[4]]
        return cls(ids[order], x[order], table, np.array(radius) * (1 + 1e-9))

    @staticmethod
    def _cover(x: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Centres more than the next scale apart and the rows that each is the first to cover; none if most are alone."""
        scale = BASE ** (np.ceil(np.log(radius) / np.log(BASE)) - 1)
        kids, left, most = [], rows, len(rows) // 4
        while len(left):
            near = far if not kids else np.sqrt(((x[left] - x[centre]) ** 2).sum(1))
            inside = near <= scale
            kids.append((centre, left[inside]))
            left = left[~inside]
            if len(kids) > most:
                return []
            if len(left):
                centre = int(left[0])
        return kids if len(kids) > 1 else []

    def pack(self) -> bytes:
        small = np.abs(self.x).max(initial=0) < 2 ** 24
        head = np.array([len(self.ids), self.x.shape[1], self.nodes.shape[1], small], np.int64)
        return b"".join([head.tobytes(), self.ids.tobytes(), self.nodes.tobytes(), self.radius.tobytes(),
                         self.x.astype(np.float32 if small else np.float64).tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> CoverTree:
        n, dim, m, small = np.frombuffer(raw, np.int64, 4).tolist()
        ids, nodes = np.frombuffer(raw, np.int64, n, 32), np.frombuffer(raw, np.int64, 5 * m, 32 + 8 * n)
        at = 32 + 8 * n + 40 * m
        radius = np.frombuffer(raw, np.float64, m, at)
        x = np.frombuffer(raw, np.float32 if small else np.float64, n * dim, at + 8 * m)
        return cls(ids, x.astype(np.float64).reshape(n, dim), nodes.reshape(5, m), radius)


class DualSearch:
    """Best ``k`` ids of every row of ``q`` among those of ``x``; ``floor`` are scores that queries reach already."""

    def __init__(self, q: CoverTree, x: CoverTree, k: int, floor: np.ndarray):
        self.q, self.x, self.k = q, x, k
        self.worst = floor.astype(np.float64)
        self.best: list[dict[int, int]] = [{} for _ in q.ids]
        self._node(0, np.zeros(1, np.int64))

    def _near(self, i: int, nodes: np.ndarray) -> np.ndarray:
        """Data nodes that may still help a query of node ``i``, highest bound first; a tie may win by its id."""
        q, x = self.q, self.x
        r, s = q.radius[i], x.radius[nodes]
        bound = x.middle[nodes] @ q.middle[i] + r * x.norm[nodes] + s * q.norm[i] + r * s + 1e-3
        order = np.argsort(-bound, kind="stable")
        return nodes[order[bound[order] >= self.worst[q.lo[i]:q.hi[i]].min()]]

    def _node(self, i: int, nodes: np.ndarray) -> None:
        q, x = self.q, self.x
        nodes = self._near(i, nodes)
        if q.last[i] > q.first[i]:
            # Data nodes wider than this query node are opened before its children go on.
            wide = (x.radius[nodes] >= q.radius[i]) & (x.last[nodes] > x.first[nodes])
            nodes = np.concatenate([nodes[~wide], *(np.arange(x.first[j], x.last[j]) for j in nodes[wide])])
            for child in range(q.first[i], q.last[i]):
                self._node(child, nodes)
            return
        while len(nodes):
            j, nodes = int(nodes[0]), nodes[1:]
            if x.last[j] > x.first[j]:
                nodes = np.concatenate([np.arange(x.first[j], x.last[j]), nodes])
            else:
                self._score(i, j)
            nodes = self._near(i, nodes)

    def _score(self, i: int, j: int) -> None:
        q, x = self.q, self.x
        lo, cols = int(q.lo[i]), slice(int(x.lo[j]), int(x.hi[j]))
        score = np.rint(q.x[lo:q.hi[i]] @ x.x[cols].T)
        ids = x.ids[cols]
        good = (score >= self.worst[lo:q.hi[i], None]) & (ids != q.ids[lo:q.hi[i], None])
        for r in np.flatnonzero(good.any(1)).tolist():
            own, line = self.best[lo + r], score[r]
            picked = np.flatnonzero(good[r])
            for c in picked[np.argsort(-line[picked], kind="stable")].tolist():
                if line[c] < self.worst[lo + r]:
                    break
                self._offer(lo + r, own, int(ids[c]), int(line[c]))

    def _offer(self, row: int, own: dict[int, int], vec: int, score: int) -> None:
        if own.get(vec, score - 1) >= score:
            return
        own[vec] = score
        if len(own) > self.k:
            del own[min(own, key=lambda v: (own[v], -v))]
        if len(own) == self.k:
            self.worst[row] = max(self.worst[row], min(own.values()))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def integer_rows(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: floor(scale * component) of rows without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return (rows.where("id is not null and size(v) > 0")
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v")))


def pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first pivots."""
    chosen = [0]
    dist = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def blocks(rows: DataFrame, dim: int, centres, block_rows: int) -> DataFrame:
    """``pivot, block, centre, radius, ids, tree``: one packed cover tree per block of about ``block_rows`` rows."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=["id", "v", "pivot"])

    near = cut(rows.mapInArrow(assign, "id long, v array<double>, pivot int"))
    sizes = F.broadcast(near.groupBy("pivot").agg(F.count("*").alias("size")))     # at most PIVOTS rows
    placed = (near.join(sizes, "pivot")
              .withColumn("part", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("size") / block_rows)).cast("int"))
              .select("pivot", "part", "id", "v"))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        tree = CoverTree.grow(group.column("id").to_numpy(), np.concatenate([_matrix(c, dim) for c in group.column("v").chunks]))
        return pa.table({"pivot": pa.array([key[0].as_py()], pa.int32()), "block": [f"{key[0].as_py()}-{key[1].as_py()}"],
                         "centre": [tree.middle[0].tolist()], "radius": [tree.radius[0]],
                         "ids": pa.array([tree.ids.tolist()], pa.list_(pa.int64())), "tree": pa.array([tree.pack()], pa.binary())})

    return placed.groupBy("pivot", "part").applyInArrow(
        build, "pivot int, block string, centre array<double>, radius double, ids array<long>, tree binary")


def _stream(k: int):
    """mapInArrow over ``group, tree, floors`` sorted by group, its data tree first (null floors), then query trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for b in batches:
            for i in range(b.num_rows):
                tree = CoverTree.unpack(b.column(1)[i].as_py())
                floors = b.column(2)[i].as_py()
                if floors is None:
                    x = tree
                    continue
                known = dict(floors)
                floor = np.array([known.get(n, -np.inf) for n in tree.ids.tolist()])
                best = DualSearch(tree, x, k, floor).best
                out = [(n, vec, score) for n, own in zip(tree.ids.tolist(), best, strict=True) for vec, score in own.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                     names=["query_id", "vec_id", "score"])
        give_back()

    return run


def _against(balls):
    """mapInArrow over ``block, centre, radius``: every block with every pivot's ball (pivot, centre, radius) and their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, centre, s = (np.array(c) for c in zip(*balls.value, strict=True))
        for b in batches:
            a, r = _matrix(b.column(1), centre.shape[1]), b.column(2).to_numpy()[:, None]
            high = a @ centre.T + r * np.sqrt((centre ** 2).sum(1)) + s * np.sqrt((a ** 2).sum(1))[:, None] + r * s + 1.0
            again = pa.array(np.repeat(np.arange(b.num_rows), len(s)))
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns), pa.array(np.tile(pivot, b.num_rows), pa.int32()),
                                              pa.array(high.ravel())], names=["qb", "qc", "qr", "pivot", "high"])

    return run


def _search_pairs(pairs: DataFrame, q: DataFrame, x: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """Candidates of the pairs of blocks ``qb, xb``: each data tree meets its query trees in groups of about ``STREAM``."""
    sizes = pairs.groupBy("xb").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("groups"))
    none = F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<double>"))
    asked = q.select(F.col("block").alias("qb"), "tree")
    asked = asked.join(floors.select("qb", "floors"), "qb", "left") if floors is not None else asked.withColumn("floors", none)
    sent = (pairs.join(sizes, "xb").join(asked, "qb")
            .select("xb", F.pmod(F.xxhash64("qb"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("kind"), "tree",
                    F.coalesce("floors", none).alias("floors")))
    trees = (x.select(F.col("block").alias("xb"), "tree").join(sizes, "xb")
             .select("xb", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("kind"), "tree",
                     F.lit(None).cast("map<long,double>").alias("floors")))
    stream = (trees.unionByName(sent).repartition("xb", "part").sortWithinPartitions("xb", "part", "kind")
              .select(F.concat_ws("/", "xb", "part").alias("group"), "tree", "floors"))
    return small_batches(stream).mapInArrow(_stream(k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest score for every query, itself excluded.

    Components become ``floor(scale * x)``; the score is their inner product;
    ties go to the smaller id; a query with fewer candidates gets them all.
    Rows whose vector is null, empty or holds null or non-finite components,
    or whose id is null, take no part, nor do vectors of another length than
    the query's.  Repeated rows are taken once (same id and vector); rows that
    share an id are one candidate of their best score.  Empty tables give no
    rows; other columns are ignored.  Products are exact up to 2**53.
    """
    spark = vectors.sparkSession
    data = cut(integer_rows(vectors, scale, id_col, vector_col).distinct())
    asked = cut(integer_rows(queries, scale, id_col, vector_col).distinct())
    dims = [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().orderBy("d").limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("over 1000 different vector lengths")
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for d in dims:
        out = out.union(_search_length(data.where(F.size("v") == d), asked.where(F.size("v") == d), d, k, block_bytes))
    return _best(out, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _search_length(data: DataFrame, asked: DataFrame, dim: int, k: int, block_bytes: int) -> DataFrame:
    spark = data.sparkSession
    picked = data.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(picked):
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    centres = spark.sparkContext.broadcast(pivots(_matrix(picked, dim), PIVOTS))
    rows = max(4, block_bytes // (4 * dim))
    x, q = cut(blocks(data, dim, centres, rows)), cut(blocks(asked, dim, centres, max(1, rows // 4)))
    zero = F.lit(0.0)

    def norm(c: str) -> Column:
        return F.sqrt(F.aggregate(c, zero, lambda s, v: s + v * v))

    def bound(a: str, r: Column, b: str, s: Column) -> Column:
        dot = F.aggregate(F.zip_with(a, b, lambda u, v: u * v), zero, lambda t, v: t + v)
        return dot + r * norm(b) + s * norm(a) + r * s + F.lit(1.0)

    balls = x.select("pivot", F.col("block").alias("xb"), F.col("centre").alias("xc"), F.col("radius").alias("xr"))
    # A pivot's ball is that of its first block, widened to hold the others.
    first_ball = balls.groupBy("pivot").agg(F.min_by(F.struct("xc"), "xb").alias("f")).select("pivot", F.col("f.xc").alias("pc"))
    apart = F.sqrt(F.aggregate(F.zip_with("pc", "xc", lambda u, v: (u - v) * (u - v)), zero, lambda t, v: t + v))
    tops = (balls.join(F.broadcast(first_ball), "pivot").groupBy("pivot")
            .agg(F.first("pc").alias("pc"), F.max(apart + F.col("xr")).alias("pr")))
    tops = spark.sparkContext.broadcast([tuple(r) for r in tops.collect()])        # at most PIVOTS balls
    near = cut(q.select("block", "centre", "radius").mapInArrow(_against(tops), "qb string, qc array<double>, qr double, pivot int, high double"))
    top = near.groupBy("qb").agg(F.max_by(F.struct("qc", "qr", "pivot"), F.struct("high", "pivot")).alias("b")).select("qb", "b.*")
    high = bound("qc", F.col("qr"), "xc", F.col("xr")).alias("high")
    first = cut(top.join(balls, "pivot").select("qb", "xb", high).groupBy("qb").agg(F.max_by("xb", F.struct("high", "xb")).alias("xb")))
    seeds = cut(_search_pairs(first, q, x, None, k))
    kth = _best(seeds, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    floors = cut(q.select(F.col("block").alias("qb"), F.explode("ids").alias("query_id")).join(kth, "query_id", "left").groupBy("qb")
                 .agg(F.map_from_entries(F.collect_set(F.when(F.col("kth").isNotNull(), F.struct("query_id", "kth")))).alias("floors"),
                      F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("least")))
    open_tops = near.join(floors.select("qb", "least"), "qb").where("high >= least").drop("high")
    rest = cut(open_tops.join(balls, "pivot").select("qb", "xb", "least", high).where("high >= least").select("qb", "xb")
               .join(first, ["qb", "xb"], "left_anti"))
    return seeds.union(_search_pairs(rest, q, x, floors, k))
