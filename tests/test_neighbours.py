"""Exact neighbour joins, DBSCAN, SMOTE and ADASYN against brute force: many cells, split blocks, copies, unusable vectors."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailguard.operators import neighbours as N
from mailguard.operators import oversampling as O

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, cell int, reach double, rank int"
ODD = [(9001, None), (9002, []), (9003, [0.0] * 4), (9004, [1.0, float("nan"), 0.0, 0.0]), (9005, [None, 1.0, 0.0, 0.0]), (None, [1.0] * 4)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 4))
    rows = [(i, centres[i % 9] + 0.1 * rng.normal(size=4) * (1 + i % 3)) for i in range(240)]
    rows += [(1000 + i, centres[2]) for i in range(80)]                    # equal vectors
    rows += [(2000 + i, centres[5] + 0.01 * rng.normal(size=4)) for i in range(70)]     # one dense group
    rows += [(3000 + i, rng.normal(size=4)) for i in range(30)]
    return [(i, x.tolist()) for i, x in rows]


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, x, 0 if i is not None and i % 7 == 0 else 1, "x", 1, 2, 0.5, 3) for i, x in [*points, *ODD, *points[:20]]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(params=[(1000, 1024), (25, 16)], ids=["one cell", "many cells and blocks"])
def small_cells(request, monkeypatch):
    """Cell and block sizes; the small ones split the hot cell into several blocks."""
    cells, blocks = request.param
    init, split = N.Cells.__init__, N.Cells.blocks
    monkeypatch.setattr(N.Cells, "__init__", lambda self, p, cell_rows=cells: init(self, p, cells))
    monkeypatch.setattr(N.Cells, "blocks", lambda self, a, b: split(self, a, b, blocks))


def by_hand(points, eps, min_samples):
    ids = np.array([i for i, _ in points])
    x = np.array([v for _, v in points])
    x /= np.sqrt((x ** 2).sum(1, keepdims=True))
    near = x @ x.T >= 1 - eps
    core = near.sum(1) >= min_samples
    label = {}
    for s in np.argsort(ids):
        if core[s] and ids[s] not in label:
            queue = [s]
            label[ids[s]] = ids[s]
            while queue:
                for c in np.flatnonzero(near[queue.pop()]):
                    if ids[c] not in label:
                        label[ids[c]] = ids[s]
                        if core[c]:
                            queue.append(c)
    return {int(i): (int(n), bool(c), int(label.get(i, -1))) for i, n, c in zip(ids, near.sum(1), core, strict=True)}


@pytest.mark.parametrize(("eps", "min_samples"), [(0.001, 4), (0.02, 3), (0.3, 12)])
def test_dbscan_equals_brute_force(table, points, small_cells, eps, min_samples):
    want = by_hand(points, eps, min_samples) | dict.fromkeys(range(9001, 9006), (0, False, -1))
    got = {r.vec_id: (r.n_neighbours, r.is_core, r.cluster_id) for r in N.dbscan(table, eps, min_samples).collect()}
    assert got == want
    counts = {r.vec_id: r.n_neighbours for r in N.radius_counts(table, eps).collect()}
    assert counts == {i: n for i, (n, _, _) in want.items() if i < 9000}


def test_dbscan_of_nothing(table):
    assert N.dbscan(table.limit(0), 0.1, 2).count() == 0
    assert [r.cluster_id for r in N.dbscan(table.where("vec_id = 9003"), 0.1, 1).collect()] == [-1]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1200)] + [(5000 - i, 5000) for i in range(1, 9)] + [(7, 7)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {i: 4992 for i in range(4992, 5001)}


def nearest_by_hand(points, asked, k):
    out = {}
    for q, y in asked:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, x in points if i != q)
        out[q] = [(i, round(s, 9)) for s, i in d[:k]]
    return out


def test_k_nearest_equals_brute_force(spark, table, points, small_cells):
    usable = [*points, (9003, [0.0] * 4)]
    asked = [p for p in usable if p[0] % 5 == 0]
    got = {}
    for r in sorted(N.k_nearest(table, table.where("vec_id % 5 = 0"), 6).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append((r.neighbour_id, round(r.distance, 9)))
    want = nearest_by_hand(usable, asked, 6)
    assert got.keys() == {q for q, _ in asked if q in dict(usable)} and got == want
    few = table.where("vec_id in (0, 1, 2)")
    assert Counter(r.id for r in N.k_nearest(few, few, 6).collect()) == {0: 2, 1: 2, 2: 2}
    assert N.k_nearest(table.limit(0), table, 3).count() == 0


def test_smote_and_adasyn(table, points):
    rare = {i: np.array(x) for i, x in [*points, (9003, [0.0] * 4)] if i % 7 == 0}
    usable = [*points, (9003, [0.0] * 4)]
    want = len(usable) - 2 * len(rare)
    for made, near in ((O.smote(table, "label", 0, 4), None), (O.adasyn(table, "label", 0, 4), None)):
        rows = made.collect()
        assert len(rows) == want
        assert len({(r.base_id, r.step) for r in rows}) == want
        own = nearest_by_hand(list(rare.items()), list(rare.items()), 4)
        for r in rows:
            a, b = rare[r.base_id], rare[r.neighbour_id]
            assert r.neighbour_id in [i for i, _ in own[r.base_id]] and 0 <= r.u < 1
            assert np.allclose(r.vector, a + r.u * (b - a), atol=1e-12)
    per_row = Counter(r.base_id for r in O.smote(table, "label", 0, 4).collect())
    assert set(per_row.values()) <= {want // len(rare), want // len(rare) + 1}
    near = nearest_by_hand(usable, list(rare.items()), 4)
    dense = {q: sum(i not in rare for i, _ in n) for q, n in near.items()}
    quotas = {r.id: (r.n_majority, r.quota) for r in O.adasyn_quotas(table, "label", 0, 4).collect()}
    assert {q: c for q, (c, _) in quotas.items()} == dense and sum(n for _, n in quotas.values()) == want
    assert all(abs(n - dense[q] * want / sum(dense.values())) < 1 for q, (_, n) in quotas.items())
    assert all(n >= m for c, n in quotas.values() for d, m in quotas.values() if c > d)


def test_oversampling_corner_cases(spark, table):
    assert O.smote(table.where("label = 1"), "label", 0).count() == 0
    assert O.adasyn(table.where("label = 1"), "label", 0).count() == 0
    alone = table.where("vec_id in (0, 1, 2, 3)")
    rows = O.smote(alone, "label", 0).collect()
    assert [(r.base_id, r.step, r.neighbour_id) for r in sorted(rows)] == [(0, 1, None), (0, 2, None)]
    assert all(r.vector == table.where("vec_id = 0").first().embedding for r in rows)
    assert O.smote(alone.withColumn("label", F.lit(None).cast("int")), "label", 0).count() == 0


def test_no_product_of_all_rows(table):
    """The plan joins on cells and ids only; the copies of a vector meet as one class."""
    plan = N.dbscan(table, 0.02, 3)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert N._classes(table, "vec_id", "embedding")[1].where("weight = 80").count() == 1


def test_scratch_rows_do_not_multiply_with_the_cells(spark, monkeypatch, tmp_path):
    """a radius that reaches every cell sends no vector to each of them; tiles, groups and spans of several."""
    rng = np.random.default_rng(5)
    points = [(-(2 ** 60) + i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 24)))]
    table = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(4)
    init = N.Cells.__init__
    monkeypatch.setattr(N.Cells, "__init__", lambda self, p, cell_rows=10: init(self, p, cell_rows))
    monkeypatch.setattr(N, "BLOCK_ROWS", 6)
    monkeypatch.setattr(N, "GROUP_TILES", 3)
    monkeypatch.setattr(N, "SPAN_TILES", 7)
    old = spark.sparkContext.getCheckpointDir()
    monkeypatch.setattr(N, "checkpoint_dir", lambda _: str(tmp_path))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        got = {r.vec_id: (r.n_neighbours, r.is_core, r.cluster_id) for r in N.dbscan(table, 0.55, 4).collect()}
        near = {(r.id, r["rank"]): r.neighbour_id for r in N.k_nearest(table, table.where("vec_id % 4 = 0"), 3, cell_rows=10).collect()}
        size = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    finally:
        if old:
            spark.sparkContext.setCheckpointDir(old)
    assert got == by_hand(points, 0.55, 4)
    assert near == {(q, k): i for q, found in nearest_by_hand(points, [p for p in points if p[0] % 4 == 0], 3).items()
                    for k, (i, _) in enumerate(found, 1)}
    assert size < 20 * 400 * 24 * 8
