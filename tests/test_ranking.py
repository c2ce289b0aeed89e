"""Ranks, running sums and quantiles by range, against plain Python, on continuous scores and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailguard.operators import joins, metrics, profile, ranking


@pytest.fixture
def many_parts(spark):
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.random(3000), np.full(1500, 0.5), rng.integers(0, 101, 500) / 100])
    label = np.where(rng.random(len(score)) < 0.3 + 0.4 * score, "malicious", "benign")
    return [(i, str(y), float(s)) for i, (y, s) in enumerate(zip(label, score, strict=True))]


def test_positions_and_running_sums(spark, scored, many_parts):
    df = spark.createDataFrame(scored, "id long, y string, s double")
    got = {r.id: (r.at, r.total) for r in ranking.running(df, [F.col("s").desc(), F.col("id")], {
        "at": F.lit(1).cast("long"), "total": F.col("id")}).collect()}
    total = 0
    for at, (i, _, _) in enumerate(sorted(scored, key=lambda r: (-r[2], r[0])), 1):
        total += i
        assert got[i] == (at, total)
    assert ranking.positions(df.limit(0), [F.col("s")]).count() == 0


def test_sweep_auc_and_rank_on_continuous_scores(spark, scored, many_parts, monkeypatch):
    df = spark.createDataFrame(scored, "id long, y string, s double")
    pos, neg = ([s for _, y, s in scored if y == c] for c in ("malicious", "benign"))
    for r in metrics.threshold_sweep(spark, df, "y", "s").collect():
        tp, fp = sum(s >= r.threshold for s in pos), sum(s >= r.threshold for s in neg)
        assert r.f1 == pytest.approx(2 * tp / (tp + fp + len(pos)), abs=1e-6)
        assert r.fpr == pytest.approx(fp / len(neg), abs=1e-6)
    p, n = np.array(pos)[:, None], np.array(neg)
    assert metrics.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(((p > n) + 0.5 * (p == n)).mean(), abs=1e-6)
    every = np.array([s for _, _, s in scored])
    more = df.union(spark.createDataFrame([(90001, "x", None), (90002, "x", None)], df.schema))
    for hot in (joins.HOT_KEYS, 1):
        monkeypatch.setattr(joins, "HOT_KEYS", hot)
        for r in profile.rank_desc(more, "s").collect():
            assert r["rank"] == 1 + (len(every) if r.s is None else int((every > r.s).sum()))


def test_exact_quantiles(spark, scored, many_parts):
    rows = [(y, s) for _, y, s in scored] + [(None, 1.0), (None, 4.0), ("alone", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.share): r.quantile for r in ranking.exact_quantiles(df, "g", "x", shares).collect()}
    for g in {g for g, _ in rows} - {"none"}:
        own = [x for h, x in rows if h == g]
        for s in shares:
            assert got[g, s] == pytest.approx(np.quantile(own, s), abs=1e-12)
    assert len(got) == 4 * len(shares)


def test_no_single_partition_over_raw_scores(spark, scored):
    df = spark.createDataFrame(scored, "id long, y string, s double").where("s >= 0")
    plan = ranking.positions(df, [F.col("s")])._jdf.queryExecution().toString()
    windows = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "SinglePartition" in line]
    # The one window without a partition reads the sums of the ranges: it lies on an aggregate by range.
    assert len(windows) <= 1 and "rangepartitioning" not in "".join(windows)
