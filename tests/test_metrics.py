"""Count-table metric algorithms against brute force on a small fixture."""

import random

from mailguard.operators import metrics as M
from mailguard.operators import profile as P


def data(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(f"p{i}", "malicious" if rnd.random() < 0.4 else "benign", rnd.randint(0, 20) / 20)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "path string, target_1 string, p double")


def test_roc_auc_matches_pairwise(spark):
    rows, df = data(spark)
    pos = [p for _, y, p in rows if y == "malicious"]
    neg = [p for _, y, p in rows if y != "malicious"]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = M.roc_auc(df, "target_1", "p").first()["roc_auc"]
    assert abs(got - round(brute, 6)) < 1e-9


def test_threshold_sweep_matches_brute_force(spark):
    rows, df = data(spark)
    got = {r["threshold"]: (r["f1"], r["fpr"]) for r in M.threshold_sweep(spark, df, "target_1", "p").collect()}
    for i in range(1, 100):
        t = i / 100.0
        tp = sum(1 for _, y, p in rows if y == "malicious" and p >= t)
        fp = sum(1 for _, y, p in rows if y != "malicious" and p >= t)
        fn = sum(1 for _, y, p in rows if y == "malicious" and p < t)
        tn = sum(1 for _, y, p in rows if y != "malicious" and p < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        fpr = fp / (fp + tn) if (fp + tn) else 0.0
        assert got[t] == (round(f1, 6), round(fpr, 6)), t


def test_rank_desc_matches_sql_rank(spark):
    rows, df = data(spark)
    got = {r["path"]: r["rank"] for r in P.rank_desc(df, "p").collect()}
    for path, _, p in rows:
        assert got[path] == 1 + sum(1 for _, _, q in rows if q > p)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([("benign", "benign"), ("benign", "malicious"), ("malicious", "malicious"),
                                ("malicious", "benign"), ("malicious", "malicious")], "target_1 string, pred string")
    cm = M.confusion(df, "target_1", "pred").first().asDict()
    assert cm == {"benign_as_benign": 1, "benign_as_malicious": 1, "malicious_as_benign": 1,
                  "malicious_as_malicious": 2}
    m = M.model_metrics(df, "target_1", "pred").first()
    assert (m["precision"], m["recall"], m["support"]) == (0.5, 0.5, 2)
    assert (m["false_malicious_rate"], m["false_benign_rate"]) == (0.5, round(1 / 3, 6))


def test_legacy_argmax_first_column_wins(spark):
    df = spark.createDataFrame([(2, 2, 0, 0), (0, 3, 3, 1), (0, 0, 0, 0), (1, 0, 0, 4)],
                               "a int, b int, c int, d int")
    got = [r[0] for r in df.select(M.legacy_argmax("a", "b", "c", "d")).collect()]
    assert got == ["malicious", "benign", "malicious", "benign"]
