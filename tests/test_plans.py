"""Plan checks: the feature plan stays JVM-side, scans are pruned."""

from mailguard.plans.feature_queries import email_features
from mailguard.plans.profile_queries import lineitem_describe

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_has_no_python(spark):
    p = plan(email_features(spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(lineitem_describe(spark, SF))
    assert "l_comment" not in p and "l_shipdate" not in p
    assert "l_quantity" in p


NO_CROSS = ["score_threshold_sweep", "score_roc_auc", "scores_ranked", "score_nearest_thresholds",
            "stratified_split_counts", "stratified_sample_200", "fold_assignment_counts",
            "per_folder_sample", "class_weights", "topic_npmi", "tfidf_top_keywords",
            "partial_feature_cache_check", "email_features", "url_probe_features"]


def test_no_cross_or_nested_loop_joins(spark):
    from mailguard.plans.registry import load_all
    reg = load_all()
    for name in NO_CROSS:
        p = plan(reg[name].build(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
