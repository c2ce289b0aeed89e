"""Oracle parity: Spark queries vs their DuckDB SQL at sf0.001 (fast subset;
the driver checks every registered query at sf0.01)."""

import pytest

from tools.parity import compare

FAST = ["dmarc_target_summary", "header_auth_features", "received_routing", "ip_address_classes",
        "content_features", "target_value_counts", "domain_target_top20", "email_column_profile",
        "score_threshold_sweep", "score_roc_auc", "model_comparison", "stratified_sample_200",
        "split_proportion_check", "tfidf_top_keywords", "topic_npmi", "legacy_json_roundtrip",
        "event_window_counts", "eml_roundtrip_metadata"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    res = compare(spark, "/root/testdata/sf0.001", {name}, verbose=False)
    assert res[name][0] == "OK", res[name]


def test_every_registered_query_has_docs_and_ops():
    from mailguard.plans.registry import load_all
    reg = load_all()
    assert len(reg) >= 85
    for name, q in reg.items():
        assert q.build.__doc__, name
        assert q.ops, name
