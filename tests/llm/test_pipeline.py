"""Stages of the corpus pipeline: what goes, what stays, and the columns."""

import corpus_pipeline as cp
from mailguard.llm import simhash, suffix_dedup
from mailguard.llm.entry import op8_toxicity

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    clean = cp.cut(cp.toxicity_stage(spark, docs, SF))
    assert clean.columns == names
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in op8_toxicity(spark, SF).where("predicted = 0").select("doc_id").collect()}
    kept = cp.cut(cp.simhash_stage(spark, clean, SF))
    want = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert kept.columns == names and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(want)
    rows = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    short = cp.cut(cp.suffix_stage(spark, kept, SF))
    assert short.columns == names
    for r, (_, runs, _) in zip(sorted(rows), suffix_dedup.brute_force([rows[i] for i in sorted(rows)]), strict=True):
        raw, at, rest = (rows[r] or "").encode(), 0, b""
        for s, e in runs:
            rest, at = rest + raw[at:s], e
        got = short.where(f"doc_id = {r}").first() if runs else None
        assert got is None or (got.text, got.n_chars) == ((t := (rest + raw[at:]).decode("utf-8", "ignore")), len(t))


def test_stages_on_awkward_rows(spark, edge_docs):
    count = edge_docs.count()
    assert cp.toxicity_stage(spark, edge_docs, SF).columns == edge_docs.columns
    groups = cp.simhash_stage(spark, edge_docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in groups) == [0, 1, 2, 5, 8, 8]
    for stage in (cp.suffix_stage, cp.pii_stage):
        out = stage(spark, edge_docs, SF)
        assert out.columns == edge_docs.columns and out.count() == count
        assert all(r.row == "x" and r.n_chars == len(r.text) for r in out.collect())
    assert cp.packing_stage(spark, edge_docs, SF).count() >= count
    for _, stage in cp.STAGES:
        assert stage(spark, edge_docs.limit(0), SF).count() == 0
