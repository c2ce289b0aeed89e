"""Stream = batch: the watermarked streaming window counts equal a
batch group-by over the same events."""

from pyspark.sql import functions as F

from mailguard.plans.stream_queries import event_window_counts
from mailguard.sources.tables import table_path

SF = "/root/testdata/sf0.001"


def test_stream_window_counts_equal_batch(spark):
    streamed = {(r["window_start"], r["event_type"]): r["n"]
                for r in event_window_counts(spark, SF).collect()}
    ev = spark.read.parquet(table_path(SF, "events"))
    batch = (ev.groupBy(F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")),
                                      "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type")
             .count().collect())
    assert streamed == {(r["w"], r["event_type"]): r["count"] for r in batch}
    assert sum(streamed.values()) == ev.count()


def test_files_out_of_time_order_and_table_folder(spark, tmp_path):
    """Four files a day apart, newest first, as a folder of part files."""
    folder = tmp_path / "events.parquet"
    for i in range(4):
        day = 4 - i
        (spark.range(5).select(F.expr(f"timestamp'2024-01-0{day} 10:00:00' + make_interval(0,0,0,0,0,id)").alias("ts"),
                               F.lit("a").alias("event_type")).coalesce(1)
         .write.mode("append").parquet(str(folder)))
    got = {r["window_start"]: r["n"] for r in event_window_counts(spark, str(tmp_path)).collect()}
    assert got == {f"2024-01-0{d} 10:00:00": 5 for d in (1, 2, 3, 4)}


def test_mail_files_score_as_a_batch_and_errors_stay_rows(spark, tmp_path):
    """Two arrivals, the second with a broken mail: every mail is scored once, with the scores of the batch job."""
    from mailguard.plans import stream_queries as Q
    from mailguard.sources import fixtures as FX
    from mailguard.sources import mime as MM
    from mailguard.streaming import jobs as S

    mails = FX.emails(spark, SF).where("path like '%1/0_message.eml'")
    stack = Q.fitted_stack(spark, SF)
    lookups = FX.domain_ns(spark, mails), FX.grammar_matches(spark, mails), FX.lang_segments(spark, mails)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = mails.where("path like '%11/0_message.eml'"), mails.where("path not like '%11/0_message.eml'")
    for arrived, broken in ((first, False), (second, True)):
        MM.write_messages(arrived, root)
        if broken:
            (tmp_path / "in" / "broken.eml").write_bytes(Q.BROKEN_MAIL)
        S.score_mail_files(spark, root, stack, "logistic", *lookups, out, str(tmp_path / "ckpt"))
    got = {r.path: r for r in spark.read.parquet(out).collect()}
    parsed = MM.parse_messages(MM.read_messages(spark, root)).cache()
    want = {r.path: r for r in S.score_mails(parsed, stack, "logistic", *lookups).collect()}
    assert len(got) == spark.read.parquet(out).count() == mails.count() + 1 and got.keys() == want.keys()
    assert len({r.batch for r in got.values()}) == 2
    for path, r in got.items():
        assert r._error == want[path]._error and (r._error is None) == (not path.endswith("broken.eml"))
        if r._error is None:
            assert abs(r.probability.malicious - want[path].probability.malicious) < 1e-12
            assert abs(r.probability.malicious + r.probability.benign - 1) < 1e-12
