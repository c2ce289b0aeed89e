"""Plans and inputs of the jobs that failed at 1 GB, on rows of their own."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailguard.operators import models as ML
from mailguard.operators import selection as SEL
from mailguard.operators import textmine as TM
from mailguard.plans import model_queries as MQ
from mailguard.sources import mime as MM
from mailguard.streaming import jobs as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nonzero_slots_without_an_array_of_all_slots(spark):
    """F5"""
    rows = [(0, Vectors.sparse(2 ** 18, [3, 70_000], [2.0, 0.0])), (1, Vectors.dense([0.0, 1.0, 5.0])), (2, Vectors.sparse(9, [], []))]
    df = spark.createDataFrame(rows, ["id", "v"]).select("id", MQ.nonzero("v").alias("n"))
    assert {r.id: r.n for r in df.collect()} == {0: 1, 1: 2, 2: 0}
    assert "UDF" not in plan(df)


def test_terms_are_counted_with_one_shuffle(spark):
    """repeated and null documents are one document each, as before."""
    rows = [("a", ["x", "y", "x"]), ("a", ["y", "z"]), ("b", ["x"]), (None, ["q", "q"]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "doc string, tokens array<string>")
    bags = TM.bag_of_words(df, "doc", "tokens")
    assert {r.doc: r.bow for r in bags.collect()} == {"a": {"x": 2, "y": 2, "z": 1}, "b": {"x": 1}, None: {"q": 2}}
    assert plan(bags).split("Initial Plan")[-1].count("Exchange") == 1


def test_coherence_reads_the_texts_once(spark):
    """F16"""
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b", "c"]), (2, ["c"])], "doc long, tokens array<string>")
    topics = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "topic int, term string")
    out = TM.npmi_coherence(docs, "doc", "tokens", topics)
    assert "explode" not in plan(out)
    got = {r.topic: (r.npmi, r.pairs) for r in out.collect()}
    assert got[0] == (1.0, 1) and got[1][1] == 1 and got[1][0] < 0


def test_mail_files_are_listed_by_tasks(spark, tmp_path):
    """no file index on the driver; names in any script, hidden and other files left out."""
    for name in ("x/Phishing_–_UBC/1/0_message.eml", "x/y/0 ü%20.eml", "top.eml", "x/y/notes.txt", "x/y/_part.eml", "x/.git/a.eml", "x/_tmp/b.eml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    want = {f"{tmp_path}/{n}": n.encode() for n in ("x/Phishing_–_UBC/1/0_message.eml", "x/y/0 ü%20.eml", "top.eml")}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        df = MM.read_messages(spark, root)
        assert df.inputFiles() == []
        assert {r.path: bytes(r.content) for r in df.collect()} == want
    assert MM.read_messages(spark, str(tmp_path / "empty")).count() == 0


def test_a_fit_reads_its_columns_of_the_stored_table(spark):
    """F3, F6-F9, F14, F15, F19-F21"""
    df = spark.range(1000).select("id", F.repeat(F.lit("text "), 200).alias("text"), F.array(F.lit("t")).alias("tokens"))
    stored = ML.stored_table(df, rows=300)
    assert stored.rdd.getNumPartitions() <= 4 and stored.count() == 1000
    assert "ReadSchema: struct<id:bigint>" in plan(stored.select("id"))


def test_a_training_table_holds_its_families(spark):
    """Neither texts nor tokens are sorted and stored for a fit on numbers; the rows are those of the whole table."""
    sf = "/root/testdata/sf0.001"
    own, whole = MQ.training_frame(spark, sf, "body_nontext"), MQ.training_frame(spark, sf)
    assert set(own.columns) == {"path", "label", "split", "target_1", "target_2", "target_3", *ML.family_columns("body_nontext")}
    assert not [c for c, t in own.dtypes if t.startswith("array")]
    same = [c for c in own.columns]
    assert own.count() == whole.count() and own.select(same).exceptAll(whole.select(same)).isEmpty()


def test_vocabularies_of_all_folds_come_from_one_count(spark):
    """the terms of every training set and limit are those of a vectoriser fitted on its texts."""
    words = [f"w{i}" for i in range(12)]
    data = [(i % 3, i % 2, [w for j, w in enumerate(words) if (i * i) % (j + 2) == 0 for _ in range(1 + (j + i) % 3)]) for i in range(90)]
    rows = spark.createDataFrame(data, "outer int, inner int, body_tokens array<string>")
    settings = [("header", None), ("body", (0.05, 0.9, 500)), ("body", (3.0, 0.6, 5))]
    known = SEL._vocabularies(rows, settings)
    counts, n = known["body"]
    assert list(known) == ["body"] and sum(n.values()) == 90
    for outer, inner in ((0, None), (1, 0), (2, 1)):
        seen = F.col("outer") != outer
        seen = seen if inner is None else seen & (F.col("inner") != inner)
        train, mails = rows.where(seen), SEL._mails(n, outer, inner)
        assert train.count() == mails
        for _, limits in settings[1:]:
            fitted = ML.text_stages("body", *limits)[0].fit(train)
            tf = {r.t: r["count"] for r in train.select(F.explode("body_tokens").alias("t")).groupBy("t").count().collect()}
            got = ML.vocabulary_model(counts.where(seen), "body", mails, limits)
            if got is None:      # the limit parts equal counts, the texts are read
                assert len(fitted.vocabulary) == limits[2] and list(tf.values()).count(tf[fitted.vocabulary[-1]]) > 1
            else:
                assert set(got.vocabulary) == set(fitted.vocabulary) and len(got.vocabulary) > 0
                assert [tf[t] for t in got.vocabulary] == [tf[t] for t in fitted.vocabulary]     # equal counts may swap


def test_fits_of_wide_trees_are_bounded_by_memory():
    """F8: five fits of 10,000 slots side by side held more than the executors' memory."""
    assert ML.fits_at_once("body_full", "boosted_trees", 300_000) == 1
    assert ML.fits_at_once("body_full", "boosted_trees", 1000) == 8 == ML.fits_at_once("body", "logistic", 10 ** 7)


def test_arrivals_are_logged_once_by_tasks(spark, tmp_path):
    """the stream reads a log of files, whose listing is a job and holds every file once."""
    root, log = tmp_path / "in", str(tmp_path / "log")
    for name in ("a/0.eml", "b c/ü%20.eml"):
        (root / name).parent.mkdir(parents=True)
        (root / name).write_bytes(b"x")
    for extra in (None, "d.eml", None):
        if extra:
            (root / extra).write_bytes(b"y")
        S.log_arrivals(spark, str(root), log, "*.eml")
    logged = [r.path for r in spark.read.parquet(log).collect()]
    assert sorted(logged) == sorted(f"{root}/{n}" for n in ("a/0.eml", "b c/ü%20.eml", "d.eml"))
    assert {bytes(r.content) for r in MM.read_files(spark.read.parquet(log), str(root)).collect()} == {b"x", b"y"}
