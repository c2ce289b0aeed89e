"""Text mining jobs.

Documents become (doc, term) rows; every statistic is a grouped aggregate
over those rows.  Per-document windows (TF-IDF norm, top keywords) are
bounded by one document's length.  Joins against the term table are keyed on
the term: very frequent terms are hot keys, which AQE's skew-join handling
splits, and AQE broadcasts a term table whose measured size is small.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, HashingTF, NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailguard.session import materialise


def doc_terms(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(doc, term, tf) rows: term counts per document.

    Whole token lists are dealt by document, so the terms are counted, and a
    document's terms gathered, without a shuffle of (doc, term) rows."""
    return (df.select(doc, F.col(tokens).alias("_tokens")).repartition(doc).select(doc, F.explode("_tokens").alias("term"))
            .groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")))


def document_frequency(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(term, df, cf) -- documents containing the term and total count."""
    return doc_terms(df, doc, tokens).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocabulary(df: DataFrame, doc: str, tokens: str, min_df: float, max_df: float,
               max_features: int | None) -> DataFrame:
    """Terms with min_df <= df <= max_df (fractions of the document
    count), keeping the ``max_features`` most frequent by corpus count
    (ties -> term order), like the reference vectoriser."""
    n_docs = df.select(doc).count()  # key column only: tokenisation is pruned away
    d = document_frequency(df, doc, tokens)
    lo = min_df if min_df >= 1 and isinstance(min_df, int) else min_df * n_docs
    hi = max_df if max_df > 1 and isinstance(max_df, int) else max_df * n_docs
    kept = d.filter((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    if max_features:
        kept = kept.orderBy(F.col("cf").desc(), "term").limit(max_features)
    return kept


def count_vectorizer(df: DataFrame, tokens: str, vocab_size: int, min_df: float, max_df: float,
                     out: str = "counts"):
    """Spark ML CountVectorizer with the same limits (sparse vectors)."""
    cv = CountVectorizer(inputCol=tokens, outputCol=out, vocabSize=vocab_size, minDF=min_df,
                         maxDF=max_df)
    model = cv.fit(df)
    return model, model.transform(df)


def hashing_vectorizer(df: DataFrame, tokens: str, num_features: int = 2 ** 18,
                       out: str = "hashed") -> DataFrame:
    """Hashing vectoriser (no fitted vocabulary, fixed width)."""
    return HashingTF(inputCol=tokens, outputCol=out, numFeatures=num_features).transform(df)


def with_bigrams(df: DataFrame, tokens: str, out: str = "grams") -> DataFrame:
    """T4: unigrams followed by bigrams (ML ``NGram``)."""
    g = NGram(n=2, inputCol=tokens, outputCol="_bigrams").transform(df)
    return g.withColumn(out, F.concat(F.col(tokens), F.col("_bigrams"))).drop("_bigrams")


def tfidf(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """T5: (doc, term, weight) with smooth idf ln((1+n)/(1+df)) + 1 and an L2
    norm per document (the reference vectoriser's defaults).

    The (doc, term, tf) table is persisted: it feeds the document count, the
    document frequencies and the weights (a lost block is recomputed)."""
    dt = doc_terms(df, doc, tokens).persist()
    n_docs = df.select(doc).count()
    dfs = dt.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = dt.join(dfs, "term").withColumn(
        "w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term", (F.col("w") / norm).alias("weight"))


def top_keywords(weights: DataFrame, doc: str, n: int = 5) -> DataFrame:
    """The ``n`` highest-weight terms per document (ties -> term order),
    as an ordered, space-joined list, with the top weight."""
    rw = Window.partitionBy(doc).orderBy(F.col("weight").desc(), "term")
    top = weights.withColumn("_r", F.row_number().over(rw)).filter(F.col("_r") <= n)
    return top.groupBy(doc).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]), " ").alias("keywords"),
        F.max("weight").alias("top_weight"))


def bag_of_words(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """Per-document term -> count map (absent terms left out)."""
    dt = doc_terms(df, doc, tokens)
    return dt.groupBy(doc).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("term", "tf")))).alias("bow"))


def npmi_coherence(df: DataFrame, doc: str, tokens: str, topics: DataFrame) -> DataFrame:
    """Mean NPMI of each topic's term pairs over document co-occurrence.

    ``topics`` is (topic, term) with a handful of terms per topic, so the
    per-document pair rows are bounded by that handful squared.  A pair that
    never co-occurs scores -1.
    """
    n_docs = df.select(doc).count()
    present = df.select(doc, F.explode(F.array_distinct(tokens)).alias("term"))
    # Topics come from the data: AQE broadcasts at a measured size.  The hits are read three times.
    hits = materialise(present.join(materialise(topics), "term"))
    p1 = hits.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("d1"))
    a, b = hits.alias("a"), hits.alias("b")
    pairs = (a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.topic") == F.col("b.topic"))
                    & (F.col("a.term") < F.col("b.term")))
             .groupBy(F.col("a.topic").alias("topic"), F.col("a.term").alias("t1"),
                      F.col("b.term").alias("t2")).agg(F.count(F.lit(1)).alias("d12")))
    tp = topics.alias("x").join(topics.alias("y"), (F.col("x.topic") == F.col("y.topic"))
                                & (F.col("x.term") < F.col("y.term"))).select(
        F.col("x.topic").alias("topic"), F.col("x.term").alias("t1"), F.col("y.term").alias("t2"))
    j = (tp.join(pairs, ["topic", "t1", "t2"], "left")
         .join(p1.select("topic", F.col("term").alias("t1"), F.col("d1").alias("d_1")), ["topic", "t1"], "left")
         .join(p1.select("topic", F.col("term").alias("t2"), F.col("d1").alias("d_2")), ["topic", "t2"], "left"))
    p12 = F.coalesce(F.col("d12"), F.lit(0)) / F.lit(float(n_docs))
    pa = F.coalesce(F.col("d_1"), F.lit(0)) / F.lit(float(n_docs))
    pb = F.coalesce(F.col("d_2"), F.lit(0)) / F.lit(float(n_docs))
    npmi = (F.when(p12 <= 0, F.lit(-1.0)).when(p12 >= 1, F.lit(1.0))
            .otherwise(F.log(p12 / (pa * pb)) / -F.log(p12)))
    return j.groupBy("topic").agg(F.round(F.avg(npmi), 6).alias("npmi"),
                                  F.count(F.lit(1)).alias("pairs"))


# Tiny sentiment lexicon for the stand-in chunk scorer.
POSITIVE_WORDS = ("good", "great", "thanks", "thank", "happy", "pleased", "welcome", "best",
                  "excellent", "glad", "bien", "merci", "bon", "gut", "danke", "gracias", "bueno")
NEGATIVE_WORDS = ("bad", "urgent", "problem", "error", "fail", "failed", "suspended", "locked",
                  "warning", "risk", "mal", "probleme", "fehler", "problema", "urgente")


def lexicon_sentiment(chunk: Column) -> Column:
    """Stand-in chunk scorer: struct(label, score) from lexicon hits;
    POSITIVE when positive hits >= negative hits, score = (hits of the label
    + 1) / (all hits + 2)."""
    toks = F.regexp_extract_all(F.lower(chunk), F.lit(r"[\p{L}]+"), 0)
    pos = F.size(F.filter(toks, lambda w: w.isin(*POSITIVE_WORDS)))
    neg = F.size(F.filter(toks, lambda w: w.isin(*NEGATIVE_WORDS)))
    label = F.when(pos >= neg, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE"))
    score = (F.greatest(pos, neg) + 1) / (pos + neg + 2)
    return F.struct(label.alias("label"), score.alias("score"))


def chunk_scores(df: DataFrame, doc: str, chunks: str, scorer=lexicon_sentiment) -> DataFrame:
    """Score every chunk and average the score per label per document;
    a label no chunk received averages to 0."""
    ex = df.select(doc, F.posexplode(chunks).alias("pos", "chunk"))
    sc = ex.select(doc, scorer(F.col("chunk")).alias("s"))
    return sc.groupBy(doc).agg(
        F.coalesce(F.avg(F.when(F.col("s.label") == "POSITIVE", F.col("s.score"))), F.lit(0.0))
        .alias("positive"),
        F.coalesce(F.avg(F.when(F.col("s.label") == "NEGATIVE", F.col("s.score"))), F.lit(0.0))
        .alias("negative"),
        F.count(F.lit(1)).alias("n_chunks"))
