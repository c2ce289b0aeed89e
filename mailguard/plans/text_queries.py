"""Text vectorising and mining queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailguard.functions import content as C
from mailguard.functions import text as TX
from mailguard.operators import features as FE
from mailguard.operators import textmine as TM
from mailguard.plans import duck as D
from mailguard.plans import profile_queries as PQ
from mailguard.plans.registry import register
from mailguard.session import materialise
from mailguard.sources import fixtures as FX
from mailguard.sources.tables import read_table


def d_tokens(x: str) -> str:
    """DuckDB rendering of ``text.vectorizer_tokens``."""
    stops = ", ".join(D.q(w) for w in TX.VECTORIZER_STOP_WORDS)
    return (f"list_filter(regexp_extract_all(translate(lower(coalesce({x}, '')), {D.q(TX.ACCENTED)}, "
            f"{D.q(TX.UNACCENTED)}), {D.q(TX.TOKEN)}), lambda w: NOT list_contains([{stops}], w))")


def d_topic_tokens(x: str) -> str:
    """DuckDB rendering of ``text.topic_tokens``."""
    stops = ", ".join(D.q(w) for w in TX.TOPIC_STOP_WORDS)
    s = f"replace(coalesce({x}, ''), {D.q(C.CAUTION_TAG)}, '')"
    s = f"regexp_replace({s}, {D.q(TX.CLOCK_TIME)}, ' ', 'g')"
    raw = f"regexp_extract_all(lower({s}), {D.q(TX.NOT_WS + '+')})"
    trimmed = (f"list_transform({raw}, lambda w: regexp_replace(w, "
               f"{D.q(r'^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$')}, '', 'g'))")
    return (f"list_filter({trimmed}, lambda w: length(w) > 2 AND NOT list_contains([{stops}], w) "
            f"AND NOT regexp_matches(w, {D.q(TX.EMAIL_LIKE)}) AND NOT regexp_matches(w, {D.q(TX.URL_LIKE)}) "
            f"AND NOT regexp_matches(w, {D.q(TX.NUMBER_LIKE)}))")


def body_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = FE.build_metadata(spark, FX.emails(spark, sf_dir))
    return meta.select("path", TX.vectorizer_tokens("text_clean").alias("tokens"))


BODY_TOKENS_SQL = FX.duck_emails_cte() + f""",
lab AS (SELECT e.path, {D.text_clean('e.text_plain')} AS text_clean, lm.target_3
        FROM emails e LEFT JOIN {D.label_map_values()} ON {PQ.FOLDER_SQL} = lm.folder
        WHERE lm.target_3 IS DISTINCT FROM 'self_phishing'),
toks AS (SELECT path, {d_tokens('text_clean')} AS tokens FROM lab)
"""


@register("vectorizer_tokens", BODY_TOKENS_SQL + """
SELECT path, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens FROM toks
""", ops=("T1", "P5"))
def vectorizer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectoriser tokens of every body (lower, accents stripped, 2+ word chars)."""
    t = body_tokens(spark, sf_dir)
    return t.select("path", F.array_join("tokens", " ").alias("tokens"),
                    F.size("tokens").cast("long").alias("n_tokens"))


@register("body_vocabulary", BODY_TOKENS_SQL + """
, dt AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(tokens) AS term FROM toks) t GROUP BY ALL),
d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM dt GROUP BY term),
n AS (SELECT count(*) AS n FROM toks)
SELECT term, df, cf FROM d, n WHERE df >= 0.001 * n.n AND df <= 0.99 * n.n
ORDER BY cf DESC, term LIMIT 10000
""", ops=("T2", "T3", "O2"))
def body_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body vocabulary: document and corpus frequency of terms kept by
    min_df=0.001, max_df=0.99, max_features=10000."""
    return TM.vocabulary(body_tokens(spark, sf_dir), "path", "tokens", 0.001, 0.99, 10000)


@register("subject_ngram_frequency", FX.duck_emails_cte() + f"""
, st AS (SELECT path, {d_tokens('subject')} AS t FROM emails),
g AS (SELECT path, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS grams FROM st)
SELECT term, count(*) AS df, sum(tf) AS cf FROM (
  SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(grams) AS term FROM g) x GROUP BY ALL) y
GROUP BY term
""", ops=("T4", "T3"))
def subject_ngram_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of subject unigrams and bigrams."""
    s = FX.emails(spark, sf_dir).select("path", TX.vectorizer_tokens("subject").alias("t"))
    return TM.document_frequency(TM.with_bigrams(s, "t", "grams"), "path", "grams")


def _topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = FX.emails(spark, sf_dir)
    cleaned = mails.select("path", F.array_join(TX.topic_tokens("text_plain"), " ").alias("clean"))
    return cleaned.select("path", TX.vectorizer_tokens("clean", stop_words=()).alias("tokens"))


TOPIC_DOCS_SQL = FX.duck_emails_cte() + f""",
cl AS (SELECT path, array_to_string({d_topic_tokens('text_plain')}, ' ') AS clean FROM emails),
td AS (SELECT path, regexp_extract_all(translate(lower(clean), {D.q(TX.ACCENTED)}, {D.q(TX.UNACCENTED)}),
               {D.q(TX.TOKEN)}) AS tokens FROM cl)
"""


@register("topic_clean_tokens", TOPIC_DOCS_SQL + """
SELECT path, clean, CAST(len(string_split(clean, ' ')) AS BIGINT) AS n FROM cl WHERE clean <> ''
UNION ALL SELECT path, clean, CAST(0 AS BIGINT) FROM cl WHERE clean = ''
""", ops=("T8",))
def topic_clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic-model cleaning of every body (banner, clock times, stop words,
    short tokens, e-mails, URLs and numbers removed)."""
    t = FX.emails(spark, sf_dir).select("path", TX.topic_tokens("text_plain").alias("t"))
    return t.select("path", F.array_join("t", " ").alias("clean"), F.size("t").cast("long").alias("n"))


@register("tfidf_top_keywords", TOPIC_DOCS_SQL + """
, dt AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(tokens) AS term FROM td) t GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
n AS (SELECT count(*) AS n FROM td),
w AS (SELECT dt.path, dt.term, dt.tf * (ln((1.0 + n.n) / (1.0 + d.df)) + 1.0) AS w FROM dt JOIN d USING (term), n),
wn AS (SELECT path, term, w / sqrt(sum(w * w) OVER (PARTITION BY path)) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY weight DESC, term) AS rk FROM wn)
SELECT path, string_agg(term, ' ' ORDER BY rk) AS keywords, round(max(weight), 6) AS top_weight
FROM r WHERE rk <= 5 GROUP BY path
""", ops=("T5", "T6", "T8"))
def tfidf_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 TF-IDF keywords (smooth idf, L2 norm) of every cleaned body."""
    w = TM.tfidf(_topic_docs(spark, sf_dir), "path", "tokens")
    top = TM.top_keywords(w, "path", 5)
    return top.select("path", "keywords", F.round("top_weight", 6).alias("top_weight"))


@register("bag_of_words", BODY_TOKENS_SQL + """
, dt AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(tokens) AS term FROM toks) t GROUP BY ALL)
SELECT path, string_agg(term || ':' || CAST(tf AS VARCHAR), ' ' ORDER BY term) AS bow,
       CAST(count(*) AS BIGINT) AS n_terms FROM dt GROUP BY path
""", ops=("T7",))
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse bag of words per body, rendered ``term:count`` in term order."""
    b = TM.bag_of_words(body_tokens(spark, sf_dir), "path", "tokens")
    e = F.map_entries("bow")
    return b.select("path", F.array_join(F.transform(e, lambda x: F.concat(
        x["key"], F.lit(":"), x["value"].cast("string"))), " ").alias("bow"),
        F.size(e).cast("long").alias("n_terms")).filter(F.col("n_terms") > 0)


@register("topic_npmi", TOPIC_DOCS_SQL + """
, lang AS (SELECT e.path, e.content_language AS lang FROM emails e),
pres AS (SELECT DISTINCT td.path, unnest(tokens) AS term FROM td),
ldf AS (SELECT coalesce(l.lang, 'none') AS topic, p.term, count(*) AS df
        FROM pres p JOIN lang l ON l.path = p.path GROUP BY ALL),
topics AS (SELECT topic, term FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY df DESC, term) AS r
           FROM ldf) WHERE r <= 5),
n AS (SELECT count(*) AS n FROM td),
hits AS (SELECT p.path, t.topic, p.term FROM pres p JOIN topics t ON t.term = p.term),
p1 AS (SELECT topic, term, count(*) AS d1 FROM hits GROUP BY ALL),
pairs AS (SELECT a.topic, a.term AS t1, b.term AS t2, count(*) AS d12 FROM hits a JOIN hits b
          ON a.path = b.path AND a.topic = b.topic AND a.term < b.term GROUP BY ALL),
tp AS (SELECT x.topic, x.term AS t1, y.term AS t2 FROM topics x JOIN topics y ON x.topic = y.topic AND x.term < y.term),
j AS (SELECT tp.topic, coalesce(pairs.d12, 0) / n.n AS p12, coalesce(a.d1, 0) / n.n AS pa, coalesce(b.d1, 0) / n.n AS pb
      FROM tp LEFT JOIN pairs USING (topic, t1, t2) LEFT JOIN p1 a ON a.topic = tp.topic AND a.term = tp.t1
      LEFT JOIN p1 b ON b.topic = tp.topic AND b.term = tp.t2, n)
SELECT topic, round(avg(CASE WHEN p12 <= 0 THEN -1.0 WHEN p12 >= 1 THEN 1.0
                             ELSE ln(p12 / (pa * pb)) / -ln(p12) END), 6) AS npmi,
       count(*) AS pairs FROM j GROUP BY topic
""", ops=("T10", "T8"))
def topic_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NPMI coherence of per-language topics (each topic = its 5 highest-df
    cleaned terms) over document co-occurrence."""
    docs = materialise(_topic_docs(spark, sf_dir))     # tokenised once, read three times
    lang = FX.emails(spark, sf_dir).select("path", F.coalesce("content_language", F.lit("none")).alias("topic"))
    pres = docs.select("path", F.explode(F.array_distinct("tokens")).alias("term")).join(lang, "path")
    ldf = pres.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("df"))
    rw = Window.partitionBy("topic").orderBy(F.col("df").desc(), "term")
    topics = ldf.withColumn("_r", F.row_number().over(rw)).filter("_r <= 5").select("topic", "term")
    return TM.npmi_coherence(docs, "path", "tokens", topics)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def _d_lex(x: str) -> str:
    pos = ", ".join(D.q(w) for w in TM.POSITIVE_WORDS)
    neg = ", ".join(D.q(w) for w in TM.NEGATIVE_WORDS)
    toks = f"regexp_extract_all(lower({x}), '[\\p{{L}}]+')"
    return (f"len(list_filter({toks}, lambda w: list_contains([{pos}], w))) AS pos, "
            f"len(list_filter({toks}, lambda w: list_contains([{neg}], w))) AS neg")


@register("chunk_sentiment", f"""
WITH c AS (SELECT conv_id, turn, list_transform(range(0, CAST(greatest(ceil(length(coalesce(text, '')) / 512), 1) AS BIGINT)),
                  lambda i: substr(coalesce(text, ''), i * 512 + 1, 512)) AS chunks FROM conversations),
x AS (SELECT conv_id, turn, unnest(chunks) AS chunk FROM c),
s AS (SELECT conv_id, turn, {_d_lex('chunk')} FROM x),
l AS (SELECT conv_id, turn, CASE WHEN pos >= neg THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
             (greatest(pos, neg) + 1) / (pos + neg + 2) AS score FROM s)
SELECT conv_id, turn, round(coalesce(avg(score) FILTER (WHERE label = 'POSITIVE'), 0.0), 6) AS positive,
       round(coalesce(avg(score) FILTER (WHERE label = 'NEGATIVE'), 0.0), 6) AS negative,
       count(*) AS n_chunks FROM l GROUP BY conv_id, turn
""", ops=("T16",))
def chunk_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns cut into 512-character chunks, each scored by the lexicon
    scorer; mean score per label per turn (missing label -> 0)."""
    cv = conversations(spark, sf_dir).select(
        F.struct("conv_id", "turn").alias("doc"), TX.chunks("text", 512).alias("chunks"))
    out = TM.chunk_scores(cv, "doc", "chunks")
    return out.select("doc.conv_id", "doc.turn", F.round("positive", 6).alias("positive"),
                      F.round("negative", 6).alias("negative"), "n_chunks")


# Stand-in LLM output: assistant turns wrapped with a reasoning block
# (FIXTURES-style derived input; the operator below does the work).
THINK_SQL = ("'<think>step ' || CAST(turn AS STRING) || chr(10) || 'weighing evidence</think>' || chr(10) "
             "|| ' ' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '   '")


@register("llm_think_strip", f"""
WITH a AS (SELECT conv_id, turn, {THINK_SQL} AS raw FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g') AS x FROM a),
c AS (SELECT conv_id, turn, regexp_replace(x, {D.q(chr(10) + TX.WS + '*' + chr(10))}, chr(10) || chr(10), 'g') AS x FROM b)
SELECT conv_id, turn, regexp_replace(x, {D.q('^' + TX.WS + '+|' + TX.WS + '+$')}, '', 'g') AS answer FROM c
""", ops=("T17",))
def llm_think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning blocks and blank-line runs removed from model answers."""
    a = conversations(spark, sf_dir).filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.expr(THINK_SQL.replace("chr(10)", "char(10)")).alias("raw"))
    return a.select("conv_id", "turn", TX.strip_think("raw").alias("answer"))


# The two answer formats (level column, its values, reasons column).
LABELS = ("benign", "malicious")
ANSWER = ("confidence", ("high", "medium", "low"), "reasons")
SUMMARY = ("confidence_level", ("not confident", "somewhat confident", "confident", "extremely confident"),
           "justification")


def parse_answers(raw: DataFrame, col: str = "raw", form: tuple = ANSWER) -> DataFrame:
    """Parse model JSON answers (PERMISSIVE: malformed -> nulls) and check
    the label and confidence enums and that exactly three reasons are given, none of them null."""
    level, levels, reasons = form
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField(level, T.StringType()),
                           T.StructField(reasons, T.ArrayType(T.StringType()))])
    p = raw.withColumn("_a", F.from_json(col, schema, {"mode": "PERMISSIVE"}))
    given = F.col(f"_a.{reasons}")
    return p.select(
        "*", F.col("_a.label").alias("label"), F.col(f"_a.{level}").alias(level),
        F.size(given).cast("long").alias(f"n_{reasons}"),
        F.coalesce(F.col("_a.label").isin(*LABELS) & F.col(f"_a.{level}").isin(*levels)
                   & (F.size(given) == 3) & ~F.exists(given, lambda x: x.isNull()),
                   F.lit(False)).alias("valid")).drop("_a", col)


ANSWER_SPARK = """CASE WHEN turn % 7 = 6 THEN '{"label": "benign", "confid' ELSE
  to_json(named_struct('label', CASE turn % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'unsure' END,
    'confidence', CASE length(text) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END,
    'reasons', slice(split(text, '[.]'), 1, CAST(2 + turn % 2 AS INT)))) END"""


@register("llm_answer_parse", """
WITH a AS (SELECT conv_id, turn,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE CASE turn % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'unsure' END END AS label,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE CASE length(text) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS confidence,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE CAST(len(string_split(text, '.')[1:2 + turn % 2]) AS BIGINT) END AS n_reasons
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, label, confidence, n_reasons,
  coalesce(label IN ('benign', 'malicious') AND confidence IN ('high', 'medium', 'low') AND n_reasons = 3, false) AS valid
FROM a
""", ops=("T18",))
def llm_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers (JSON, some truncated) parsed and validated."""
    a = conversations(spark, sf_dir).filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.expr(ANSWER_SPARK).alias("raw"))
    return parse_answers(a)


SUMMARY_SPARK = """CASE turn % 5
  WHEN 4 THEN concat('{"label": "malicious", "confidence_level": ["confident"', '}')
  ELSE to_json(named_struct('label', CASE turn % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'Benign' END,
    'confidence_level', element_at(array('not confident', 'somewhat confident', 'confident', 'extremely confident', 'high'),
                                   CAST(length(text) % 5 AS INT) + 1),
    'justification', CASE turn % 4 WHEN 2 THEN array('a', text) WHEN 3 THEN CAST(NULL AS ARRAY<STRING>)
                     ELSE array(text, 'b', 'c') END)) END"""


@register("llm_summary_parse", """
WITH a AS (SELECT conv_id, turn, turn % 5 = 4 AS broken,
  CASE turn % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'Benign' END AS label,
  ['not confident', 'somewhat confident', 'confident', 'extremely confident', 'high'][length(text) % 5 + 1] AS confidence_level,
  CAST(CASE turn % 4 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 3 END AS BIGINT) AS n_justification
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN NOT broken THEN label END AS label,
  CASE WHEN NOT broken THEN confidence_level END AS confidence_level,
  CASE WHEN NOT broken THEN n_justification END AS n_justification,
  NOT broken AND label <> 'Benign' AND confidence_level <> 'high' AND coalesce(n_justification, 0) = 3 AS valid
FROM a
""", ops=("T18",))
def llm_summary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model summaries in the second answer format, some with a wrong label, level or number of
    reasons, some cut off, parsed and validated."""
    a = conversations(spark, sf_dir).filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.expr(SUMMARY_SPARK).alias("raw"))
    return parse_answers(a, form=SUMMARY)


@register("truncate_content", """
SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN left(text, 400) || '...[content truncated]' ELSE text END AS content,
       length(text) > 400 AS truncated FROM conversations
""", ops=("T19",))
def truncate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut to a 100-token budget (4 characters per token) with a marker."""
    cv = conversations(spark, sf_dir)
    return cv.select("conv_id", "turn", TX.truncate_tokens("text", 100).alias("content"),
                     (F.length("text") > 400).alias("truncated"))
