"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailguard.functions._expr import let
from mailguard.llm import (
    bpe,
    embedding_dedup,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    prefix_trie,
    quality,
    simhash,
    suffix_dedup,
    topk,
    toxicity,
    url_filter,
)
from mailguard.llm.common import table
from mailguard.llm.labelled import fold


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


# The rules of the contract, and the sites whose pages stand in for a list of URLs.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/"))
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in input ``url``: the addresses of pages on the listed sites."""
    site = "://(www\\.|m\\.|blog\\.)?(" + "|".join(LISTED_SITES) + ")\\."
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(site)).select("url")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest fitting rule, else the list of URLs."""
    return url_filter.judge(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir), URL_RULES).drop("listed")


OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), q AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
                                    || regexp_replace(path, '/+$', '') END AS key
  FROM q
), listed AS (
  SELECT DISTINCT key FROM c WHERE regexp_matches(url, '://(www\.|m\.|blog\.)?({"|".join(LISTED_SITES)})\.')
), rules(rule, own, prefix, verdict) AS (
  VALUES {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for v, r in URL_RULES)}
), fit AS (
  SELECT c.page_id, c.host, c.path, c.key, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS v
  FROM c LEFT JOIN rules r
    ON (c.host = r.own OR ends_with(c.host, '.' || r.own)) AND starts_with(c.path, r.prefix)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-balanced packing of all documents into sequences of at most 2048 tokens."""
    return (packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
            .select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                    "sequence_id", "offset"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without every 200-byte string that starts more than once."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), threshold=200)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base kinds, and all spans."""
    found = pii.find_documents(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every row whose id is divisible by 50, over all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256.0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, at most 3 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the recurrent network, fitted on the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels, keep=fold("doc_id", 5) != 0)
    return (toxicity.score_documents(docs, net)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by hashed n-gram logistic regression, fitted on the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels, keep=fold("doc_id", 4) != 2)
    return (quality.score_documents(docs, weights)
            .select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= 0.7).cast("int").alias("predicted")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return (bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more of them hold."""
    out = line_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.owner AS gone FROM k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of another: the contract's input of operator 12."""
    start = seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("start"))
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    turns = F.concat(F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return own.join(start, "base", "left").select("conv_id", turns.alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    nodes = prefix_trie.prefix_nodes(rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# DuckDB has no crc32, so the table of the polynomial 0xEDB88320 is folded over the digits of the id.
OP12_SQL = """
WITH RECURSIVE steps(n, c, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8
), own AS (
  SELECT conv_id, list({'d': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')),
                        'b': strlen(coalesce(text, ''))} ORDER BY turn NULLS FIRST,
                       md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5
), p AS (
  SELECT conv_id, len(turns) = d AS ends, d AS depth, list_transform(turns[1:d], lambda x: x.d) AS path, turns[d].b AS bytes
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY ALL
), kids AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN kids k USING (path)
), up AS (
  SELECT path[1:a] AS path, sum((n_convs - 1) * bytes) AS saved, count_if(n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL
)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(up.leaves AS BIGINT) AS n_leaves,
       CAST(up.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN up USING (path) LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[1:m.depth - 1]
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents, one in ten of which goes on periodically from some word: the contract's input of operator 13."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i >= a, F.get(w, a + (i - a) % p)).otherwise(x))

    text = F.when(h % 10 == 0, F.array_join(let(words, planted), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents: their count, the one of greatest exponent, and digests of the runs and the collapsed text."""
    found = periodic_runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_length=24, exponent=3)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_topk": op6_topk,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op6_topk": OP6_SQL,
                              "op11_line_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL}
