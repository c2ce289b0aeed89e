"""URL filter: host and path rules, then a blocked Bloom filter before an exact join (operator 1).

The listed URLs are brought to a canonical form.  A Bloom filter of 512-bit
blocks, eight words with one bit each per URL, is aggregated from them in
Spark and broadcast; its size is bounded, so on a very long list only its
false positive rate grows.  Pages that hit it go to an exact hash join with the
canonical list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8                 # 64-bit words of a block
MAX_BLOCKS = 1 << 17      # 8 MiB: the bound of what is broadcast
BITS_PER_URL = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    host = F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(_has_host(url), host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else ''."""
    return F.when(_has_host(url), F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _has_host(url: Column) -> Column:
    return url.isNotNull() & (F.instr(url, "://") > 0)


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits (null if none)."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):   # the last to fit wins
        own, prefix = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bloom(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """Words (blocks, 8) of the filter of ``listed.key``; at most ``max_blocks`` blocks."""
    n = listed.count()
    blocks = 1
    while blocks < max_blocks and blocks * WORDS * 64 < n * BITS_PER_URL:
        blocks *= 2
    h, g = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(g, {6 * i}) & 63 as int))") for i in range(WORDS)]
    rows = (listed.select(h.bitwiseAND(F.lit(blocks - 1)).alias("block"), g.alias("g"))
            .select("block", *(b.alias(f"w{i}") for i, b in enumerate(bits)))
            .groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))).toArrow())
    out = np.zeros((blocks, WORDS), np.int64)
    at = rows.column("block").to_numpy()
    for i in range(WORDS):
        out[at, i] = rows.column(f"w{i}").to_numpy()
    return out


def possible(filter_words: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the URLs with hashes ``h`` and ``g`` may be listed."""
    block = h & np.int64(len(filter_words) - 1)
    out = np.ones(len(h), bool)
    for i in range(WORDS):
        bit = (g >> np.int64(6 * i)) & np.int64(63)
        out &= (filter_words[block, i] >> bit) & np.int64(1) == 1
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id",
          url_col: str = "url", listed_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``id_col, host, path, rule, verdict, listed`` per page.

    ``rules`` are pairs (``allow`` or ``block``, ``host/path``); the longest
    fitting rule decides.  Without one, listed URLs are blocked and all others
    allowed.  ``listed`` says whether the canonical URL is on the list.

    A URL that is null or has no ``://`` has empty host and path and is never
    listed; repeated rows repeat; empty tables give no rows or list nothing;
    null and repeated list entries are ignored; other columns are ignored.  A
    URL shared by very many pages is split by Spark's skew join: the list side
    is distinct.
    """
    keys = (listed.select(canonical(host_of(F.col(listed_col)), path_of(F.col(listed_col))).alias("key"))
            .where("key is not null").distinct())
    held = pages.sparkSession.sparkContext.broadcast(bloom(keys, max_blocks))
    p = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.withColumn("key", canonical(F.col("host"), F.col("path")))
    p = p.select("*", F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g"))
    kind = p.schema["id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = possible(held.value, b.column(4).to_numpy(), b.column(5).to_numpy())
            maybe &= b.column(3).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(maybe)], names=["id", "host", "path", "key", "maybe"])

    p = p.mapInArrow(probe, f"id {kind}, host string, path string, key string, maybe boolean")
    hits = p.where("maybe").join(keys.withColumn("found", F.lit(True)), "key", "left")
    out = (p.where("not maybe").select("id", "host", "path", F.lit(False).alias("listed"))
           .union(hits.select("id", "host", "path", F.coalesce("found", F.lit(False)).alias("listed"))))
    decided = rule_for(F.col("host"), F.col("path"), rules)
    return (out.withColumn("r", decided)
            .select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"))
