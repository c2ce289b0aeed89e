"""Line dedup, prefix trie and periodic runs against SQL and brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailguard.llm import entry, line_dedup, periodic_runs, prefix_trie
from mailguard.operators import joins
from tools.parity import duck_connect, rows_of

SF, SF_LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    got = entry.QUERIES[name](spark, SF_LARGER)
    found = duck_connect(SF_LARGER).execute(entry.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, found.fetchall())


# -- operator 11 -------------------------------------------------------------

def lines_by_hand(rows, min_chars, min_docs):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(line_dedup.BLANKS))

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    gone = {k: max(ids, key=lambda i: (i is not None, i)) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_are_split_and_hashed_once(spark):
    """op11: the plan that puts the texts together reads stored hashes, it explodes no text again."""
    docs = spark.createDataFrame([(i, "x" * 50 + f"\nown line {i}") for i in range(6)], "doc_id long, text string")
    out = line_dedup.remove_repeats(docs)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_lines_equal_brute_force(spark, edge_docs, monkeypatch):
    shared = "This line is shared by many of the documents"
    rows = [(i, f"{shared}\nown line {i}\n\t {shared.upper()} \n{shared}É" if i % 2 else f"x\r\n{shared}\n") for i in range(40)]
    rows += [(None, shared), (None, shared + "\n" + shared), (3, shared), (7, None), (8, ""), (9, f"\xa0{shared}\nÉ{shared}")]
    rows += [(i, "hot " * 12 + "\n" + "line " * 9 + str(i % 3)) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("x")).withColumn("gone", F.lit(1))
    want = lines_by_hand(rows, 40, 5)
    for hot in (joins.HOT_KEYS, 1):                   # every key broadcast, or all but those of half the rows shuffled
        monkeypatch.setattr(joins, "HOT_KEYS", hot)
        got = sorted((tuple(r) for r in line_dedup.remove_repeats(docs).collect()), key=repr)
        assert got == want
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted((tuple(r) for r in line_dedup.remove_repeats(edge_docs, 4, 2).collect()), key=repr)
    assert got == lines_by_hand(rows, 4, 2)
    assert line_dedup.remove_repeats(edge_docs.limit(0)).count() == 0


# -- operator 12 -------------------------------------------------------------

def trie_by_hand(convs):
    """Nodes of ``conv_id -> [(role, text)]``."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(seqs):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(seqs).select(*NODE).collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_trie_equals_brute_force(spark, parts, monkeypatch):
    rng = np.random.default_rng(parts)
    convs = {int(c): [(rng.choice(["user", ""]), "ä" * int(rng.integers(1, 3))) for _ in range(rng.integers(1, 5))] for c in range(-5, 60)}
    convs |= {c: [("user", "hot"), ("bot", "copy"), ("user", "")] for c in range(100, 220)}         # equal conversations
    convs |= {c: [("user", "hot"), ("bot", f"own {c}")] for c in range(300, 340)}                   # one hot first turn
    convs |= {400 + k: [("user", "long")] + [("bot", str(i)) for i in range(90 + 5 * k)] for k in range(3)}
    rows = [(c, t, role or None, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x")).withColumn("part", F.lit(1))
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(prefix_trie.sequences(table)) == trie_by_hand(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_trie_on_awkward_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(5, None, "b", "second row, null turn first"), (5, 1, "a", None), (5, 1, "a", None), (6, 2, None, ""), (6, 1, "a", "x" * 200000)]
    convs = {5: [("b", "second row, null turn first"), ("a", ""), ("a", "")], 6: [("a", "x" * 200000), ("", "")]}
    assert nodes(prefix_trie.sequences(spark.createDataFrame(rows, kind))) == trie_by_hand(convs)
    assert nodes(prefix_trie.sequences(spark.createDataFrame([], kind))) == []
    # Conversation 5 * k rebuilt from a base that is absent, with all its own turns after it or none.
    def h(c):
        return zlib.crc32(str(c).encode()) % 9
    rows = [(c, t, "r", f"{c % 3}-{t}") for c in (1, 2, 5, 6, 7, 8, 9, 11, 14) for t in range(c)]
    own = {c: [("r", f"{c % 3}-{t}") for t in range(c)] for c in (1, 2, 5, 6, 7, 8, 9, 11, 14)}
    want = {c: own.get(c - c % 5, [])[:h(c)] + turns[h(c):] for c, turns in own.items()}
    assert nodes(entry.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, kind)))) == trie_by_hand(want)


# -- operator 13 -------------------------------------------------------------

def runs_by_hand(words, min_length=24, exponent=3):
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, exponent * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    runs = sorted((s, e - s, p) for (s, e), p in out.items())
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_common_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    for text in (rng.integers(0, 2, 400), np.tile([1, 2, 3, 1], 90), np.zeros(300, np.int64), np.arange(5), np.zeros(1, np.int64)):
        text = np.concatenate([text, [-9]])
        index = periodic_runs.CoverLce(text)
        i, j = rng.integers(0, len(text), (2, 3000))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]) for a, b in zip(i, j, strict=True)]
        assert index.extend(i, j).tolist() == want


def periodic_texts():
    rng = np.random.default_rng(11)
    for k in range(300):
        words = [str(w) for w in rng.integers(0, 1 + k % 4, rng.integers(0, 120))]
        period = [str(w) for w in rng.integers(0, 9, rng.integers(1, 14))]
        at = int(rng.integers(0, len(words) + 1))
        words[at:at] = (period * 12)[:int(rng.integers(20, 90))]
        yield k, "\t".join(words) + " " * (k % 2)
    yield 1000, " ".join((["a"] * 30 + ["b"]) * 9)
    yield 1001, "\x1cx\xa0y " * 40
    yield 1002, " ".join(["w"] * 3000)
    yield 1003, "\n\n"


@pytest.mark.parametrize(("min_length", "exponent"), [(24, 3), (3, 2), (5, 4)])
def test_runs_equal_brute_force(spark, min_length, exponent):
    texts = dict(periodic_texts())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = periodic_runs.collapse_runs(docs, min_length, exponent).collect()
    assert len(got) == len(texts)
    for r in got:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        runs, rest = runs_by_hand(words, min_length, exponent)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), runs, rest)


def test_runs_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.op13_periodic_runs(spark, SF).collect():
        words = (docs[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, rest = runs_by_hand([w.decode() for w in words])
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()


def test_runs_on_awkward_rows(edge_docs):
    got = periodic_runs.collapse_runs(edge_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edge_docs.collect())
    assert all((r.n_words, r.runs, r.collapsed) == (0, [], "") for r in got if r.doc_id in (2, 3))
    assert all(r.runs[0].period == 7 and r.collapsed == "Overlong text with numbers 1234 and words." for r in got if r.doc_id in (5, 6))
    assert periodic_runs.collapse_runs(edge_docs.limit(0)).count() == 0
