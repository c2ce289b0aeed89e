"""Text operators against brute force, on the test table and on awkward rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailguard.llm import bpe, packing, pii, quality, simhash, suffix_dedup, toxicity
from mailguard.llm.entry import op8_toxicity, op9_quality
from mailguard.llm.labelled import fold, training_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def library_ids(tokenizer, text):
    tok = Tokenizer.from_file(tokenizer)
    tok.no_truncation()
    tok.no_padding()
    return tok.encode(text or "", add_special_tokens=False).ids, tok


@pytest.mark.parametrize("text", ["", " \t\n", "Hello, WORLD's  it''s", "İstanbul ß \U0001f600‍", "a\x1cb\x00c", "<|endoftext|>x",
                                  "aaaaaaaaaaaaaaa", "ภาษา 中文 é", "1234 5.6e-7"])
def test_bpe_equals_the_library(tokenizer, text):
    own = bpe.PairIndexBpe(bpe.read_spec(tokenizer))
    ids, tok = library_ids(tokenizer, text)
    got = np.frombuffer(next(iter(own.encode([text]))), "<u4")
    assert got.tolist() == ids
    assert own.decode(got).decode("utf-8", "replace") == tok.decode(ids, skip_special_tokens=False)


def test_bpe_numbers_the_pieces_of_a_batch(tokenizer, monkeypatch):
    """op2, op10: every white space and odd character equals the library; only texts with separators or special
    tokens are split one by one, and a word is merged once for all its spellings."""
    own = bpe.PairIndexBpe(bpe.read_spec(tokenizer))
    merged, by_hand, merge, split = [], [], own.merge_words, own.pieces
    monkeypatch.setattr(own, "merge_words", lambda words: merged.extend(words) or merge(words))
    monkeypatch.setattr(own, "pieces", lambda t: by_hand.append(t) or split(t))
    odd = ["a\x1cb c", "x <|endoftext|>y"]
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace() and c not in bpe.SEPARATORS]
    texts = ["Word word, WORD.", odd[0], "  word ", None, odd[1], "it's 3.5", *[f"{c}a{c}{c}B.{c}" for c in spaces], ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [library_ids(tokenizer, t)[0] for t in texts]
    assert by_hand == odd and merged.count(b"word") == 1
    assert list(own.encode([])) == []


def test_bpe_on_awkward_rows(edge_docs, tokenizer):
    out = bpe.encode_decode(edge_docs, tokenizer).collect()
    assert len(out) == edge_docs.count()
    assert all(r.n_tokens == 0 and r.decoded == "" for r in out if r.doc_id in (2, 3))
    assert bpe.encode_decode(edge_docs.limit(0), tokenizer).count() == 0


def test_packing_places_every_id_once(edge_docs, tokenizer):
    docs = edge_docs.where("doc_id is null or doc_id < 8").dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(docs, tokenizer).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) == 4 * p.length
    for r in docs.select("doc_id", "text").collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == [*library_ids(tokenizer, r.text)[0], 1]
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        size = sum(p.length for p in own)
        assert size <= 2048 and size & (size - 1) == 0
    assert packing.pack_documents(edge_docs.limit(0), tokenizer).count() == 0


def test_simhash_against_all_pairs(spark, texts):
    def brute(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: brute(t or "") for i, t in texts.items()}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            low = min(comp[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3)
            if low < comp[a]:
                comp[a], changed = low, True
    for hot_rows in (4096, 2):     # 2: every shared key takes the way of the hot ones
        got = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), hot_rows=hot_rows).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_simhash_probes_of_a_crowded_key(spark):
    """400 fingerprints share a key and probe its neighbours: every block stays small, no link is lost."""
    rng = np.random.default_rng(5)
    home = rng.integers(0, 1 << 32, 400, dtype=np.uint64) << np.uint64(32) | np.uint64(0x0F0F_1234)
    near = home[:60] ^ (np.uint64(1) << rng.integers(16, 32, 60).astype(np.uint64))     # one bit off in segment 1
    near[:30] ^= np.uint64(1 << 40) | np.uint64(1 << 41)                               # and two beyond
    fps = np.unique(np.concatenate([home, near, near[30:] ^ np.uint64(0b1111)]))
    rows = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    block = 64
    hot = {(r.chain, r.part): (r.xs, r.ys) for r in simhash.crowded(rows, 3, block).collect()}
    counts = (simhash.keyed(rows, 3, probes=True).groupBy("chain", "part")
              .agg(F.count_if("home").alias("own"), F.count("*").alias("n")).collect())
    for r in counts:
        xs, ys = hot.get((r.chain, r.part), (1, 1))
        assert r.own <= xs * block and r.n <= ys * block
    assert sum(1 for r in counts if r.n > block and r.own < 60) >= 8      # neighbours crowded by probes alone

    def components(pairs):
        comp = list(range(len(fps)))
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(comp[a], comp[b])
                if comp[a] != low or comp[b] != low:
                    comp[a] = comp[b] = low
                    changed = True
        return comp

    brute = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(brute) >= 60
    for size in (4096, block):
        edges = [(r.a, r.b) for r in simhash.links(rows, 3, size).collect()]
        assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in edges)
        assert components(edges) == components(brute)


def test_simhash_on_awkward_rows(edge_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[7] == 1 and comp[3] == 2 and comp[6] == 5 and comp[None] is None
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot_strings", [4000, 1])
def test_suffix_against_brute_force(spark, texts, hot_strings):
    import hashlib
    want = dict(zip(texts, suffix_dedup.brute_force(list(texts.values())), strict=True))
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"), hot_strings=hot_strings).collect()
    assert len(got) == len(want)
    for r in got:
        n, runs, digest = want[r.doc_id]
        assert (r.n_bytes, [(s.start, s.end) for s in r.spans]) == (n, runs)
        assert hashlib.sha256(r.kept).hexdigest() == digest


def test_suffix_on_awkward_rows(edge_docs):
    got = suffix_dedup.remove_repeats(edge_docs, carry=["row", "kept"]).collect()
    assert len(got) == edge_docs.count() and all(r.carried.kept == "x" for r in got)
    assert all(bytes(r.kept) == b"" for r in got if r.doc_id in (2, 3, 5, 6))
    assert suffix_dedup.remove_repeats(edge_docs.limit(0)).count() == 0


def test_pii_against_patterns(spark, texts):
    extra = ["a@b.c d@e..f 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 +44 (20) 7946-0958", "x@y@z.org", "1.2.3.4", "@", "+", ""]
    for t in [*texts.values(), *extra]:
        own = [s for s in pii.find(t or "") if s[0] in pii.BASE_KINDS]
        assert own == pii.brute_force(t or "")


def test_pii_of_separated_digits_and_followed_ibans():
    apart = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "x 4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1."]
    rng = np.random.default_rng(4)
    drawn = ["".join(rng.choice(list("0123456789 -"), 400)) for _ in range(50)] + [" ".join(rng.choice(list("0123"), 16)) for _ in range(50)]
    for t in [*apart, *drawn]:
        assert [s for s in pii.find(t) if s[0] in pii.BASE_KINDS] == pii.brute_force(t)
    assert all([s[0] for s in pii.find(t)] == ["card"] for t in apart)
    iban = "DE89 3704 0044 0532 0130 00"
    for rest in ("", " Please", " 4 items", " AND MORE", "X", "x", ", then"):
        t = f"IBAN {iban}{rest}"
        assert pii.redact(t, [s for s in pii.find(t) if s[0] == "account"]) == f"IBAN <account>{rest}"
    assert not pii.find("IBAN DE88 3704 0044 0532 0130 0O Please")


def test_pii_on_awkward_rows(edge_docs):
    got = {r.doc_id: r for r in pii.find_documents(edge_docs.where("text not like 'another%' or text is null")).collect()}
    assert got[2].spans == [] and got[2].redacted == ""
    assert got[8].redacted == "Straße 😀 <email> café"


def accuracy(spark, query, target, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", target).collect()
    return len(rows), sum(r[0] == r[1] for r in rows) / len(rows)


@pytest.mark.parametrize(("query", "target"), [(op8_toxicity, "toxic"), (op9_quality, "quality")])
def test_held_out_accuracy(spark, query, target):
    n, share = accuracy(spark, query, target, "/root/testdata/sf0.01")
    assert n > 50 and share > 0.85


@pytest.mark.parametrize(("model", "target", "threshold", "per_class", "low", "high"),
                         [(toxicity, "toxic", 0.5, 150, 0.04, 0.85), (quality, "quality", 0.7, 100, 0.1, 0.97)])
def test_class_ratio_survives_the_bound(spark, model, target, threshold, per_class, low, high):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)
    keep = fold("doc_id", 5) != 0
    rows = training_rows(docs, labels, target, keep, per_class).select("y", "weight").collect()
    known = [r[0] for r in labels.where(keep).select(target).collect()]
    assert [sum(r.y == y for r in rows) for y in (0, 1)] == [per_class] * 2
    assert sum(r.weight * r.y for r in rows) / sum(r.weight for r in rows) == pytest.approx(sum(known) / len(known))
    held = docs.where(fold("doc_id", 5) == 0)
    got = model.score_documents(held, model.train(docs, labels, keep, per_class=per_class)).join(labels, "doc_id").collect()
    own = {y: [r.score >= threshold for r in got if r[target] == y] for y in (0, 1)}
    assert sum(own[0]) / len(own[0]) < low and sum(own[1]) / len(own[1]) > high


def test_classifiers_on_awkward_rows(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.train(edge_docs, labels, fold("doc_id", 5) >= 0)
    weights = quality.train(edge_docs, labels, fold("doc_id", 4) >= 0)
    for out in (toxicity.score_documents(edge_docs, net), quality.score_documents(edge_docs, weights)):
        rows = out.collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(edge_docs.limit(0), net).count() == 0
