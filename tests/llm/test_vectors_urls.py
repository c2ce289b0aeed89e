"""Vector and URL operators against brute force."""

import duckdb
import numpy as np

from mailguard.llm import embedding_dedup, topk, url_filter
from mailguard.llm.entry import OP1_SQL, OP6_SQL, URL_RULES, op1_url_filter, op6_topk

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, []), (9003, [0.0, 0.0]), (9004, [1.0, float("nan")]), (9005, [None, 1.0]), (9006, [1.0, 0.0]),
       (9007, [2.0, 0.0]), (9007, [2.0, 0.0]), (None, [1.0, 0.0]), (9008, [3.0])]


def oracle(sql, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return {tuple(r) for r in con.execute(sql).fetchall()}


def test_url_filter_equals_sql(spark):
    assert {tuple(r) for r in op1_url_filter(spark, SF).collect()} == oracle(OP1_SQL, "pages")


def test_url_filter_rules_list_and_awkward_rows(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/x?y", "a"), (2, "http://example.com/en/", "a"), (3, None, "a"), (4, "no scheme", "a"),
                                   (5, "https://bad.org:443/p/#f", "a"), (5, "https://bad.org:443/p/#f", "a"), (6, "http://a.net/es/", "a")],
                                  "page_id long, url string, key string")
    listed = spark.createDataFrame([("http://www.bad.org/p",), (None,), ("http://www.bad.org/p",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, URL_RULES).collect()}
    assert got == {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("example.com", "/en/", "example.com/en/", "block"),
                   3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("bad.org:443", "/p/", None, "block"),
                   6: ("a.net", "/es/", "net/es/", "block")}
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_filter_of_one_block_keeps_results(spark):
    pages, listed = (spark.read.parquet(f"{SF}/pages.parquet") for _ in range(2))
    small, large = (url_filter.judge(pages, listed.where("page_id % 3 = 0"), max_blocks=m).collect() for m in (1, 1 << 10))
    assert sorted(small) == sorted(large) and any(r.listed for r in small)


def test_topk_equals_sql(spark):
    assert {tuple(r) for r in op6_topk(spark, SF).collect()} == oracle(OP6_SQL, "embeddings")


def top_by_hand(rows, asked, k):
    """``query -> [(vec_id, score)]`` over (id, vector) rows, repeated ids counted once."""
    ints = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows]
    out = {}
    for q in asked:
        best = {}
        for own in (v for i, v in ints if i == q):
            for i, v in ints:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(own @ v))
        out[q] = sorted(((i, int(s)) for i, s in best.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_topk_ties_shared_ids_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(n, (base[n % 12] + 0.05 * rng.normal(size=8)).tolist()) for n in range(600)]
    rows += [(7, (9 * base[1] + j).tolist()) for j in range(6)]                 # one id on several high vectors
    rows += [(1000 + n, base[3].tolist()) for n in range(300)]                  # ties
    rows += [(2000 + n, rng.normal(size=8).tolist()) for n in range(100)]
    rows += rows[:40]                                                           # repeated rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "0 as pivot", "1 as block", "2 as tree").repartition(5)
    asked = [n for n in sorted({i for i, _ in rows}) if n % 50 == 7 or n in (1003, 2001)]
    for block_bytes in (1 << 19, 1 << 10):                                      # one block, and blocks of 32 rows and 8 queries
        got = {}
        for r in sorted(topk.search(table, table.where(f"vec_id in ({','.join(map(str, asked))})"), k=5, block_bytes=block_bytes).collect()):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == top_by_hand(rows, asked, 5)


def test_cover_tree_covers_every_row_at_falling_scales():
    rng = np.random.default_rng(1)
    x = np.rint(100 * np.repeat(rng.normal(size=(40, 6)), 20, 0) + rng.normal(size=(800, 6)))
    tree = topk.CoverTree.unpack(topk.CoverTree.grow(np.arange(800), x).pack())
    assert sorted(tree.ids.tolist()) == list(range(800)) and len(tree.lo) > 20
    for i in range(len(tree.lo)):
        dist = np.sqrt(((tree.x[tree.lo[i]:tree.hi[i]] - tree.middle[i]) ** 2).sum(1))
        assert (dist <= tree.radius[i]).all()
        kids = range(tree.first[i], tree.last[i])
        assert not kids or [tree.lo[i], *(tree.hi[j] for j in kids)] == [*(tree.lo[j] for j in kids), tree.hi[i]]
        assert all(tree.radius[j] < tree.radius[i] for j in kids)


def test_topk_on_awkward_rows(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    got = topk.search(rows, rows.where("vec_id in (9006, 9008)"), k=5, scale=256.0).collect()
    assert {r.query_id for r in got} <= {9006} and all(r.vec_id in (9003, 9007) for r in got)
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_embedding_links_against_all_pairs(spark):
    base = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], np.float64)
    rng = np.random.default_rng(1)
    noise = rng.standard_normal((3, *base[:200].shape)) * 0.25 * np.linalg.norm(base[:200], axis=1)[:, None] / base.shape[1] ** 0.5
    x = np.concatenate([base, *(base[:200] + noise), base[:20]])     # near copies on both sides of the threshold, and equal rows
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(x).all(1) & (norm > 0)
    cos = (x / np.where(norm > 0, norm, 1)[:, None]) @ (x / np.where(norm > 0, norm, 1)[:, None]).T
    link = (cos >= 0.95) & ok & ok[:, None] & ~np.eye(len(x), dtype=bool)
    want = dict(enumerate(link.sum(1).tolist()))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def test_embedding_links_of_rare_and_hot_groups(spark):
    rng = np.random.default_rng(2)

    def near(v, cos):    # unit vectors at that cosine
        side = rng.standard_normal(v.shape)
        side -= (side * v).sum(1)[:, None] * v
        return cos * v + (1 - cos * cos) ** 0.5 * side / np.linalg.norm(side, axis=1)[:, None]

    base = rng.standard_normal((2500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rare = np.concatenate([base, near(base[:40], 0.951)])                        # pairs just above the threshold, in few rows
    hot = np.concatenate([rare, near(np.repeat(base[-1:], 600, 0), 0.9999)])     # and a group whose links are all short
    for x, queries in ((rare, 16_384), (hot, 16_384), (hot, 300)):               # 300: too few linked, the limit stays whole
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        want = dict(enumerate(((unit @ unit.T >= 0.95).sum(1) - 1).tolist()))
        more = {} if queries == 16_384 else {"queries": queries}
        assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, **more).collect()} == want


def test_embedding_links_by_a_measured_limit(spark):
    """Enough linked ones among the asked: the traversal stops early; links, components and kept rows hold."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 16))
    x = np.concatenate([base, np.repeat(base, 3, 0) + 0.04 * rng.standard_normal((1200, 16)), base[:5]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    comp = np.arange(len(x))
    while (new := np.where(link, comp[None, :], len(x)).min(1)).tolist() != comp.tolist():
        comp = new
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, queries=300, target_recall=0.99, sample=512).collect()}
    found, want = sum(r.n_links for r in got.values()), link.sum() - len(x)
    assert len(got) == len(x) and 0.99 * want <= found <= want
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_codebooks_give_bounds(spark):
    rng = np.random.default_rng(4)
    x, centres = rng.standard_normal((200, 6)), rng.standard_normal((20, 6))
    own = embedding_dedup._squares(x, centres).argmin(1)
    radii = np.array([np.linalg.norm(x[own == c] - centres[c], axis=1).max(initial=0) for c in range(20)])
    got, low = embedding_dedup.bounds(x, centres, radii, embedding_dedup.spacing(centres))
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (got == own).all() and (low[:, own] <= gap + 1e-9).all()
    limit = float(np.quantile(low, 0.3))
    cells = embedding_dedup.multi_sequence(low[0], low[1], limit, 4)
    inside = {(i, j) for i in range(20) for j in range(20) if low[0, i] + low[1, j] <= limit}
    assert inside <= set(cells) and len(cells) == max(4, len(inside)) == len(set(cells))


def test_embedding_links_on_awkward_rows(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(rows).collect()
    assert len(got) == len(ODD)
    by = {r.vec_id: r for r in got}
    assert (by[9007].n_links, by[9007].component_id, by[9006].kept) == (2, 9006, True)
    assert all(by[i].n_links == 0 for i in (9001, 9002, 9003, 9004, 9005, 9008, None))
