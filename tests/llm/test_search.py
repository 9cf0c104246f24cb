"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import tput_search, vp_search
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)


def fixture(seed=1, n=240, dims=9):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(0, 1, dims).astype(np.float32)]) for i in range(n)]
    same = rows[7][1]
    rows = [(i, same if i % 3 == 0 else v) for i, v in rows]        # a third is one vector
    rows += [(n, None), (n + 1, [1.0, None] + [0.0] * (dims - 2)), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims),
             (None, same), (n + 4, [2.0]), (n + 5, []), (5, rows[5][1]), (n + 6, [0.0] * dims)]
    return rows


def brute(rows, of_query, k, exact, zeros):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
                   and (zeros or any(x != 0 for x in v))})
    dims = max(len(v) for _, v in good)
    change = (lambda x: float(np.floor(256 * x))) if exact else float
    padded = [(i, [change(x) for x in v] + [0.0] * (dims - len(v))) for i, v in good]
    out = []
    for q, v in padded:
        if of_query(q):
            best = sorted((-sum(np.float64(a) * b for a, b in zip(v, w)), i) for i, w in padded if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 1000])
def test_exact_search_equals_brute_force(spark, k):
    rows = fixture()
    got = tput_search.exact_top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k, query_block=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda q: q % 10 == 0, k, True, True)


def test_factor_one_is_exact_and_recall_is_high(spark):
    rows = fixture(2)
    df = frame(spark, rows)
    got = vp_search.nearest(df, F.col("vec_id") % 10 == 0, 6, factor=1.0, query_block=9)
    want = brute(rows, lambda q: q % 10 == 0, 6, False, False)
    assert sorted(tuple(r)[:3] for r in got.collect()) == [w[:3] for w in want]
    assert np.allclose(sorted(r.score for r in got.collect()), sorted(w[3] for w in want))


def clustered(n, dims=16, centres=128):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (centres, dims))[r.integers(0, centres, n)] + r.normal(0, 0.12, (n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kth_limits(x, q, k):
    """(limit, visited rows a query, visit) for a search of the rows ``x`` by distance."""
    limit, seen = np.full(len(q), np.inf), [[] for _ in q]

    def visit_rows(at, rows):
        for i in at:
            seen[i] += [(d, r) for d, r in zip(np.linalg.norm(x[rows] - q[i], axis=1), rows)]
            if len(seen[i]) >= k:
                limit[i] = sorted(seen[i])[k - 1][0]

    return limit, seen, visit_rows


def test_a_tree_of_many_leaves_is_exact_with_factor_one():
    r = np.random.default_rng(4)
    x, q = r.normal(0, 1, (3000, 8)), r.normal(0, 1, (20, 8))
    tree = vp_search.VantageTree(x, leaf=32)
    assert sorted(np.concatenate(tree.leaves)) == list(range(3000))
    limit, seen, visit = kth_limits(x, q, 5)
    bounds = vp_search.leaf_bounds(q, x[tree.vantages], tree.paths)
    vp_search.search_leaves(bounds, limit, 1.0, lambda at, n: visit(at, tree.leaves[n]))
    full = np.sort(np.linalg.norm(x[None] - q[:, None], axis=2), axis=1)[:, 4]
    assert np.allclose(limit, full) and np.mean([len(s) for s in seen]) < 3000
    # no bound exceeds the distance of a row of its leaf
    least = np.stack([np.linalg.norm(x[leaf][None] - q[:, None], axis=2).min(axis=1) for leaf in tree.leaves], axis=1)
    assert (bounds <= least + 1e-9).all()


def test_trees_prune_where_vectors_have_structure():
    x = clustered(16384)
    q, tree = x[::128], vp_search.VantageTree(x)
    limit, seen, visit = kth_limits(x, q, 21)
    vp_search.search_leaves(vp_search.leaf_bounds(q, x[tree.vantages], tree.paths), limit, 4.0, lambda at, n: visit(at, tree.leaves[n]))
    want = np.argsort(np.linalg.norm(x[None] - q[:, None], axis=2), axis=1)[:, :21]
    found = [len({r for _, r in sorted(s)[:21]} & set(w)) / 21 for s, w in zip(seen, want)]
    assert np.mean(found) >= 0.9 and np.mean([len(s) for s in seen]) < 0.5 * len(x)


@pytest.mark.parametrize("block", [4096, 100])
def test_tuned_search_keeps_its_recall(spark, monkeypatch, block):
    x = clustered(16384)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    chosen, tuned = [], vp_search.tuned_factor
    monkeypatch.setattr(vp_search, "tuned_factor", lambda *a: chosen.append(tuned(*a)) or chosen[-1])
    got = vp_search.nearest(df, F.col("vec_id") % 64 == 0, query_block=block)
    product = x[::64] @ x.T
    product[np.arange(256), np.arange(256) * 64] = -np.inf
    want = {(i * 64, int(j)) for i, row in enumerate(np.argsort(-product, axis=1)[:, :20]) for j in row}
    rows = got.collect()
    assert len(rows) == 256 * 20 and len(chosen) == 1 and chosen[0] > 1      # tuned once, and it prunes
    assert len(want & {(r.query_id, r.vec_id) for r in rows}) >= 0.9 * len(want)
    assert all(np.isclose(r.score, x[r.query_id] @ x[r.vec_id]) for r in rows[:500])
    # however many blocks there are, the plan is a scan
    assert "Union" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()


def test_recall_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact, loose = (vp_search.nearest(e, F.col("vec_id") % 20 == 0, factor=f).select("query_id", "vec_id") for f in (1.0, None))
    assert exact.join(loose, ["query_id", "vec_id"]).count() >= 0.95 * exact.count()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert tput_search.exact_top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert vp_search.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    alone = frame(spark, [(0, [1.0, 2.0])])
    assert tput_search.exact_top_k(alone, F.col("vec_id") % 50 == 0).count() == 0
    assert vp_search.nearest(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_exact_integers_are_refused(spark):
    df = frame(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])])
    with pytest.raises(Exception, match="exact integers"):
        tput_search.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()

