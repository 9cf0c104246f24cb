"""Importance resampling, sharding and ranked lexical search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import aho_search, hypergeometric_shards, overlap_resampling, queries
from tests.llm.helpers import ROWS, documents, pairs

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("rank", F.lit(7)).repartition(2)


# --- importance resampling ---------------------------------------------------------------
def features(text, sizes=(1, 2)):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in sizes for i in range(len(w) - n + 1)]


def brute_ranks(docs, target, share, least, buckets, sizes=(1, 2)):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in rows for f in features(x, sizes)) for rows in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in docs:
        f = features(text, sizes)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:share * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def prose(n, seed, start=100):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "GAMMA", "delta", "épsilon", "zeta9", "日本", "eta", f"w{r.randrange(200)}"])
    return [(start + i, r.choice([" ", ", ", "\n\n"]).join(word() for _ in range(r.randrange(60))), "en", "src1", 0) for i in range(n)]


@pytest.mark.parametrize("share, sizes", [(25, (1, 2)), (100, (1, 2)), (40, (1, 2, 3))])
def test_ranks_equal_brute_force(spark, share, sizes):
    rows = ROWS + prose(150, 1) + [(500, "one two three", "en", "a", 0)] * 3 + prose(2, 5, 100)
    target = [(1, "alpha beta gamma, delta"), (2, None), (3, ""), (1, "Zeta9 alpha")]
    got = overlap_resampling.importance_ranks(documents(spark, rows), items(spark, target), share, least_words=3, buckets=500, sizes=sizes)
    assert pairs(got.collect()) == pairs(brute_ranks(rows, [t for _, t in target], share, 3, 500, sizes))


def test_ranks_without_target_or_documents(spark):
    none = items(spark, [])
    rows = prose(30, 2)
    got = overlap_resampling.importance_ranks(documents(spark, rows), none, least_words=5, buckets=100)
    assert pairs(got.collect()) == pairs(brute_ranks(rows, [], 25, 5, 100))
    assert overlap_resampling.importance_ranks(documents(spark, []), items(spark, [(1, "a b")])).count() == 0


def test_drawn_documents_are_whole_rows(spark):
    docs = documents(spark, ROWS + prose(60, 3))
    ranks = overlap_resampling.importance_ranks(docs, items(spark, [(1, "alpha beta")]), least_words=5)
    drawn = overlap_resampling.drawn_documents(docs, ranks)
    ids = {r.doc_id for r in ranks.collect() if r.rank}
    assert drawn.columns == docs.columns and ids and {r.doc_id for r in drawn.collect()} == ids - {None}


def test_scans_overlap_and_keep_every_byte():
    n, found = overlap_resampling.bucket_scanner((2,), 1 << 31)("A b\x00c --É".encode())
    assert n == 4 and found.tolist() == [zlib.crc32(f.encode()) % (1 << 31) for f in ("a b", "b c", "c É")]


# --- sharding ----------------------------------------------------------------------------
def test_shards_are_exact_and_gapless(spark):
    rows = ROWS + prose(300, 4) + [(7000 + i, "copy", "en", "a", 0) for i in range(150)]
    docs = documents(spark, rows).withColumns({"shard": F.lit("x"), "_key": F.lit(1), "_row": F.lit(2)}).repartition(5).checkpoint()
    got = hypergeometric_shards.sharded(docs, 24, seed=3, rows_per_task=4)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    places = {}
    for r in got.collect():
        places.setdefault(r.shard, []).append(r.slot)
    sizes = [len(places[k]) for k in range(24)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    columns = ["doc_id", "text", "lang", "n_chars"]
    assert pairs(got.select(*columns).collect()) == pairs(docs.select(*columns).collect())
    again = hypergeometric_shards.sharded(docs, 24, seed=3, rows_per_task=4)
    assert pairs(again.collect()) == pairs(got.collect())
    other = hypergeometric_shards.sharded(docs, 24, seed=4, rows_per_task=4)
    assert pairs(other.collect()) != pairs(got.collect())


def test_few_or_no_rows(spark):
    few = hypergeometric_shards.sharded(documents(spark, ROWS[:3]).checkpoint())
    assert sorted((r.shard, r.slot) for r in few.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert hypergeometric_shards.shard_digests(documents(spark, [])).count() == 0


def test_digests_of_odd_rows(spark):
    got = hypergeometric_shards.shard_digests(documents(spark).checkpoint()).collect()
    want = [(i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in ROWS]
    assert pairs((r.doc_id, r.size, r.text_crc32) for r in got) == pairs(want)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_the_tree_draws_one_matrix():
    counts, sizes = np.array([0, 7, 30, 0, 12, 1, 50, 3]), (35, 34, 34)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()
    matrix = np.array([hypergeometric_shards.matrix_row(ends, sizes, 5, p) for p in range(len(counts))])
    assert (matrix.sum(axis=1) == counts).all() and tuple(matrix.sum(axis=0)) == sizes
    hypergeometric_shards._node.cache_clear()
    assert (hypergeometric_shards.matrix_row(ends, sizes, 5, 4) == matrix[4]).all()    # alone, from the root


def test_the_matrix_follows_the_law_of_a_uniform_shuffle():
    # all ways to place 6 rows of 3 partitions in 3 shards of 2
    counts, n = [1, 3, 2], 6000
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()
    owner, exact = [0, 1, 1, 1, 2, 2], Counter()
    for order in itertools.permutations(range(6)):
        m = np.zeros((3, 3), int)
        for slot, row in enumerate(order):
            m[owner[row], slot // 2] += 1
        exact[m.tobytes()] += 1 / 720
    seen = Counter()
    for seed in range(n):
        seen[np.array([hypergeometric_shards.matrix_row(ends, (2, 2, 2), seed, p) for p in range(3)], int).tobytes()] += 1
    assert set(seen) <= set(exact)
    chi = sum((seen[m] - n * p) ** 2 / (n * p) for m, p in exact.items())
    assert chi < len(exact) + 6 * (2 * len(exact)) ** 0.5


def test_large_populations_follow_the_same_law():
    rng = np.random.default_rng(1)
    drawn = np.bincount([hypergeometric_shards.hypergeometric(rng, 12, 18, 9, widest=0) for _ in range(20_000)], minlength=10)
    p = np.array([math.comb(12, x) * math.comb(18, 9 - x) / math.comb(30, 9) for x in range(10)])
    some = p * 20_000 > 5
    assert (((drawn - 20_000 * p) ** 2 / (20_000 * p))[some]).sum() < 40
    for taken, good, bad in ((0, 5, 5), (10, 5, 5), (3, 0, 8), (8, 8, 0)):
        assert hypergeometric_shards.hypergeometric(rng, good, bad, taken, widest=0) == (taken * good // (good + bad))
    big = [hypergeometric_shards.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10**7) for _ in range(60)]
    assert abs(np.mean(big) - 4e6) < 1e3 and 800 < np.std(big) < 2500


def test_every_row_reaches_every_place_alike(spark):
    docs = spark.range(0, 12, numPartitions=3).withColumn("text", F.lit("x"))
    first = Counter()
    for seed in range(20):
        for r in hypergeometric_shards.sharded(docs, 2, seed, rows_per_task=2).filter("shard = 0").collect():
            first[r.id] += 1
    assert sum(first.values()) == 120 and all(1 <= first[i] <= 19 for i in range(12))   # 10 each; 4 deviations


# --- ranked lexical search ---------------------------------------------------------------
def brute_top(docs, wanted, k):
    counts = [(d[0], Counter(words(d[1]))) for d in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    of_item = {}
    for item, text in wanted:
        of_item.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in of_item.items():
        scored = []
        for doc_id, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


WANTED = [(1, "alpha BETA w7 w8"), (2, None), (3, "..."), (4, "日本 épsilon alpha alpha"), (1, "fox"), (None, "zeta9 w3"), (5, "nowhere"), (6, "der satz")]


@pytest.mark.parametrize("k, block_terms", [(5, 200_000), (1000, 4)])
def test_search_equals_brute_force(spark, k, block_terms):
    rows = ROWS + prose(200, 6) + prose(3, 7, 100) + [(900 + i, "alpha beta", "en", "a", 0) for i in range(40)]
    got = aho_search.lexical_top(documents(spark, rows), items(spark, WANTED), k, block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert pairs(got.collect()) == pairs(brute_top(rows, WANTED, k))


def test_lists_are_settled_as_they_grow(monkeypatch):
    r = np.random.default_rng(2)
    best = aho_search.Best(3, 4)
    best.most = 10
    scores = r.integers(0, 6, (90, 3)).astype(float)
    for i in range(0, 90, 10):
        best.add(scores[i:i + 10], np.arange(90 - i, 80 - i, -1), np.zeros(10, bool))
    item, score, ids, _ = best.settled()
    for x in range(3):
        want = sorted((-s, 90 - i) for i, s in enumerate(scores[:, x]) if s >= 1)[:4]
        assert [(-s, d) for s, d in zip(score[item == x], ids[item == x])] == want


def test_search_in_nothing(spark):
    assert aho_search.lexical_top(documents(spark, []), items(spark, WANTED)).count() == 0
    assert aho_search.lexical_top(documents(spark), items(spark, [])).count() == 0
    assert aho_search.lexical_top(documents(spark, [(1, None, None, None, 0), (2, "", None, None, 0)]), items(spark, WANTED)).count() == 0


def test_terms_are_guarded():
    a = aho_search.guarded_automaton(["he", "she", "é"])
    n, found, times = aho_search.term_counts(a, "He she-he hers sheé É é".encode())
    assert n == 7 and dict(zip(found.tolist(), times.tolist())) == {0: 2, 1: 1, 2: 1}


def test_the_new_queries_are_registered():
    assert {"op11_overlap_resampling", "op12_hypergeometric_shards", "op13_aho_search"} <= set(queries.QUERIES)


def test_the_scan_hands_over_a_few_texts_at_a_time(spark, monkeypatch):
    """op11: the buckets of a batch are not held at once."""
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(overlap_resampling, "written", lambda run, _: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["Ab cd  ef", None] * 500})
    parts = list(overlap_resampling.scanned(Docs())(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 256 and sum(p.num_rows for p in parts) == 1000
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(1000))
    assert rows[0]["n_words"] == 3 and len(rows[0]["buckets"]) == 10 and rows[1]["buckets"] == b""
