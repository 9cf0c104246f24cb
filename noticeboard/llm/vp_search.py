"""Approximate nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes least distance when every vector gets one more
component that brings all to the same length.  A shard's tree halves its
vectors by their distance to a vantage point; a query skips a leaf when the
triangle inequality's lower bound, times a factor, exceeds its k-th distance.
Factor one is the exact search; a larger one skips more.  The trees are built
once and stored a leaf a row; every block of queries is held against that table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import written
from noticeboard.llm.tput_search import block_results, distinct_vectors, matrix, query_blocks, ranked, usable

LEAF = 128           # vectors of a leaf at most
SHARD = 4096         # vectors of one tree, about
LEAVES = 128         # leaves searched together
FILE = 256           # leaves of one file of the index
SLACK = 1e-7         # of a distance, for rounding
FACTORS = (32.0, 16.0, 8.0, 4.0, 2.0)
INDEX = ("vectors binary, ids array<array<long>>, shard long, vantages array<int>, points binary, "
         "low array<double>, high array<double>")


class VantageTree:
    """Leaves of row numbers, each with the distance bounds met on its way."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.vantages, self.leaves, self.paths = x, [], [], []
        waiting = [(np.arange(len(x)), [])]
        while waiting:
            rows, path = waiting.pop()
            if len(rows) > leaf:
                # the row farthest from the first one: its distances spread most
                far = rows[np.linalg.norm(x[rows] - x[rows[0]], axis=1).argmax()]
                d = np.linalg.norm(x[rows] - x[far], axis=1)
                order = np.argsort(d, kind="stable")
                inner, outer = order[:len(order) // 2], order[len(order) // 2:]
                vantage = len(self.vantages)
                self.vantages.append(far)
                waiting += [(rows[part], [*path, (vantage, d[part].min(), d[part].max())]) for part in (outer, inner)]
            elif len(rows):
                self.leaves.append(rows)
                self.paths.append(path)


def leaf_bounds(q: np.ndarray, points: np.ndarray, paths: list[list[tuple[int, float, float]]]) -> np.ndarray:
    """Lower bounds of the distance of every query to every leaf; a path names rows of ``points``."""
    out = np.zeros((len(paths), len(q)))
    if len(points):
        d = np.sqrt(np.maximum((points ** 2).sum(1)[:, None] + (q ** 2).sum(1) - 2 * points @ q.T, 0))
        for n, path in enumerate(paths):
            for v, low, high in path:
                np.maximum(out[n], np.maximum(low - d[v], d[v] - high), out=out[n])
    return out.T


def search_leaves(bounds: np.ndarray, limit: np.ndarray, factor: float, visit, first: int = 2, slack: float = 0.0) -> None:
    """Call ``visit(queries, leaf)`` for the leaves a query cannot skip.

    Every query visits its ``first`` nearest leaves to get a limit; the others
    follow leaf by leaf, so that one product serves many queries.  ``limit``
    holds the k-th distances and is brought up to date by ``visit``.
    """
    done = np.zeros(bounds.shape, bool)
    near = np.argsort(bounds, axis=1, kind="stable")[:, :first]
    for turn in range(near.shape[1]):
        leaf = near[:, turn]
        going = np.flatnonzero(factor * bounds[np.arange(len(bounds)), leaf] <= limit + slack)
        for n in np.unique(leaf[going]):
            visit(going[leaf[going] == n], n)
        done[going, leaf[going]] = True
    for n in np.argsort(bounds.mean(axis=0), kind="stable"):
        going = np.flatnonzero(~done[:, n] & (factor * bounds[:, n] <= limit + slack))
        if len(going):
            visit(going, n)


def tree_index(found: DataFrame, dims: int, longest: float, rows: int) -> DataFrame:
    """The stored index of (vector, ids): a row for every leaf of a tree for every shard of about ``SHARD`` vectors.

    A leaf's row holds its vectors, their ids and its path, so it can be searched
    wherever a file is split.
    """
    def build(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vector").combine_chunks(), dims)
        ids, shard = table.column("ids").to_pylist(), table.column("shard")[0].as_py()
        tree = VantageTree(lifted(x, longest))
        out = [{"vectors": x[leaf].tobytes(), "ids": [ids[r] for r in leaf], "shard": shard, "vantages": [v for v, _, _ in path],
                "points": tree.x[[tree.vantages[v] for v, _, _ in path]].tobytes(), "low": [low for _, low, _ in path],
                "high": [high for _, _, high in path]} for leaf, path in zip(tree.leaves, tree.paths)]
        return pa.Table.from_pylist(out, pa.schema([
            ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("shard", pa.int64()), ("vantages", pa.list_(pa.int32())),
            ("points", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    # the vectors are distinct, so their hashes are even
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(max(1, -(-rows // SHARD)))))
    return written(sharded.groupBy("shard").applyInArrow(build, INDEX), "trees", maxRecordsPerFile=FILE)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all squared lengths ``longest``."""
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x ** 2).sum(axis=1), 0))[:, None]], axis=1)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float | None = None, query_block: int = 4096,
            recall: float = 0.97, sample: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k largest inner products found.

    ``queries`` is a condition on ``vec_id``; candidates are all rows but the
    query's own; ties go to the smaller id.  The score is the double-precision
    product of the original vectors, summed in order of components.  Without
    ``factor`` the largest of ``FACTORS`` is taken at which ``sample`` of the
    queries find at least ``recall`` of what an exact search of all rows finds
    for them, or one.  Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; rows that repeat id and
    vector count once; a shorter vector is taken as ending in zeros.  Every row
    is indexed.  An empty table gives no row.  Only ``vec_id`` and ``embedding`` are read.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))
                          & F.exists("embedding", lambda x: x != 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    found = written(distinct_vectors(rows, k + 1), "vectors")
    about = found.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"),
                      F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not about.n:
        return spark.createDataFrame([], schema)
    index = tree_index(found, about.dims, about.longest, about.n)

    chosen = factor

    def search(ids: np.ndarray, q: np.ndarray, share) -> DataFrame:
        nonlocal chosen

        def at(by: float, n: int) -> DataFrame:
            return ranked(_search(index, ids[:n], q[:n], k, by, about.longest, share), k)

        if chosen is None:
            chosen = tuned_factor(lambda by: at(by, sample), recall)
        return at(chosen, len(ids))

    return block_results(spark, query_blocks(rows, queries, query_block, about.dims), search, schema)


def tuned_factor(search, recall: float) -> float:
    """The largest factor whose results hold the share ``recall`` of the exact ones; ``search`` takes a factor."""
    def pairs(by: float) -> set[tuple[int, int]]:
        return {(r.query_id, r.vec_id) for r in search(by).select("query_id", "vec_id").collect()}   # sample x k rows

    exact = pairs(1.0)
    return next((f for f in FACTORS if len(exact & pairs(f)) >= recall * len(exact)), 1.0)


def _search(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, factor: float, longest: float, share) -> DataFrame:
    shared = share((ids, q))

    def searched(batches):
        ids, q = shared.value
        high = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        square = (q ** 2).sum(axis=1) + longest
        best = _Best(ids, k)
        limit = np.full(len(q), np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, LEAVES):
                leaves = batch.slice(start, LEAVES).to_pylist()
                vantage: dict[tuple[int, int], int] = {}
                points, paths = [], []
                for leaf in leaves:
                    p = np.frombuffer(leaf["points"]).reshape(-1, high.shape[1])
                    for row, v in zip(p, leaf["vantages"]):
                        if vantage.setdefault((leaf["shard"], v), len(points)) == len(points):
                            points.append(row)
                    paths.append([(vantage[leaf["shard"], v], a, b) for v, a, b in zip(leaf["vantages"], leaf["low"], leaf["high"])])

                def visit(at, n):
                    x = np.frombuffer(leaves[n]["vectors"]).reshape(-1, q.shape[1])
                    for some in np.array_split(at, -(-len(at) // 512)):
                        best.add(some, q, x, leaves[n]["ids"])
                    # distances are sqrt(|q|^2 + M - 2 q.x)
                    limit[at] = np.sqrt(np.maximum(square[at] - 2 * best.kth[at], 0))

                bounds = leaf_bounds(high, np.array(points).reshape(-1, high.shape[1]), paths)
                search_leaves(bounds, limit, factor, visit, slack=SLACK * np.sqrt(longest + square.max()))
        qi, vec, score = best.rows()
        if len(qi):
            yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(searched, "query_id long, vec_id long, score double")


class _Best:
    """The k best of every query so far; ``kth`` is the k-th score, or minus infinity."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.kth = np.full(len(ids), -np.inf)

    def add(self, at: np.ndarray, q: np.ndarray, x: np.ndarray, owners: list[list[int]]) -> None:
        product = q[at] @ x.T
        slack = 1e-9 * (1 + np.abs(self.kth[at]))
        slack[np.isinf(slack)] = 0
        i, j = np.nonzero(product >= (self.kth[at] - slack)[:, None])
        if not len(i):
            return
        # summed in order, so equal vectors get equal scores wherever they are
        exact = np.cumsum(q[at[i]] * x[j], axis=1)[:, -1]
        names = [owners[r] for r in j]
        counts = np.array([len(n) for n in names])
        who, score = np.repeat(at[i], counts), np.repeat(exact, counts)
        vec = np.array([v for n in names for v in n], np.int64)
        other = vec != self.ids[who]
        who, score, vec = who[other], score[other], vec[other]
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < self.k
        touched = np.unique(who)
        back = np.searchsorted(touched, who[top])
        new_s = np.full((len(touched), self.k), -np.inf)
        new_v = np.full((len(touched), self.k), np.iinfo(np.int64).max)
        new_s[back, place[top]], new_v[back, place[top]] = score[top], vec[top]
        s = np.concatenate([self.score[touched], new_s], axis=1)
        v = np.concatenate([self.vec[touched], new_v], axis=1)
        order = np.lexsort((v, -s), axis=1)[:, :self.k]
        self.score[touched], self.vec[touched] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
        self.kth[touched] = self.score[touched, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.score > -np.inf)
        return i, self.vec[i, j], self.score[i, j]
