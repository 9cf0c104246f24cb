"""Exact top-k search by the three-phase uniform threshold method.

The components of a vector are cut into blocks; the score of a pair is the sum
of its blocks' partial products.  Phase one gathers, for every query, the local
lists of the largest partial products; their exact totals give a cutoff that at
least k rows reach.  Phase two broadcasts it and keeps the entries whose partial
product is at least a uniform share of it: a row that reaches the cutoff has
one.  Phase three resolves the remaining partial products of those rows exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import written
from noticeboard.session import scratch_path

ROWS = 1024          # vectors multiplied at once
EXACT = 2.0 ** 53


def usable(embedding: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """Every distinct vector once with its ``n`` smallest ids: (vector, ids).

    No result can hold more ids of one vector, so copies are neither compared
    nor moved one by one: repeats of an id are merged and the rank is limited
    before anything moves.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return rows.distinct().withColumn("_n", place).filter(F.col("_n") <= n).groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))


def query_blocks(rows: DataFrame, queries: Column, size: int, dims: int):
    """The query vectors, about ``size`` at a time, in order of id within a block: (ids, vectors as rows).

    The queries are stored by block, so a block is read by itself and only one at
    a time is on the driver.  Of rows that repeat a query's id the smallest vector is the query.
    """
    found = written(rows.filter(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n = -(-found.count() // size)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))).cast("int")
    stored = written(found.withColumn("block", block).repartition("block"), "blocks", partitionBy="block")
    for b in range(n):
        one = sorted((r.vec_id, r.vector) for r in stored.filter(F.col("block") == b).select("vec_id", "vector").collect())
        if one:
            yield np.array([i for i, _ in one], np.int64), padded([v for _, v in one], dims)


def block_results(spark: SparkSession, blocks, search, schema: str) -> DataFrame:
    """What ``search(ids, vectors, share)`` finds for every block, stored block by block.

    ``share`` broadcasts a value until the block is stored.  Plans and broadcasts
    are those of one block, however many there are.
    """
    path, used, empty = scratch_path(spark, "results"), [], True

    def share(value):
        used.append(spark.sparkContext.broadcast(value))
        return used[-1]

    for b, (ids, q) in enumerate(blocks):
        search(ids, q, share).write.parquet(f"{path}/block={b}")
        while used:
            used.pop().destroy()
        empty = False
    if empty:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop("block")


def padded(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :min(len(v), dims)] = v[:dims]
    return out


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    sizes = np.asarray(pa.compute.list_value_length(vectors))
    if len(sizes) and (sizes == dims).all():
        return np.asarray(vectors.flatten(), float).reshape(-1, dims)
    return padded(vectors.to_pylist(), dims)


def matrices(batches, dims: int):
    """(vectors as a matrix, ids of each) for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield matrix(part.column("vector"), dims), part.column("ids").to_pylist()


def own_entries(ids: list[list[int]], position: dict[int, int]) -> tuple[list[int], list[int]]:
    """(queries, rows) of vectors that only the query itself has."""
    found = [(position[i[0]], r) for r, i in enumerate(ids) if len(i) == 1 and i[0] in position]
    return [a for a, _ in found], [b for _, b in found]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query: (query_id, rank, vec_id, score)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, blocks: int = 4,
                query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k largest integer inner products.

    Components become floor(scale * x).  ``queries`` is a condition on
    ``vec_id``; candidates are all rows but the query's own; ties go to the
    smaller id.  Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; rows that repeat id and vector count
    once; a shorter vector is taken as ending in zeros.  An empty table gives no
    row.  Only ``vec_id`` and ``embedding`` are read.  Scores beyond 2**53 raise an error.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    found = written(distinct_vectors(rows, k + 1), "vectors")
    dims = found.agg(F.max(F.size("vector")).alias("dims")).first().dims
    return block_results(vectors.sparkSession, query_blocks(rows, queries, query_block, dims or 0),
                         lambda ids, q, share: ranked(_search(found, ids, q, k, blocks, share), k),
                         "query_id long, rank int, vec_id long, score long")


def _cuts(dims: int, blocks: int) -> list[slice]:
    edges = [round(i * dims / blocks) for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [slice(0, dims)]


def _search(found: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, blocks: int, share) -> DataFrame:
    shared = share((ids, q, _cuts(q.shape[1], blocks)))

    def local_lists(batches):
        """Per query: the k best totals among the longest partial products, and each block's least one."""
        ids, q, cuts = shared.value
        position = {int(i): n for n, i in enumerate(ids)}
        best = np.full((len(ids), k), -np.inf)
        least = np.zeros((len(ids), len(cuts)))
        seen = False
        for x, owners in matrices(batches, q.shape[1]):
            if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] >= EXACT:
                raise ValueError("scores leave the range of exact integers")
            own = own_entries(owners, position)
            listed = []
            for b, cut in enumerate(cuts):
                part = q[:, cut] @ x[:, cut].T
                least[:, b] = np.minimum(least[:, b], part.min(axis=1)) if seen else part.min(axis=1)
                part[own] = -np.inf
                n = min(k, part.shape[1])
                listed.append(np.argpartition(-part, n - 1, axis=1)[:, :n])
            seen = True
            at = np.sort(np.concatenate(listed, axis=1), axis=1)
            total = np.einsum("qd,qld->ql", q, x[at], optimize=True)
            total[:, 1:][at[:, 1:] == at[:, :-1]] = -np.inf     # listed by several blocks
            total[(at[:, :, None] == _own_rows(own, len(ids))[:, None, :]).any(axis=2)] = -np.inf
            best = -np.sort(-np.concatenate([best, total], axis=1), axis=1)[:, :k]
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(ids)), pa.int32()), pa.array([[float(v) for v in r if v > -np.inf] for r in best], pa.list_(pa.float64())),
                 pa.array(least.tolist(), pa.list_(pa.float64()))], names=["q", "best", "least"])

    lists = found.mapInArrow(local_lists, "q int, best array<double>, least array<double>")
    top = Window.partitionBy("q").orderBy(F.desc("total"))
    kth = lists.select("q", F.explode("best").alias("total")).withColumn("n", F.row_number().over(top)).filter(
        F.col("n") == k).select("q", "total")
    floors = lists.groupBy("q").agg(*[F.min(F.element_at("least", b + 1)).alias(f"b{b}") for b in range(len(shared.value[2]))])
    cutoff = np.full(len(ids), -np.inf)
    floor = np.zeros((len(ids), len(shared.value[2])))
    for r in floors.join(kth, "q", "left").collect():        # one row per query of the block
        cutoff[r.q] = -np.inf if r.total is None else r.total
        floor[r.q] = r[1:1 + floor.shape[1]]
    # products less their floor are not negative, so the method's bound holds
    part = (cutoff - floor.sum(axis=1)) / floor.shape[1]
    limits = share((cutoff, floor + part[:, None]))

    def resolved(batches):
        """Local top k among the rows that can reach the cutoff."""
        ids, q, cuts = shared.value
        cutoff, bar = limits.value
        position = {int(i): n for n, i in enumerate(ids)}
        kept_q, kept_id, kept_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, owners in matrices(batches, q.shape[1]):
            reach = np.zeros((len(ids), len(x)))
            sufficient = np.zeros(reach.shape, bool)
            for b, cut in enumerate(cuts):
                part = q[:, cut] @ x[:, cut].T
                sufficient |= part >= bar[:, b:b + 1]
                reach += np.maximum(part, bar[:, b:b + 1])      # no more than the bar where nothing was sent
            qi, ri = np.nonzero(sufficient & (reach >= cutoff[:, None]))
            total = np.concatenate([np.einsum("ed,ed->e", q[qi[i:i + 65536]], x[ri[i:i + 65536]])
                                    for i in range(0, len(qi), 65536)] or [np.zeros(0)])
            reached = total >= cutoff[qi]
            qi, ri, total = qi[reached], ri[reached], total[reached]
            for n in range(k + 1):                              # the vector's ids, no more than k + 1
                has = [j for j, r in enumerate(ri) if len(owners[r]) > n]
                vec = np.array([owners[ri[j]][n] for j in has], np.int64)
                other = vec != ids[qi[has]] if has else np.zeros(0, bool)
                kept_q.append(qi[has][other])
                kept_id.append(vec[other])
                kept_score.append(total[has][other])
            a, v, s = map(np.concatenate, (kept_q, kept_id, kept_score))
            order = np.lexsort((v, -s, a))
            a, v, s = a[order], v[order], s[order]
            first = np.searchsorted(a, a)
            top = np.arange(len(a)) - first < k
            kept_q, kept_id, kept_score = [a[top]], [v[top]], [s[top]]
        if len(kept_q[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept_q[0]]), pa.array(kept_id[0]), pa.array(kept_score[0].astype(np.int64))],
                                             names=["query_id", "vec_id", "score"])

    return found.mapInArrow(resolved, "query_id long, vec_id long, score long")


def _own_rows(own: tuple[list[int], list[int]], n: int) -> np.ndarray:
    """For each query the row that is its own, or -1, as a column."""
    out = np.full((n, 1), -1)
    out[own[0], 0] = own[1]
    return out
