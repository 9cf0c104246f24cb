"""Sharding by a uniform shuffle with exact shard sizes.

How many rows of each partition go to each shard is drawn from the multivariate
hypergeometric law, the law of those counts in a uniform shuffle.  The matrix of
partitions by shards is never held: a binary tree halves the partitions, every
node splits its places between its halves with a seed of its own, and a task
walks down to its own row.  The task permutes the shards of its rows, the rows
are exchanged once, and a second permutation orders them within their shard.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 33                # bits of a row's place within its partition in monotonically_increasing_id
ROWS = 10_000              # rows of a reel: the part of a shard that one task orders
WIDEST = 1_000_000_000     # numpy's sampler takes populations below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int, widest: int = WIDEST) -> int:
    """How many of ``taken`` rows drawn from good + bad are good.

    Beyond numpy's range the law is inverted around its mode: its terms follow
    from each other by ratios, and twelve deviations to both sides hold all but 1e-30.
    """
    if good + bad < widest:
        return int(rng.hypergeometric(good, bad, taken))
    low, high = max(0, taken - bad), min(good, taken)
    n = good + bad
    mode = min(max((good + 1) * (taken + 1) // (n + 2), low), high)
    deviation = (taken / n * good * (bad / n) * ((n - taken) / max(n - 1, 1))) ** 0.5
    reach = int(12 * deviation) + 20
    below, above = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(below, above, dtype=np.float64)
    up = np.log(good - x) + np.log(taken - x) - np.log(x + 1) - np.log(bad - taken + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(up)])
    total = np.cumsum(np.exp(log_p - log_p.max()))
    return below + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def split(places: np.ndarray, taken: int, seed: tuple[int, ...], widest: int = WIDEST) -> np.ndarray:
    """How many of each shard's places go to ``taken`` rows: one shard after the other, given those before."""
    rng, out, rest = np.random.default_rng(seed), np.zeros_like(places), int(places.sum())
    for k, own in enumerate(places.tolist()):
        rest -= own
        out[k] = hypergeometric(rng, own, rest, taken, widest) if taken else 0
        taken -= int(out[k])
    return out


@lru_cache(maxsize=4096)
def _node(ends: bytes, sizes: tuple[int, ...], seed: int, low: int, high: int) -> tuple[int, ...]:
    """Places of the partitions low..high-1 by shard."""
    rows = np.frombuffer(ends, np.int64)
    l, h = 0, len(rows) - 1
    if (low, high) == (l, h):
        return sizes
    # the parent is found by walking down; nodes near the root stay in the cache
    while True:
        middle = (l + h) // 2
        if (low, high) in ((l, middle), (middle, h)):
            break
        l, h = (l, middle) if high <= middle else (middle, h)
    parent = np.array(_node(ends, sizes, seed, l, h), np.int64)
    left = split(parent, int(rows[middle] - rows[l]), (seed, l, h))
    return tuple((left if high == middle else parent - left).tolist())


def matrix_row(ends: bytes, sizes: tuple[int, ...], seed: int, part: int) -> np.ndarray:
    """How many rows of a partition go to each shard.  ``ends``: rows before each partition, and all, packed."""
    low, high = 0, len(ends) // 8 - 1
    while high - low > 1:
        middle = (low + high) // 2
        _node(ends, sizes, seed, low, high)
        low, high = (low, middle) if part < middle else (middle, high)
    return np.array(_node(ends, sizes, seed, low, high), np.int64)


@lru_cache(maxsize=2)
def dealt(ends: bytes, sizes: tuple[int, ...], seed: int, part: int) -> np.ndarray:
    """The shard of every row of a partition: its row of the matrix, permuted."""
    counts = matrix_row(ends, sizes, seed, part)
    kind = np.int16 if len(sizes) < 1 << 15 else np.int32
    return np.random.default_rng((seed, len(ends) // 8, part)).permutation(np.repeat(np.arange(len(sizes), dtype=kind), counts))


def shard_sizes(rows: int, shards: int) -> tuple[int, ...]:
    """As equal as whole numbers allow, the larger ones first."""
    return tuple(rows // shards + (k < rows % shards) for k in range(shards))


def sharded(docs: DataFrame, shards: int = 24, seed: int = 11, rows_per_task: int = ROWS) -> DataFrame:
    """All rows with ``shard`` 0 .. shards - 1 and ``slot``, the place within the shard from 0 without gaps.

    Every order of the rows is equally likely, whatever their order before, and
    the shards' sizes differ by one at most.  Rows are never looked at, so nulls,
    long texts and repeated rows do not matter, and equal texts are not kept
    together.  An empty table gives no row; with fewer rows than shards some
    shards are empty.  Columns of ``docs`` named shard or slot are replaced.

    ``docs`` is read twice, the first time without its columns, and must give the
    same rows in the same partitions each time, as a scan of files or a
    checkpoint does.  A shard is ordered in reels of about ``rows_per_task`` rows.
    """
    spark = docs.sparkSession
    at = F.monotonically_increasing_id()
    counts = {r.part: r.n for r in docs.select(F.shiftright(at, PLACES).alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    # one number a partition; partitions without rows have none
    ends = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=0) + 1)])]).astype(np.int64)
    total = int(ends[-1])
    shared = spark.sparkContext.broadcast((ends.tobytes(), shard_sizes(total, shards), seed))

    def shard_of(rows: pa.Array) -> pa.Array:
        ids, out = np.asarray(rows), np.zeros(len(rows), np.int32)
        for part in np.unique(ids >> PLACES):
            own = ids >> PLACES == part
            out[own] = dealt(*shared.value, int(part))[ids[own] & ((1 << PLACES) - 1)]
        return pa.array(out)

    reels = max(1, -(-total // (shards * rows_per_task)))
    key = F.xxhash64(F.lit(seed), "_at")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_at", at).withColumns(
            {"_shard": F.arrow_udf(shard_of, "int")(F.col("_at")), "_key": key}).withColumn("_reel", F.pmod(F.col("_key"), F.lit(reels)))

    before = Window.partitionBy("_shard").orderBy("_reel").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed(docs.select()).groupBy("_shard", "_reel").agg(F.count("*").alias("_n")).select(
        "_shard", "_reel", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = placed(docs.select(F.struct(*own).alias("_row") if own else F.lit(None).alias("_row")))
    order = F.row_number().over(Window.partitionBy("_shard", "_reel").orderBy("_key", "_at"))
    return rows.join(starts, ["_shard", "_reel"]).withColumn("_slot", F.col("_start") + order - 1).select(
        *([F.col("_row.*")] if own else []), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def shard_digests(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the sharded documents; a null text has no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharded(docs.select("doc_id", "text"), shards, seed).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
