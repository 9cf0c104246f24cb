"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeboard.session import scratch_path, shared_dir

SLICE = 256  # texts turned into Python strings at once
_SHARES = 1_000_003
# ASCII letters in lower case, digits and all bytes of other characters; anything else is a blank
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a table in the shared folder: computed once, of known size, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    by = options.pop("partitionBy", [])
    df.write.options(**options).parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's text modulo ``k``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def labelled_ids(labels: DataFrame, column: str, usable: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each label 0 and 1, in hash order: (doc_id, label).

    An id labelled both ways counts as 1.  The limit per label is applied
    before the shuffle as well, so a frequent label is no burden.
    """
    one = (labels.filter(F.col(column).isin(0, 1) & F.coalesce(usable, F.lit(False)))
           .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))
    return smallest_per_key(one, "label", F.xxhash64("doc_id"), per_class)


def smallest_per_key(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """At most ``n`` rows of each of a few keys, in order of the hash ``order``.

    About twice as many as wanted are let through by the hash itself before they
    are ranked, so what meets in one task does not grow with the table.
    """
    shares = df.groupBy(key).agg((F.lit(2.0 * n * _SHARES) / F.count("*")).alias("_share"))
    some = df.join(F.broadcast(shares), key).filter(F.pmod(order, F.lit(_SHARES)) < F.col("_share"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.pmod(order, F.lit(_SHARES)), order, "doc_id"))
    return some.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place", "_share")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of a bounded list of ids, one row per id, kept: (doc_id, label, text).

    ``ids`` holds no more rows than the caller's sample bound, so it is
    broadcast.  Of rows that repeat an id the smallest text counts; a null text is empty.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return kept(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def text_udf(start: Callable[[], Callable[[str], tuple]], returns: pa.StructType | pa.DataType, schema: str):
    """An Arrow UDF over one text column that calls a per-text function.

    ``start`` runs once per batch on the executor and returns the function.
    Texts are taken from Arrow a slice at a time; a null text is empty.
    """
    def run(texts: pa.Array) -> pa.Array:
        fn, out = start(), []
        for i in range(0, len(texts), SLICE):
            out += [fn(t or "") for t in texts.slice(i, SLICE).to_pylist()]
        if pa.types.is_struct(returns):
            names = [f.name for f in returns]
            return pa.array([dict(zip(names, row)) for row in out], returns)
        return pa.array(out, returns)

    return F.arrow_udf(run, schema)


def batches_of(texts: pa.Array) -> Iterator[list[str]]:
    for i in range(0, len(texts), SLICE):
        yield [t or "" for t in texts.slice(i, SLICE).to_pylist()]


def bytes_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of a few texts at a time; a null text has none."""
    for i in range(0, len(texts), SLICE):
        yield [t or b"" for t in texts.slice(i, SLICE).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (the finaliser of splitmix64), elementwise."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x10001)) * np.uint64(0x9E3779B97F4A7C15))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed_ngrams(symbols: np.ndarray, sizes: Sequence[int], dims: int, seed: int = 1) -> np.ndarray:
    """Counts of the hashed n-grams of a symbol sequence, as floats; dims is a power of two."""
    shift = np.uint32(32 - (dims.bit_length() - 1))
    odd = (constants(8, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    s, total = symbols.astype(np.uint32), np.zeros(dims, np.int64)
    for n in sizes:
        if len(s) < n:
            continue
        h = np.full(len(s) - n + 1, n, np.uint32)
        for i in range(n):
            h += s[i:len(s) - n + 1 + i] * odd[i]
            h ^= h >> np.uint32(15)
        total += np.bincount((h * odd[7]) >> shift, minlength=dims)
    return total.astype(np.float64)
