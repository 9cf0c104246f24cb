"""Importance resampling towards a target by overlapped regex scans.

A text is reduced to its words with single blanks between them.  One regular
expression per length, guarded by lookarounds at both ends and scanned with
overlaps, emits every run of that many words as a span of the line; its CRC
says which bucket of counts it falls into.  Buckets that the target fills more
than the corpus does lend weight to a document, and documents are drawn without
replacement by their weight plus Gumbel noise: the highest scores are the draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import SLICE, WORD_BYTES, bytes_of, kept, written

SIZES = (1, 2)
BUCKETS = 10_000
PLACES = 33          # bits of a row's place within its partition in monotonically_increasing_id


def bucket_scanner(sizes: Sequence[int] = SIZES, buckets: int = BUCKETS) -> Callable[[bytes], tuple[int, np.ndarray]]:
    """A function from a text's bytes to (number of words, bucket of every run of words)."""
    patterns = [(n, regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))) for n in sizes]

    def scan(raw: bytes) -> tuple[int, np.ndarray]:
        words = raw.translate(WORD_BYTES).split()
        line = b" ".join(words)
        # single words cannot overlap
        sums = np.fromiter((crc32(m[0]) for n, p in patterns for m in p.finditer(line, overlapped=n > 1)), np.uint32)
        return len(words), sums % np.uint32(buckets)

    return scan


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def scanned(docs: DataFrame, sizes: Sequence[int] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets), written: the one scan of all texts; the buckets as packed numbers."""
    kind = _kind(buckets)

    def run(batches):
        scan = bucket_scanner(sizes, buckets)
        for batch in batches:
            for part in _slices(batch):    # the buckets of a few texts at a time are held and handed over
                found = [(n, b.astype(kind).tobytes()) for raws in bytes_of(part.column("text")) for n, b in map(scan, raws)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())],
                    names=["doc_id", "n_words", "buckets"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, buckets binary"), "scanned")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; every task sums its own first."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in bytes_of(batch.column("buckets")):
                total += np.bincount(np.frombuffer(b"".join(part), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's thousandfold log ratio of smoothed shares, rounded down."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a document's features, rounded down; 0 without features."""
    kind = _kind(len(gain))
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            n, weight = [], []
            for part in bytes_of(batch.column("buckets")):
                for raw in part:
                    b = np.frombuffer(raw, kind)
                    n.append(len(b))
                    weight.append(int(gain[b].sum()) // len(b) if len(b) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise from the hash of seed and id, rounded down; a null id counts as an empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3 .. in the given order, whatever their number: ranges of the order
    are sorted apart, and a range's first rank follows from the sizes of the ranges before it."""
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", PLACES)
    start, starts = 0, []
    for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():   # one row a partition
        starts.append((r.part, start))
        start += r.n
    first = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return sorted_.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(
        "rank", F.col("_start") + F.col("_at").bitwiseAND((1 << PLACES) - 1) + 1).drop("_part", "_start", "_at")


def importance_ranks(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20,
                     sizes: Sequence[int] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document.

    ``rank`` numbers the drawn ones: of the documents with ``least_words`` words
    or more the ``share`` hundredths with the highest scores, equal scores by
    ascending id, a null id first; it is null for all others.  A null, empty or
    wordless text has no feature and weight 0.  Rows that repeat an id are
    documents of their own; equal ones are drawn in any order, since nothing
    tells them apart.  An empty target gives all weights from the corpus alone,
    an empty table no row.  Only ``doc_id`` and ``text`` are read, of the target only ``text``.
    """
    rows = scanned(docs, sizes, buckets)
    wanted = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), sizes, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = written(weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = share * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed(able.select(*columns), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(others)


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn; rows that share an id go together, a null id is never taken."""
    ids = kept(ranks.filter("rank is not null").select("doc_id").distinct())
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def importance_sql(documents: str = "documents", target: str = "benchmark", share: int = 25, seed: int = 7,
                   least_words: int = 20, buckets: int = BUCKETS) -> str:
    """The same in SQL, for runs of one and two words; the checksum is computed byte by byte."""
    words = """[x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"""
    return f"""
WITH worded AS (
  SELECT 's' AS side, doc_id, row_number() OVER () AS row, coalesce({words}, []) AS w FROM {documents}
  UNION ALL
  SELECT 't', NULL, row_number() OVER (), coalesce({words}, []) FROM {target}),
runs AS (SELECT side, row, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM worded),
remainders AS (
  SELECT list(list_reduce([0,0,0,0,0,0,0,0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS t
  FROM range(256) r(n)),
spelled AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM runs)),
summed AS (
  SELECT f, xor(list_reduce(
      [(strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 FOR i IN range(len(h) // 2)],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {buckets} AS bucket
  FROM spelled, remainders),
counted AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM runs JOIN summed USING (f) GROUP BY bucket),
gained AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets})::DOUBLE))) AS BIGINT) AS gain FROM counted),
weighed AS (
  SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM runs JOIN summed USING (f) JOIN gained USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (row) WHERE side = 's'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= {least_words}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= {least_words} AND place <= {share} * able // 100 THEN place END AS rank FROM ranked"""
