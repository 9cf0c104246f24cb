"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with the same set of word shingles become one class before anything
is compared.  Classes that share a band of MinHash values are candidates.  For
each pair the values are compared a few at a time, and the pair is dropped as
soon as the posterior probability that its similarity reaches the threshold
falls below a tolerance (BayesLSH); all others are verified exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import batches_of, constants, kept, mixed, written

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND = 32, 4              # a pair at the threshold is missed by all bands once in 10 million
HASHES = BANDS * BAND
STEP = 16                        # MinHash values compared before each look at the posterior
TOLERANCE = 1e-6
SMALL = 32                       # members of a bucket whose pairs are written out
BLOCK = 400_000                  # shingles of one side of a block of comparisons
SLAB = 1 << 20                   # bytes of text hashed at once

_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE, _PLACE = constants(256, 1), constants(1024, 2) | np.uint64(1)
_TURN = constants(WORDS, 3) | np.uint64(1)
_A, _B = ((c >> np.uint64(32)).astype(np.uint32) for c in (constants(HASHES, 4), constants(HASHES, 5)))
_A = _A | np.uint32(1)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: runs of lower-cased characters other than ASCII signs and blanks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + SLAB, len(raw))
        if end < len(raw):
            cuts = np.flatnonzero(_SEPARATOR[raw[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:                                   # a word longer than a slab is taken whole
                rest = np.flatnonzero(_SEPARATOR[raw[end:]])
                end = end + int(rest[0]) if len(rest) else len(raw)
        slab = raw[at:end]
        inside = ~_SEPARATOR[slab]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            place = np.arange(len(slab)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(slab)]])))
            value = _BYTE[slab] * _PLACE[place & 1023] + (place >> 10).astype(np.uint64) * _BYTE[slab]
            value[~inside] = 0
            parts.append(mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct hashed runs of five words, sorted; fewer words are one run, no word none."""
    w = word_hashes(text)
    n = min(len(w), WORDS)
    if not n:
        return w
    runs = sum(w[i:len(w) - n + 1 + i] * _TURN[i] for i in range(n)) + np.uint64(n)
    return np.unique(mixed(runs))


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    two = [np.add.reduce(mixed(s ^ c), dtype=np.uint64) for c in constants(2, 6)]
    return np.array(two, np.uint64).tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    high = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 512):
        out = np.minimum(out, (high[i:i + 512, None] * _A + _B).min(axis=0))
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each look, the fewest equal values with which a pair is not dropped.

    With a uniform prior the similarity after m of n equal values is
    Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def not_pruned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (row i of a, row j of b) of signatures outlast all looks."""
    alive, equal = np.arange(len(i)), np.zeros(len(i), np.int32)
    for look, least in enumerate(least_matches(threshold, tolerance)):
        cut = slice(look * STEP, (look + 1) * STEP)
        for at in range(0, len(alive), 65536):
            part = alive[at:at + 65536]
            equal[part] += (a[i[part], cut] == b[j[part], cut]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= least]
    return alive


def _pruned_pairs(threshold: float, tolerance: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            rows = np.arange(batch.num_rows)
            alive = not_pruned(a, b, rows, rows, threshold, tolerance)
            yield batch.select(["a", "b"]).take(pa.array(alive))
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node it is connected with.

    Every round takes the least root among the neighbours and then the root of
    that root, so long chains halve; each round is checkpointed.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = step.join(roots.select(F.col("node").alias("new"), F.col("root").alias("far")), "new")
        following = kept(jump.select("node", F.least("new", "far").alias("root"), (F.least("new", "far") != F.col("root")).alias("moved")))
        roots = following.drop("moved")
        if following.filter("moved").isEmpty():
            return roots


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits for an id, null ones included, with its text: rows that agree in both are one document."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.coalesce(text, F.lit("")))))


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, size, sig), written: the one pass over all texts. ``node`` is null for a text without words."""
    def run(batches):
        for batch in batches:
            node, size, sig = [], [], []
            for part in batches_of(batch.column("text")):
                for text in part:
                    s = shingles(text)
                    node.append(set_key(s) if len(s) else None)
                    size.append(len(s))
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "key", "node", "size", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").mapInArrow(
        run, "doc_id long, key binary, node binary, size long, sig binary")
    return written(rows, "shingled")


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) whose components hold every pair that may reach the threshold.

    The pairs of a bucket of few members are written out and pruned.  The members
    of a large bucket, whose pairs would grow with its square, are tied to one
    of them; they are compared, and pruned, in blocks later.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * BAND * 4 + 1, BAND * 4)) for i in range(BANDS)])
    bands = classes.select("node", F.explode(keys).alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(bands.join(sizes, "key"), "members")
    small = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    pairs = small.select(F.explode(F.flatten(F.transform("nodes", lambda x, i: F.transform(
        F.slice("nodes", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*").distinct()
    large = members.filter(F.col("n") > SMALL)
    heads = large.groupBy("key").agg(F.min("node").alias("b"))
    stars = large.join(heads, "key").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    sigs = classes.select("node", "sig")
    compared = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(
        sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b").select("a", "b", "sig_a", "sig_b")
    return compared.mapInArrow(_pruned_pairs(threshold, tolerance), "a binary, b binary").unionByName(stars)


def _links(a: list, b: list, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold exactly."""
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    if len(i) <= 2 * (len(a) + len(b)):
        common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    else:
        # many pairs: one matrix product per slice of the shingles that occur more than once
        values, place, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([size_a, size_b]))
        number = np.cumsum(count > 1) - 1
        shared = count[place] > 1
        row, col = row[shared], number[place[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        product = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
            cut = slice(*np.searchsorted(col, [at, at + 2048]))
            m = np.zeros((len(a) + len(b), 2048), np.float32)
            m[row[cut], col[cut] - at] = 1
            product += m[:len(a)] @ m[len(a):].T
        common = np.rint(product[i, j]).astype(np.int64)
    return common / np.maximum(size_a[i] + size_b[j] - common, 1) >= threshold


def _compare(left: list, right: list | None, threshold: float, tolerance: float):
    """All linked pairs (i, j) of two lists of (sets, signatures), or within one."""
    sets_a, sig_a = left
    sets_b, sig_b = right or left
    found_i, found_j = [], []
    first = least_matches(threshold, tolerance)[0]
    for at in range(0, len(sets_a), 512):
        a = sig_a[at:at + 512]
        equal = np.zeros((len(a), len(sig_b)), np.uint8)
        for h in range(STEP):
            equal += a[:, h, None] == sig_b[None, :, h]
        i, j = np.nonzero(equal >= first)
        if right is None:
            i, j = i[j > i + at], j[j > i + at]
        alive = not_pruned(a, sig_b, i, j, threshold, tolerance)
        i, j = i[alive], j[alive]
        linked = _links(sets_a[at:at + 512], sets_b, i, j, threshold)
        found_i.append(i[linked] + at)
        found_j.append(j[linked])
    return np.concatenate(found_i), np.concatenate(found_j)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(threshold: float, tolerance: float):
    """Per block: (node, links to other classes counted in documents, a node of the same local component)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, low, high), part in frame.groupby(["group", "low", "high"], sort=False):
            sets, sigs, rows = [], [], []
            seen: set[bytes] = set()
            for row, (node, text) in enumerate(zip(part["node"], part["text"])):
                node = bytes(node)
                s = shingles(text)
                if node not in seen:
                    seen.add(node)
                    sets.append(s)
                    sigs.append(signature(s))
                    rows.append(row)
            part = part.iloc[rows]
            chunk, copies = part["chunk"].to_numpy(), part["copies"].to_numpy()
            sig = np.array(sigs, np.uint32).reshape(-1, HASHES)
            if low == high:
                i, j = _compare((sets, sig), None, threshold, tolerance) if len(sets) > 1 else (np.zeros(0, int),) * 2
            else:
                a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
                i, j = _compare(([sets[x] for x in a], sig[a]), ([sets[x] for x in b], sig[b]), threshold, tolerance) if len(a) and len(b) else (
                    np.zeros(0, int),) * 2
                i, j = a[i] if len(i) else i, b[j] if len(j) else j
            links = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
            root = _local_roots(len(part), i, j)
            some = np.flatnonzero(links > 0)
            node = part["node"].to_numpy()
            out.append(pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})
    return run


def block_links(docs: DataFrame, classes: DataFrame, grouped: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root) per block of comparisons within the candidate groups (node, root).

    A group of many shingles is cut into chunks and every pair of chunks is a
    block of bounded size; small groups are packed into bins of about that size.
    """
    inside = written(classes.select("node", "key", "copies", "size").join(grouped.withColumnRenamed("root", "group"), "node"), "inside")
    weights = written(inside.groupBy("group").agg(F.sum("size").alias("weight")).select(
        "group", "weight", F.ceil(F.col("weight") / BLOCK).cast("int").alias("chunks")), "weights")
    bins = max(1, math.ceil((weights.agg(F.sum("weight")).first()[0] or 0) / BLOCK))
    placed = inside.join(weights.select("group", "chunks"), "group").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # chunk c belongs to the blocks (0, c) .. (c, c) and (c, c + 1) .. (c, last)
    mates = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "node", "copies", "group", "chunk", F.least("chunk", "mate").alias("low"), F.greatest("chunk", "mate").alias("high"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.lit(-1)).alias("bin"))
    # one text a node; merge joins at every size: the keys grow with the documents, so a broadcast would not last
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").join(
        inside.select("key").hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    rows = texts.join(mates.hint("merge"), "key").withColumn("own", F.when(F.col("bin") < 0, F.col("group")))
    return rows.groupBy("bin", "own", "low", "high").applyInPandas(
        _block_links(threshold, tolerance), "node binary, links long, root binary")


def classified(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, key, root, class_id, n_links) of every row: ``root`` names the class, null for a text without words."""
    rows = shingled(docs)
    classes = written(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.count("*").alias("copies"),
        F.first("size").alias("size"), F.min("sig").alias("sig")), "classes")
    grouped = components(candidate_edges(classes, threshold, tolerance))
    found = written(block_links(docs, classes, grouped, threshold, tolerance), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = classes.select("node", "doc_id", "copies").join(roots, "node").join(links, "node", "left")
    least = tied.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    result = classes.select("node", "doc_id", "copies").join(
        tied.join(least, "root").select("node", "root", "class_id", "links"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = rows.filter(F.col("node").isNull()).select(
        "doc_id", "key", F.col("node").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.filter(F.col("node").isNotNull()).select("doc_id", "key", "node").join(result, "node").select(
        "doc_id", "key", "root", "class_id", "n_links").unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``; ``n_links`` counts the other documents a
    document is linked with, copies included, and ``class_id`` is the least id
    among all it is connected with.  A text of one to four words is one shingle.
    A text that is null, empty or without words has no link and is its own class.
    Rows that repeat an id count as documents of their own, whatever their texts;
    rows with a null id take part as well, and a class of such rows only has a
    null ``class_id``.  Only ``doc_id`` and ``text`` are read.
    """
    return classified(docs, threshold, tolerance).select("doc_id", "class_id", "n_links")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of every class of near duplicates, with all columns of ``docs``: the one of the least id, a null id last.

    Classes are those of texts, so an id with two texts may stay with both, with one
    or with none of them.  Rows that agree in id and text are one document and become
    one row.  Texts that are null, empty or without words all stay.
    """
    rows = classified(docs, threshold, tolerance).filter(F.col("root").isNotNull())
    leaders = written(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("first")).select(
        F.col("first.key").alias("_key")), "leaders")
    worded = F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    keyed = docs.filter(worded).select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.struct(*docs.columns).alias("_row"))
    # the keys grow with the documents: a merge join at every size
    kept_rows = keyed.join(leaders.hint("merge"), "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
    return kept_rows.select("_row.*").unionByName(docs.filter(~worded))


def near_duplicates_sql(documents: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same in SQL: all shingles joined, components by recursion."""
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\\x00-\\x2F:-@\\[-`{{-\\x7F]+') IF x <> ''] AS w
  FROM {documents}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c / (p.n + q.n - c) >= {threshold}),
reached AS (
  SELECT doc_id, doc_id AS other FROM {documents}
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = r.doc_id) AS n_links
FROM reached r GROUP BY doc_id"""
