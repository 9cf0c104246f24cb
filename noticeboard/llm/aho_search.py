"""Ranked lexical search by scanning documents with an automaton of all items' terms.

The terms of all items, each guarded by a blank on both sides, become one
Aho-Corasick automaton that is broadcast.  Documents are read as they are,
without an index: a first scan counts how many of them hold each term, a second
one counts the terms of each document, turns them into scores of the items they
belong to, and keeps each item's best documents of the task.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticeboard.llm.common import WORD_BYTES, bytes_of, written
from noticeboard.session import scratch_path

BLOCK_TERMS = 200_000      # terms of items that are searched for at once
CELLS = 1 << 20            # scores of documents by items held at once
SALTS = 32
EXACT = 2 ** 53
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows that share an item's id are one item."""
    words = F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return items.select("item_id", F.explode(words).alias("term")).filter("term <> ''").distinct()


def guarded_automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Outputs the number of each term between two blanks; a character stands for one byte of UTF-8."""
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(f" {term.encode('utf-8', 'surrogatepass').decode('latin-1')} ", i)
    out.make_automaton()
    return out


def term_counts(automaton: ahocorasick.Automaton, raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, numbers of the automaton's terms in the text, their occurrences)."""
    line = raw.translate(WORD_BYTES)
    n = len(line.split())
    if not n or not len(automaton):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [i for _, i in automaton.iter(f" {line.decode('latin-1')} ")]
    return n, *np.unique(np.array(found, np.int64), return_counts=True)


def _statistics(docs: DataFrame, shared, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each searched term)."""
    def run(batches):
        automaton = shared.value[0]
        with_terms, all_terms, holding = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in bytes_of(batch.column("text")):
                for raw in part:
                    n, terms, _ = term_counts(automaton, raw)
                    with_terms += n > 0
                    all_terms += n
                    holding[terms] += 1
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([with_terms, all_terms, *holding[some].tolist()], pa.int64())],
                                         names=["term", "n"])

    total = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return total.get(-2, 0), total.get(-1, 0), np.array([total.get(i, 0) for i in range(n_terms)], np.int64)


class Best:
    """The ``k`` best documents of every item so far: highest score, then smallest id, a null id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.parts, self.held = k, np.ones(items), [], 0
        self.most = max(4 * k * items, 1 << 16)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[doc, item], ids[doc], missing[doc]))
        self.held += len(doc)
        if self.held > self.most:
            self.settled()

    def settled(self) -> tuple[np.ndarray, ...]:
        item, score, ids, missing = map(np.concatenate, zip(*self.parts)) if self.parts else (np.zeros(0, int),) * 4
        order = np.lexsort((ids, missing, -score, item))
        item, score, ids, missing = item[order], score[order], ids[order], missing[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        top = place < self.k
        self.parts, self.held = [(item[top], score[top], ids[top], missing[top])], int(top.sum())
        return self.parts[0]


def _search(docs: DataFrame, block: list, item_type, k: int) -> DataFrame:
    """(item_id, doc_id, score): every task's best documents of the items of a block."""
    terms = sorted({r.term for r in block})
    items = sorted({r.item_id for r in block}, key=lambda i: (i is not None, i))
    number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(items)}
    held = np.array(sorted((number[r.term], place[r.item_id]) for r in block), np.int64)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((guarded_automaton(terms),))
    documents, all_terms, holding = _statistics(docs, shared, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    if np.bincount(held[:, 1]).max() * int(weight.max()) * 1_000_000 >= EXACT:
        raise ValueError("scores leave the range of exact integers")
    starts = np.searchsorted(held[:, 0], np.arange(len(terms) + 1))
    tables = sc.broadcast((items, starts, held[:, 1], weight))
    arrow = to_arrow_type(item_type)

    def run(batches):
        (automaton,), (items, starts, of_item, weight) = shared.value, tables.value
        best, rows = Best(len(items), k), max(1, CELLS // len(items))

        def scored(group: list) -> None:
            ids, missing, doc, term, part = [], [], [], [], []
            for i, (doc_id, n, found, times) in enumerate(group):
                ids.append(0 if doc_id is None else doc_id)
                missing.append(doc_id is None)
                length = 50 + 50 * n * documents // all_terms
                doc.append(np.full(len(found), i))
                term.append(found)
                part.append(1_000_000_000 * times // (1000 * times + 20 * length))
            doc, term, part = map(np.concatenate, (doc, term, part))
            scores = np.zeros(len(group) * len(items))
            value = (part * weight[term]).astype(float)
            wide = starts[term + 1] - starts[term]
            # a bounded number of (document, item) entries at a time
            edges = np.searchsorted(np.cumsum(wide), np.arange(0, wide.sum() + CELLS, CELLS))
            for a, b in zip(edges, [*edges[1:], len(wide)]):
                w = wide[a:b]
                if w.sum():
                    at = np.arange(w.sum()) + np.repeat(starts[term[a:b]] - np.cumsum(w) + w, w)
                    scores += np.bincount(np.repeat(doc[a:b], w) * len(items) + of_item[at], np.repeat(value[a:b], w), len(scores))
            best.add(scores.reshape(len(group), len(items)), np.array(ids, np.int64), np.array(missing, bool))

        group = []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = 0
            for part in bytes_of(batch.column("text")):
                for raw in part:
                    n, found, times = term_counts(automaton, raw)
                    if len(found):
                        group.append((ids[at], n, found, times))
                    at += 1
                    if len(group) >= rows:
                        scored(group)
                        group = []
        if group:
            scored(group)
        item, score, doc, missing = best.settled()
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[i] for i in item], arrow), pa.array(doc.astype(np.int64), pa.int64(), mask=missing.astype(bool)), pa.array(score.astype(np.int64), pa.int64())],
            names=["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"item_id {item_type.simpleString()}, doc_id long, score long")


def lexical_top(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``k`` documents of highest positive score.

    Equal scores go to the smaller id, a null id last.  Texts that are null,
    empty or without terms match nothing and do not count as documents; an item
    without terms has no row.  Rows that repeat a document's id are documents of
    their own, rows that share an item's id, a null one included, one item.
    Empty tables give no row.  Of ``docs`` only ``doc_id`` and ``text`` are read,
    of ``items`` ``item_id`` and ``text``.

    Items are dealt into blocks of about ``block_terms`` terms, one automaton
    each; a block's items are searched for in all documents, and its result is written.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items), "item-terms")
    item_type = wanted.schema["item_id"].dataType
    blocks = math.ceil(wanted.count() / block_terms)
    paths = []
    for i in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        if block:
            paths.append(scratch_path(spark, f"best-{i}"))
            _search(docs, block, item_type, k).write.parquet(paths[-1])
    schema = f"item_id {item_type.simpleString()}, doc_id long, score long"
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    # tasks' lists meet in a few places an item before they meet in one
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("_n", some).filter(F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_sql(documents: str = "documents", items: str = "benchmark", k: int = 50) -> str:
    """The same ranking in SQL, from the joined terms."""
    terms = f"""unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"""
    return f"""
WITH term AS (SELECT doc_id, {terms} AS t FROM {documents}),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t),
length AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM length),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY t, docs),
item AS (SELECT DISTINCT item_id, {terms} AS t FROM {items}),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN length USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= {k}"""
