"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Terms are n-grams of character shapes, repetitions of words and lines, and
lengths; documents become TF-IDF vectors, projected by a truncated singular
value decomposition.  The labelled vectors are broadcast; exact cosines of
every document with all of them are computed in blocks, and the labels of the
nearest are weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import batches_of, codes, hashed_ngrams, labelled_ids, remainder, texts_of

DIMS = 2048           # hashed shape terms
BINS = 64             # terms for repetition, line and length figures
SIZES = (1, 2, 3, 4)
_SHAPE = np.arange(128, dtype=np.uint32)
_SHAPE[[c for c in range(128) if chr(c).isupper()]] = ord("A")
_SHAPE[[c for c in range(128) if chr(c).islower()]] = ord("a")
_SHAPE[[c for c in range(128) if chr(c).isdigit()]] = ord("0")


def _shares(text: str) -> np.ndarray:
    """Figures that n-grams miss, each as a soft bin: repeated words and lines, capitals, length."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    letters = max(len(text), 1)
    upper = len(text) - len(text.translate(_NO_UPPER))
    figures = [
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(words)) / n if n > 20 else 0.0,
        1 - len(set(lines)) / m,
        upper / letters,
        min(len(words), 4000) / 4000,
        np.log1p(len(words)) / 12,
        np.log1p(len(text) / n) / 6,
        np.log1p(m) / 10,
    ]
    out = np.zeros(BINS)
    per = BINS // len(figures)
    for i, f in enumerate(figures):
        place = min(max(f, 0.0), 1.0) * (per - 1)
        low = int(place)
        out[i * per + low] += 1 - (place - low)
        if low + 1 < per:
            out[i * per + low + 1] += place - low
    return out


_NO_UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


def terms(text: str) -> np.ndarray:
    """Square roots of relative term frequencies: shapes first, figures after."""
    s = codes(text)
    shape = np.where(s < 128, _SHAPE[np.minimum(s, 127)], ord("a"))
    grams = hashed_ngrams(shape, SIZES, DIMS)
    return np.concatenate([np.sqrt(grams / max(grams.sum(), 1)), np.sqrt(_shares(text) / 32)])


@dataclass
class QualityModel:
    idf: np.ndarray | None
    axes: np.ndarray | None      # dims x latent
    vectors: np.ndarray | None   # labelled x latent, length one
    labels: np.ndarray | None
    neighbours: int
    prior: float

    def project(self, found: np.ndarray) -> np.ndarray:
        v = (found * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        v = self.project(np.stack([terms(t) for t in texts]))
        cosine = v @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 + 1e-9
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, latent: int = 48, neighbours: int = 15,
                folds: int = 3, held: int = 1) -> QualityModel:
    """Latent vectors of labelled documents outside the held-out fold.

    The sample is bounded: ``per_class`` ids of each label, first in hash order,
    each with its whole text, so 2 x ``per_class`` vectors are broadcast (about
    1 MB).  Document frequencies and axes are part of the fitted model.  With one
    label or none the score is that label, or one half.
    """
    ids = labelled_ids(labels, "quality", remainder(F.col("doc_id"), folds) != held, per_class)
    sample = texts_of(ids, docs)

    def vectors(batches):
        for batch in batches:
            out = [terms(t).astype(np.float32).tobytes() for part in batches_of(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())],
                                             names=["doc_id", "label", "terms"])

    rows = sample.mapInArrow(vectors, "doc_id long, label int, terms binary").orderBy("doc_id").toArrow()
    label = np.array(rows.column("label").to_pylist(), float)
    if len(set(label)) < 2:
        return QualityModel(None, None, None, None, 0, float(label[0]) if len(label) else 0.5)
    x = np.stack([np.frombuffer(t.as_py(), np.float32) for t in rows.column("terms")]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x *= idf
    # randomised range finder with two power steps, then a small exact decomposition
    k = min(latent, min(x.shape) - 1) or 1
    q = np.linalg.qr(x @ np.random.default_rng(11).normal(size=(x.shape[1], k + 8)))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T
    model = QualityModel(idf, axes, None, label, neighbours, 0.5)
    model.vectors = model.project(x / idf)
    return model


def quality_scores(docs: DataFrame, model: QualityModel, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text.

    A null text counts as empty; empty texts are scored like any other.  A null
    id is never held out.  Only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(part) for part in batches_of(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    score = F.arrow_udf(run, "double")(F.col("text"))
    return docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
                       score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
