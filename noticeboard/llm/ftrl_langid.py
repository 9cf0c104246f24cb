"""Language identification by sparse multinomial logistic regression.

Character n-grams, hashed and weighted by TF-IDF; trained by
follow-the-regularised-leader (proximal) with an elastic-net penalty, then
calibrated by one temperature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import batches_of, codes, hashed_ngrams, kept, remainder, smallest_per_key

DIMS = 8192
SIZES = (1, 2, 3)
UNDETERMINED = "und"
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the lower-cased text; signs and digits count as blanks."""
    s = codes(text.lower())
    return hashed_ngrams(np.where(s < 128, _ASCII[np.minimum(s, 127)], s), SIZES, DIMS)


def weighted(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, rows scaled to length one."""
    x = np.log1p(counted) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Ftrl:
    """Multinomial FTRL-proximal with per-coordinate rates and elastic net."""

    def __init__(self, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros((classes, dims)), np.zeros((classes, dims))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = w @ values
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = p[:, None] * values
        old = self.n[:, at]
        new = old + g * g
        self.z[:, at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[:, at] = new


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray     # classes x dims, mostly zero
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and probability; ``und`` with 0 for texts without a letter."""
        letters = [any(c.isalpha() for c in t) for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        scores = np.stack([weighted(counts(t), self.idf) @ self.weights.T if ok else np.zeros(len(self.languages))
                           for t, ok in zip(texts, letters)]) / self.temperature
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return ([self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)],
                [float(q[b]) if ok else 0.0 for q, b, ok in zip(p, best, letters)])


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm; few rows move it little from 1."""
    def loss(u: float) -> float:
        s = scores / math.exp(u)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean() + u * u / (2 * len(s)))

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit_languages(docs: DataFrame, per_language: int = 600, rows: int = 38_400, least: int = 20, folds: int = 5,
                  epochs: int = 3) -> LanguageModel:
    """Train on documents with a language whose id is not in the fold held out.

    Every value of ``lang`` among them is learned.  The sample is bounded by rows:
    of each language the ``per_language`` documents first in hash order, fewer
    where all languages together would exceed ``rows``, but not fewer than
    ``least``; the whole text of each.  Model and training grow with the number of
    languages.  Document frequencies are part of the fitted model.  Every fifth
    sample row of a language calibrates the temperature, so a language of fewer
    than five is trained on whole; the temperature is 1 only where no language
    has five or there is but one.  Without a usable row every text is ``und``.
    """
    usable = docs.select("doc_id", "lang", "text").filter(
        (remainder(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a repeated id counts once in its language, or its repeats would crowd out the others
    pairs = kept(usable.select("doc_id", "lang").distinct())
    languages = pairs.select("lang").distinct().count()
    each = max(least, min(per_language, rows // max(languages, 1)))
    ids = smallest_per_key(pairs, "lang", F.xxhash64("doc_id"), each)
    # at most max(rows, languages x least) ids are broadcast
    one = Window.partitionBy("doc_id", "lang").orderBy("text")
    found = usable.join(F.broadcast(kept(ids)), ["doc_id", "lang"])
    sample = kept(found.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("doc_id", "lang", "text"))

    def sparse(batches):
        for batch in batches:
            at, values = [], []
            for texts in batches_of(batch.column("text")):
                for t in texts:
                    c = counts(t)
                    nz = np.flatnonzero(c)
                    at.append(nz.astype(np.int32).tobytes())
                    values.append(c[nz].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
                names=["doc_id", "lang", "at", "values"])

    drawn = sample.mapInArrow(sparse, "doc_id long, lang string, at binary, values binary").orderBy(
        F.xxhash64("doc_id"), "doc_id", "lang").toArrow().to_pylist()
    names = sorted({r["lang"] for r in drawn})
    if not drawn:
        return LanguageModel([], np.zeros(DIMS), np.zeros((0, DIMS)), 1.0)
    at = [np.frombuffer(r["at"], np.int32) for r in drawn]
    df = sum(np.bincount(a, minlength=DIMS) for a in at)
    idf = np.log((1 + len(drawn)) / (1 + df)) + 1
    values = []
    for a, r in zip(at, drawn):
        x = np.log1p(np.frombuffer(r["values"], np.float32).astype(float)) * idf[a]
        values.append(x / max(np.linalg.norm(x), 1e-12))
    number = {name: i for i, name in enumerate(names)}
    label = np.array([number[r["lang"]] for r in drawn])
    held = np.zeros(len(drawn), bool)
    for i in range(len(names)):
        held[np.flatnonzero(label == i)[4::5]] = True
    model = Ftrl(len(names), DIMS)
    for _ in range(epochs):
        for i in np.flatnonzero(~held):
            model.learn(at[i], values[i], int(label[i]))
    w = model.weights()
    temperature = 1.0
    if held.any() and len(names) > 1:
        temperature = _temperature(np.stack([w[:, at[i]] @ values[i] for i in np.flatnonzero(held)]), label[held])
    return LanguageModel(names, idf, w, temperature)


def languages_of(docs: DataFrame, model: LanguageModel, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document's whole text.

    A text that is null, empty or without a letter is ``und`` with score 0.  A
    null id is never held out and never trained on.  Ties go to the language
    first in order of name.  Only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in batches_of(texts):
            a, b = shared.value.predict(part)
            names += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    predicted = F.arrow_udf(run, "lang_pred string, score double")
    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predicted(F.col("text")).alias("_p")).select(
        "doc_id", "held_out", "_p.*")
