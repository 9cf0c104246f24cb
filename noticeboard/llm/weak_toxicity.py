"""Toxicity by weak supervision.

Many voters, words and word beginnings of an induced lexicon and fixed
patterns, vote on a document or abstain.  A generative label model estimates,
by expectation maximisation over the votes alone, how often each votes under
either class, and which voters are correlated beyond the class; such a voter's
vote depends on the class and on the voter it follows.  A linear classifier is
then trained on the posterior labels and scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import batches_of, kept, labelled_ids, remainder, texts_of

WORD = re.compile(r"[^\W\d_]+")
HEADS = (4, 5, 6, 7, 8, 9)
# voters written by hand, as patterns over the lower-cased text
PATTERNS = {
    "insult": r"\b(?:idiot|moron|loser|scum|trash|stupid|pathetic|worthless|disgusting|clown)s?\b",
    "you are": r"\byou(?:'re| are)\s+(?:an?\s+|so\s+|such\s+)?(?:idiot|moron|loser|fool|dumb|stupid|pathetic|worthless)",
    "shut up": r"\bshut\s+up\b",
    "hate": r"\bi\s+hate\s+(?:you|them|him|her)\b",
    "threat": r"\b(?:kill|hurt|beat)\s+(?:you|them|him|her|yourself)\b",
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}


def found_terms(text: str) -> set[str]:
    """Distinct words of a text and, marked by ``~``, their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {"~" + w[:n] for w in words for n in HEADS if len(w) >= n}


@dataclass
class ToxicityModel:
    lexicon: dict[str, int] = field(default_factory=dict)   # term -> voter
    voters: int = 0
    weights: np.ndarray | None = None                       # of the voters' features
    bias: float = 0.0
    prior: float = 0.0

    def features(self, text: str) -> list[int]:
        """Voters that fire."""
        low = text.lower()
        words = set(WORD.findall(low))
        lex = self.lexicon
        hits = {lex[w] for w in words & lex.keys()}
        for n in HEADS:
            hits |= {lex[h] for h in {"~" + w[:n] for w in words if len(w) >= n} & lex.keys()}
        base = self.voters - len(_PATTERNS)
        return sorted(hits | {base + i for i, p in enumerate(_PATTERNS.values()) if p.search(low)})

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        s = self.bias + sum(self.weights[i] for i in self.features(text))
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def least_count(terms_by_bad: dict[int, int], share: float) -> tuple[int, int]:
    """The least count at which a term can pass the test of ``induced_lexicon``, and how many terms have it.

    A term's ratio is at most that of one never found in a good document; terms
    that cannot pass even then are not looked at and do not make the test harder.
    """
    k, left = 1, sum(terms_by_bad.values())
    while left and k * -math.log(share) < math.log(max(left, 2)):
        left -= terms_by_bad.get(k, 0)
        k += 1
    return k, left


def induced_lexicon(sample: DataFrame, sizes: dict[int, int]) -> list[str]:
    """All terms that tell the labels apart, best first, counted over the sample by Spark.

    A term must be far more frequent among the bad documents, and so much that
    chance would not do it once among all terms looked at (likelihood ratio).
    Nothing else limits their number or how often one must occur.
    """
    def counted(batches):
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            labels = iter(batch.column("label").to_pylist())
            for part in batches_of(batch.column("text")):
                for t in part:
                    tally[next(labels)].update(found_terms(t))
        for label, c in tally.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c.keys()), pa.string()), pa.array([label] * len(c), pa.int32()),
                 pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])

    tallied = sample.select("label", "text").mapInArrow(counted, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good")).filter("bad > 0")
    by_term = kept(tallied)
    share = sizes[1] / (sizes[0] + sizes[1])
    bad, good = F.col("bad"), F.col("good")
    ratio = 2 * (bad * F.log(bad / ((bad + good) * share)) + F.when(good > 0, good * F.log(
        good / ((bad + good) * (1 - share)))).otherwise(0.0))
    worth = (bad / sizes[1]) / (bad / sizes[1] + good / sizes[0])
    least, looked_at = least_count({r.bad: r["count"] for r in by_term.groupBy("bad").count().collect()}, share)
    best = by_term.filter((bad >= least) & (worth >= 0.99) & (ratio >= 2 * math.log(max(looked_at, 2)))).orderBy(F.desc(ratio), "term")
    return [r.term for r in best.select("term").collect()]


@dataclass
class Votes:
    """Which voter fires on which row, as two lists of equal length ordered by row; nothing is held for a voter that abstains."""
    row: np.ndarray
    voter: np.ndarray
    rows: int
    voters: int

    def per_voter(self, of_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.voter, weights=of_row[self.row], minlength=self.voters)

    def per_row(self, of_vote: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=of_vote, minlength=self.rows)

    def together(self, partner: np.ndarray) -> np.ndarray:
        """For each vote, whether the voter's partner (-1: none) fires on the same row."""
        code = self.row * self.voters + self.voter
        want = self.row * self.voters + partner[self.voter]
        at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
        return (partner[self.voter] >= 0) & (code[at] == want)


def leaders(votes: Votes, near: int = 8) -> np.ndarray:
    """For each voter the more frequent voter it fires with most, or -1.

    Looked for among the ``near`` next more frequent voters of each row, so the
    work grows with the votes, not with the pairs: voters that repeat each other
    are about as frequent as each other.  Ties go to the first voter.
    """
    often = np.bincount(votes.voter, minlength=votes.voters)
    place = np.empty(votes.voters, np.int64)
    place[np.lexsort((np.arange(votes.voters), -often))] = np.arange(votes.voters)
    order = np.lexsort((place[votes.voter], votes.row))
    row, voter = votes.row[order], votes.voter[order]
    pairs = []
    for d in range(1, near + 1):
        same = row[d:] == row[:-d]
        pairs.append(voter[d:][same] * votes.voters + voter[:-d][same])
    codes, counts = np.unique(np.concatenate(pairs), return_counts=True)
    best = np.full(votes.voters, -1)
    order = np.lexsort((-codes, counts))                # the last of a voter's pairs stays: most often, then first
    best[codes[order] // max(votes.voters, 1)] = codes[order] % max(votes.voters, 1)
    return best


def correlation(votes: Votes, partner: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Greatest correlation, of the two classes, of each voter with its partner given the class."""
    both, out = votes.together(partner), np.zeros(votes.voters)
    for share in (q, 1 - q):
        total = max(share.sum(), 1e-9)
        a = votes.per_voter(share) / total
        p = np.where(partner >= 0, a[partner], 0)
        joint = np.bincount(votes.voter, weights=share[votes.row] * both, minlength=votes.voters) / total
        spread = np.sqrt(np.maximum(a * (1 - a) * p * (1 - p), 1e-12))
        out = np.maximum(out, np.where(partner >= 0, np.abs(joint - a * p) / spread, 0))
    return out


def label_model(votes: Votes, prior: float, rounds: int = 40, least: float = 0.1) -> np.ndarray:
    """Posterior probability of class 1 for every row.

    A latent class model by expectation maximisation, started from whether any
    voter fires.  Half of the rounds take the voters as independent given the
    class.  Then each voter that is correlated by at least ``least`` beyond the
    class with a more frequent one depends on that one as well as on the class:
    a forest, whose likelihood is exact.  A voter that repeats another then adds
    nothing.  Memory grows with the votes and the voters.
    """
    fires = votes.per_row(np.ones(len(votes.row)))
    q = np.where(fires > 0, 0.9, 0.1 * prior)
    partner, both = np.full(votes.voters, -1), np.zeros(len(votes.row), bool)
    for turn in range(rounds):
        if turn == rounds // 2:
            found = leaders(votes)
            partner = np.where(correlation(votes, found, q) >= least, found, -1)
            both = votes.together(partner)
        weight = _evidence(votes, partner, both, q)
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        # a voter that abstains says nothing; that all abstain is evidence of its own
        silent = np.clip([((q * (fires == 0)).sum() + 0.01) / (q.sum() + 1),
                          (((1 - q) * (fires == 0)).sum() + 1) / ((1 - q).sum() + 1.02)], 1e-4, 1 - 1e-4)
        logit = np.log(share / (1 - share)) + votes.per_row(weight) + np.where(
            fires == 0, np.log(silent[0] / silent[1]), np.log((1 - silent[0]) / (1 - silent[1])))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def _evidence(votes: Votes, partner: np.ndarray, both: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each vote, given whether the voter's partner fires too; never negative."""
    alone, joint = [], []
    for share in (q, 1 - q):
        fired = votes.per_voter(share)
        with_partner = np.bincount(votes.voter, weights=share[votes.row] * both, minlength=votes.voters)
        led = np.where(partner >= 0, fired[partner], 0)         # weight of the rows where the partner fires
        alone.append((fired - with_partner, share.sum() - led))
        joint.append((with_partner, led))
    rate = [np.clip((n + extra) / (total + 1), 1e-4, 1 - 1e-4) for (n, total), extra in zip(alone, (0.2, 0.02))]
    # beside its partner a voter is taken to fire alike in both classes until the rows say otherwise
    pooled = (joint[0][0] + joint[1][0] + 0.5) / (joint[0][1] + joint[1][1] + 1)
    near = [np.clip((n + pooled) / (total + 1), 1e-4, 1 - 1e-4) for n, total in joint]
    apart, beside = (np.maximum(np.log(a / b), 0) for a, b in (rate, near))
    return np.where(both, beside[votes.voter], apart[votes.voter])


def linear_classifier(votes: Votes, posterior: np.ndarray, steps: int = 20) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on posteriors: Newton steps with a ridge, each solved by conjugate gradients.

    A voter never counts against its class.
    """
    ridge = np.append(np.full(votes.voters, 0.05), 1e-3)
    w = np.zeros(votes.voters + 1)

    def scores(v: np.ndarray) -> np.ndarray:
        return votes.per_row(v[votes.voter]) + v[-1]

    def back(of_row: np.ndarray) -> np.ndarray:
        return np.append(votes.per_voter(of_row), of_row.sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(scores(w), -30, 30)))
        curve = p * (1 - p)
        scale = back(curve) + ridge                             # the diagonal, as preconditioner
        left = back(p - posterior) + ridge * w
        size, move = np.abs(left).max(), np.zeros(len(w))
        z = left / scale
        ahead = z
        for _ in range(200):
            if np.abs(left).max() <= 1e-9 * max(size, 1e-9):
                break
            pulled = back(curve * scores(ahead)) + ridge * ahead
            length = (left @ z) / (ahead @ pulled)
            move, rest = move + length * ahead, left - length * pulled
            fresh = rest / scale
            ahead = fresh + (rest @ fresh) / (left @ z) * ahead
            left, z = rest, fresh
        w = w - move
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, folds: int = 5, held: int = 0,
                 steps: int = 20) -> ToxicityModel:
    """Lexicon, label model and classifier from labelled documents outside the held-out fold.

    The sample is bounded: ``per_class`` ids of each label, first in hash order,
    each with its whole text.  With one label or none the score is that label, or zero.
    """
    ids = labelled_ids(labels, "toxic", F.coalesce(remainder(F.col("doc_id"), folds) != held, F.lit(False)), per_class)
    sample = texts_of(ids, docs)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(prior=float(next(iter(sizes), 0)))
    terms = induced_lexicon(sample, sizes)
    model = ToxicityModel({t: i for i, t in enumerate(terms)}, len(terms) + len(_PATTERNS))

    def fired(batches):
        for batch in batches:
            out = [model.features(t) for part in batches_of(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.int32()))],
                                             names=["doc_id", "label", "fired"])

    rows = sample.mapInArrow(fired, "doc_id long, label int, fired array<int>").orderBy("doc_id").select("fired").toArrow()
    lists = rows.column("fired").combine_chunks()
    sizes_of = np.asarray(pa.compute.list_value_length(lists), np.int64)
    votes = Votes(np.repeat(np.arange(len(lists)), sizes_of), np.asarray(lists.flatten(), np.int64), len(lists), model.voters)
    posterior = label_model(votes, sizes[1] / len(lists))
    model.weights, model.bias = linear_classifier(votes, posterior, steps)
    return model


def toxicity(docs: DataFrame, model: ToxicityModel) -> Column:
    """Score of a document's whole text, 0 to 1; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for part in batches_of(texts) for t in part], pa.float64())

    return F.arrow_udf(run, "double")(F.col("text"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null id is never held out.  Only ``doc_id`` and ``text`` are read; repeated
    rows give repeated results and an empty table none.
    """
    return docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
                       toxicity(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
