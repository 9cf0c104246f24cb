"""Secret scans: base patterns and a character convolutional network in numpy.

The patterns give the base spans.  Every other run of eight or more credential
characters is a candidate; a small convolutional network reads it with its
surroundings and adds it where its calibrated probability reaches a threshold
that keeps a wanted recall on findings held back from training.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import batches_of, codes

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
ADDED = "network"       # kind of the spans the network adds
SHORTEST = 8            # characters of a candidate, as many as a base finding's value has
BEFORE, BODY, AFTER = 20, 40, 8
WIDTH = BEFORE + BODY + AFTER
STEP = BODY // 2        # between the windows of a long candidate
AT_ONCE = 512           # windows read by the network at once
BRIEF = 12              # longest candidate whose window is read without most of its blanks
FINDING, OTHER, WORD = 1, 0, -1     # labels: OTHER has digits or capitals inside, WORD none
FINDINGS, OTHERS = 64, 256          # windows of a training step
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHARACTERS = 20_000_000             # a smaller table is read several times in training
ALONE = 4_000_000                   # characters of a table that one task trains on
FINE, FAR = 256, 64                 # outputs are counted in steps of 1 / FINE between -FAR and FAR
_CREDENTIAL = np.array([c < 128 and (chr(c).isalnum() or chr(c) in "+/_.=-") for c in range(129)])
_CAPITAL, _DIGIT, _LETTER = (np.array([c < 128 and f(chr(c)) for c in range(129)]) for f in (str.isupper, str.isdigit, str.isalnum))


def named(text: str) -> bool:
    """Whether a name that an assignment begins with is in the text, in any case."""
    low = text.lower()
    return any(n in low for n in NAMES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in order."""
    found = []
    if named(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the base findings hide: the value of an assignment, the whole of other kinds."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST] if named(text) else []
    found += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    return sorted({*found, *(m.span() for m in HEX.finditer(text))})


def classes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, anything else one class."""
    return np.minimum(codes(text), 128).astype(np.uint8)


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of credential characters, of at least SHORTEST characters."""
    edges = np.flatnonzero(np.diff(_CREDENTIAL[raw].astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    fits = ends - starts >= SHORTEST
    return starts[fits], ends[fits]


def candidates(text: str) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in runs(classes(text)))))


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its surroundings, in pieces of BODY characters that cover it whole."""
    out = []
    for at in range(start, max(end - STEP, start + 1), STEP):
        stop = min(at + BODY, end)
        out.append(text[max(0, at - BEFORE):at].rjust(BEFORE, "\0") + text[at:stop].ljust(BODY, "\0")
                   + text[stop:stop + AFTER].ljust(AFTER, "\0"))
    return out


def window_rows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The same windows of many candidates: (candidate, character classes) a few at a time.

    ``raw`` holds several texts; a candidate's text is the part from low to high.
    """
    many = np.maximum(1, -(-(ends - STEP - starts) // STEP))
    of = np.repeat(np.arange(len(starts)), many)
    at = starts[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    stop = np.minimum(at + BODY, ends[of])
    rel = np.arange(WIDTH)
    for i in range(0, len(of), AT_ONCE):
        o, a, e = (x[i:i + AT_ONCE] for x in (of, at, stop))
        pos = np.where(rel < BEFORE + BODY, a[:, None] + rel - BEFORE, e[:, None] + rel - BEFORE - BODY)
        first = np.where(rel < BEFORE, low[o][:, None], 0)
        last = np.where((rel >= BEFORE) & (rel < BEFORE + BODY), e[:, None], high[o][:, None])
        yield o, np.where((pos >= first) & (pos < last), raw[np.clip(pos, 0, len(raw) - 1)], 0)


@dataclass
class Candidates:
    """Spans of many texts laid one after the other: text number ``own`` is the part of ``raw`` from ``edge[own]`` to before ``edge[own + 1] - 1``."""
    raw: np.ndarray
    edge: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    own: np.ndarray

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return window_rows(self.raw, self.starts, self.ends, self.edge[self.own], self.edge[self.own + 1] - 1)


def free_candidates(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Candidates:
    """The candidates that no base finding of their text overlaps."""
    # one array for all texts, a character that ends every run between them
    raw = np.concatenate([c for t in texts for c in (classes(t), np.zeros(1, np.uint8))]) if texts else np.zeros(0, np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    starts, ends = runs(raw)
    spans = np.array([(edge[i] + s, edge[i] + e) for i, found in enumerate(base) for s, _, e in found], np.int64).reshape(-1, 2)
    if len(spans):
        change = np.bincount(spans[:, 0], minlength=len(raw) + 1) - np.bincount(spans[:, 1], minlength=len(raw) + 1)
        hidden = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
        free = hidden[ends] == hidden[starts]
        starts, ends = starts[free], ends[free]
    return Candidates(raw, edge, starts, ends, np.searchsorted(edge, starts, side="right") - 1)


def labelled_candidates(texts: list[str]) -> tuple[Candidates, np.ndarray]:
    """Every value that the base patterns find and every other candidate, with their labels."""
    c = free_candidates(texts, [base_spans(t) for t in texts])
    # digits, and capitals inside a word
    odd = _DIGIT[c.raw]
    odd[1:] |= _CAPITAL[c.raw[1:]] & _LETTER[c.raw[:-1]]
    odd = np.concatenate([[0], np.cumsum(odd)])
    many = odd[c.ends] - odd[c.starts]
    found = np.array([(c.edge[i] + s, c.edge[i] + e, i) for i, t in enumerate(texts) for s, e in values(t)], np.int64).reshape(-1, 3)
    both = Candidates(c.raw, c.edge, *(np.concatenate(x) for x in zip(found.T, (c.starts, c.ends, c.own))))
    return both, np.concatenate([np.full(len(found), FINDING), np.where(many > 0, OTHER, WORD)])


def _encoded(pieces: list[str]) -> np.ndarray:
    return classes("".join(pieces)).reshape(len(pieces), WIDTH).astype(np.int64)


class Network:
    """Embedding, one convolution, maximum over positions, one output."""

    def __init__(self, seed: int = 7, embed: int = 8, filters: int = 24, width: int = 5):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": r.normal(0, 0.5, (129, embed)), "w": r.normal(0, (2 / (embed * width)) ** 0.5, (embed * width, filters)),
                  "b": np.zeros(filters), "o": r.normal(0, 0.2, filters), "c": np.zeros(1)}

    def tables(self) -> np.ndarray:
        """What each character adds to the filters at each place of the convolution."""
        e, w = self.p["e"], self.p["w"]
        return np.stack([e @ w[i * e.shape[1]:(i + 1) * e.shape[1]] for i in range(self.width)]).astype(np.float32)

    def _sums(self, x: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The convolution without its constant: windows, places, filters."""
        steps = x.shape[1] - self.width + 1
        z = tables[0].take(x[:, :steps], axis=0)
        for i in range(1, self.width):
            z += tables[i].take(x[:, i:i + steps], axis=0)
        return z

    def forward(self, x: np.ndarray):
        tables = self.tables()
        z = self._sums(x, tables)
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + self.p["b"]
        return tables, best, top, np.maximum(top, 0) @ self.p["o"] + self.p["c"]

    def logits(self, x: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        """Outputs for windows given as character classes, the convolution read from ``tables``."""
        tables = self.tables() if tables is None else tables
        out = np.empty(len(x))
        for at, part in cropped(x, np.zeros(len(x), bool)):
            out[at] = np.maximum(self._sums(part, tables).max(axis=1) + self.p["b"], 0) @ self.p["o"] + self.p["c"]
        return out

    def gradient(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss.  What a character adds at a place is e @ w, so the sums per character and place give both."""
        _, best, top, logit = self.forward(x)
        d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)
        dz = (d[:, None] * self.p["o"]) * (top > 0)                            # n, filters
        e, w, (n, filters), size = self.p["e"], self.p["w"], dz.shape, self.p["e"].shape[1]
        back = np.zeros((self.width, len(e), filters))
        rows, column = np.arange(n)[:, None], np.arange(filters)
        for i in range(self.width):
            cell = x[rows, best + i].astype(np.int64) * filters + column
            back[i] = np.bincount(cell.ravel(), dz.ravel(), back[i].size).reshape(len(e), filters)
        return {"o": np.maximum(top, 0).T @ d, "c": np.array([d.sum()]), "b": dz.sum(axis=0),
                "w": np.concatenate([e.T @ b for b in back]), "e": sum(b @ w[i * size:(i + 1) * size].T for i, b in enumerate(back))}


def cropped(x: np.ndarray, blank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their windows) without blanks that add nothing to the maximum: as many stay as the convolution is wide.

    ``blank`` tells the rows without surroundings.
    """
    brief = x[:, BEFORE + BRIEF] == 0
    for rows, columns in ((~brief & ~blank, np.r_[:WIDTH]), (brief & ~blank, np.r_[:BEFORE + BRIEF + 5, WIDTH - AFTER:WIDTH]),
                          (~brief & blank, np.r_[BEFORE - 5:BEFORE + BODY + 5]), (brief & blank, np.r_[BEFORE - 5:BEFORE + BRIEF + 5])):
        at = np.flatnonzero(rows)
        if len(at):
            yield at, x[at[:, None], columns]


class Training:
    """Adam on the log loss; half of the time the surroundings are blanked or the end is cut, so what the candidate is made of counts.

    Findings, other candidates and words have fixed shares of the loss, whatever their numbers.
    """

    def __init__(self, network: Network, seed: int = 7):
        self.network, self.random, self.t = network, np.random.default_rng(seed), 0.0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.known = np.zeros((0, WIDTH), np.uint8)         # windows of the findings so far

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.network.p, self.m, self.v) for x in d.values()] + [[self.t]])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for d in (self.network.p, self.m, self.v):
            for k, x in d.items():
                d[k] = state[at:at + x.size].reshape(x.shape).copy()
                at += x.size
        self.t = float(state[at])

    def step(self, x: np.ndarray, labels: np.ndarray, rate: float) -> None:
        r, x = self.random, x.copy()
        share = {FINDING: 0.5, OTHER: 0.25, WORD: 0.25} if (labels == OTHER).any() and (labels == WORD).any() else {
            FINDING: 0.5, OTHER: 0.5, WORD: 0.5}
        weight = np.zeros(len(x))
        for label, part in share.items():
            weight[labels == label] = part / max((labels == label).sum(), 1)
        blank = r.random(len(x)) < 0.5
        x[blank, :BEFORE] = 0
        x[blank, BEFORE + BODY:] = 0
        # shorter ends, so that the length alone tells nothing
        ends = np.where(r.random(len(x)) < 0.5, r.integers(SHORTEST, BODY + 1, len(x)), BODY)
        x[:, BEFORE:BEFORE + BODY][np.arange(BODY) >= ends[:, None]] = 0
        total = {k: np.zeros_like(v) for k, v in self.network.p.items()}
        for at, part in cropped(x, blank):
            for k, g in self.network.gradient(part, (labels[at] == FINDING).astype(float), weight[at]).items():
                total[k] += g
        self.t += 1
        for k, g in total.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g ** 2
            self.network.p[k] -= rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)

    def read(self, x: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """Steps over all windows given, each once; the findings of a step are filled up from those read before."""
        r = self.random
        found, other = (r.permutation(np.flatnonzero(y)) for y in (labels == FINDING, labels != FINDING))
        steps = max(-(-len(found) // FINDINGS), -(-len(other) // OTHERS))
        self.known = np.concatenate([self.known, x[found]])
        for a, b in zip(np.array_split(found, steps) if steps else [], np.array_split(other, steps) if steps else []):
            more = self.known[r.integers(0, len(self.known), max(0, FINDINGS - len(a)))] if len(self.known) else self.known
            self.step(np.concatenate([x[a], more, x[b]]), np.concatenate([np.full(len(a) + len(more), FINDING), labels[b]]), rate)


def best_outputs(network: Network, c: Candidates) -> np.ndarray:
    """The largest output over each candidate's windows."""
    tables, best = network.tables(), np.full(len(c.starts), -np.inf)
    for of, x in c.windows():
        np.maximum.at(best, of, network.logits(x, tables))
    return best


@dataclass
class Scanner:
    """A trained network with its calibration; ``network`` None: nothing to learn from, base spans only."""
    network: Network | None = None
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0
    read: tuple[int, ...] = (0, 0, 0, 0)    # findings and other candidates it was trained on, and the same held back

    def _probability(self, c: Candidates) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best_outputs(self.network, c) + self.offset, -30, 30)))

    def probability(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        return self._probability(Candidates(classes(text), np.array([0, len(text) + 1]), starts, ends, np.zeros_like(starts)))

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """All spans (start, kind number, end) of each text; the network's have kind 3 and never touch a base one."""
        out = [base_spans(t) for t in texts]
        if not self.network:
            return out
        c = free_candidates(texts, out)
        found = self._probability(c) >= self.threshold
        for t, s, e in zip(c.own[found], c.starts[found], c.ends[found]):
            out[t].append((int(s - c.edge[t]), 3, int(e - c.edge[t])))
        return [sorted(x) for x in out]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return self.spans_of([text])[0]


def _platt(logit: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back outputs, each seen ``n`` times, by damped Newton steps."""
    yes, no = n[labels == 1].sum(), n[labels == 0].sum()
    target = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, w, start = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float((n * (np.logaddexp(0, s) - target * s)).sum() + 0.5e-3 * ((v - start) ** 2).sum())

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (p - target)) + 1e-3 * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(max(w[0], 1e-3)), float(w[1])


def _train(docs: DataFrame, state: np.ndarray, seed: int, rate: float, epochs: int, alone: bool) -> tuple[np.ndarray, int, int]:
    """The state after every task has trained from ``state`` on all candidates of its rows, and the findings and others read.

    The tasks' states are averaged by the windows they read.  Sums of whole numbers do not depend on the order of the tasks.
    """
    def run(batches):
        training = Training(Network(), seed + 1000 * TaskContext.get().partitionId())
        training.restore(state)
        windows, counts, stored = 0, np.zeros(2, np.int64), []
        for part in (p for batch in batches for p in batches_of(batch.column("text"))):
            c, labels = labelled_candidates(part)
            counts += [(labels == FINDING).sum(), (labels != FINDING).sum()]
            for of, x in _gathered(c.windows()):
                windows += len(x)
                if epochs > 1:
                    stored.append((x, labels[of]))
                else:
                    training.read(x, labels[of], rate)
        if stored:
            x, labels = (np.concatenate(y) for y in zip(*stored))
            for epoch in range(epochs):
                training.known = training.known[:0]
                training.read(x, labels, rate * (1 - 0.8 * epoch / epochs))
        if windows:
            values = np.concatenate([training.state() * windows * 1e6, [windows], counts])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    texts = docs.select("text")
    rows = (texts.coalesce(1) if alone else texts).mapInArrow(run, "place long, value double")
    sums = {r.place: float(r.value) for r in rows.groupBy("place").agg(
        F.sum(F.round("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not sums:
        return state, 0, 0
    total = np.array([sums[i] for i in range(len(sums))])
    return total[:-3] / total[-3] / 1e6, int(total[-2]), int(total[-1])


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 16 * AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same rows, more of them at once."""
    held, n = [], 0
    for of, x in parts:
        held.append((of, x.astype(np.uint8)))
        n += len(of)
        if n >= least:
            yield tuple(np.concatenate(y) for y in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(y) for y in zip(*held))


def _held_outputs(docs: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output, label, number) of all candidates of the rows: outputs in steps of 1 / FINE, rounded down, counted by Spark."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            tally = np.zeros((2, 2 * FAR * FINE), np.int64)
            for part in batches_of(batch.column("text")):
                c, labels = labelled_candidates(part)
                step = np.clip(np.floor(best_outputs(model.value, c) * FINE), -FAR * FINE, FAR * FINE - 1).astype(np.int64) + FAR * FINE
                np.add.at(tally, ((labels == FINDING).astype(int), step), 1)
            label, step = np.nonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(step), pa.array(tally[label, step])], names=["label", "step", "n"])

    rows = docs.select("text").mapInArrow(run, "label long, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).orderBy("step", "label").collect()
    step, label, n = (np.array([r[k] for r in rows], float) for k in ("step", "label", "n"))
    return step / FINE - FAR, label, n


def fit_scanner(docs: DataFrame, recall: float = 0.99, least: int = 5, slices: int = 4, epochs: int = 40, rate: float = 0.01) -> Scanner:
    """Train on all values that the base patterns find against all other candidates.

    A quarter of the documents, by a hash of id and text, is held back for
    calibration; every candidate of the others is trained on.  Each task trains on
    the candidates of its rows, and the tasks' networks are averaged: after each of
    ``slices`` parts of a large table, and after each whole reading of one of less
    than CHARACTERS, which is read until so many were, at most ``epochs`` times.
    One of less than ALONE is read by one task.  Findings and others weigh the
    same, words and other runs do so among the others.  Training reads all
    windows of a candidate; calibration and threshold count the largest output over
    them of every candidate held back, as scoring does.  The threshold finds at
    least ``recall`` of the findings held back: the highest that does so, moved
    halfway to the next candidate below that is no finding.  It has no floor, so
    where findings are rare or hard, recall goes before precision.  With fewer than
    ``least`` findings or other candidates to train on, or none of either held
    back, there is no network, and only base spans are found.
    """
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * slices))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    alone = size < ALONE
    times = min(epochs, math.ceil(CHARACTERS / max(size, 1)))
    passes, parts = (1, 1) if alone else (times, max(1, slices // times))
    training, counts = Training(Network()), np.zeros(2, np.int64)
    state = training.state()
    for job in range(passes * parts):
        some = docs.filter((turn >= slices) & (turn % parts == job % parts))
        state, found, other = _train(some, state, 7 + job, rate * (1 - 0.8 * job / (passes * parts)), times if alone else 1, alone)
        if job < parts:
            counts += [found, other]
        if job == parts - 1 and counts.min() < least:
            return Scanner(read=(*counts.tolist(), 0, 0))
    training.restore(state)
    logit, labels, n = _held_outputs(docs.filter(turn < slices), training.network)
    read = (*counts.tolist(), int(n[labels == 1].sum()), int(n[labels == 0].sum()))
    if min(read[2:]) == 0:
        return Scanner(read=read)
    slope, offset = _platt(logit, labels, n)
    p = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -30, 30)))
    found = np.flatnonzero(labels == 1)
    highest = p[found[np.searchsorted(np.cumsum(n[found]), int((1 - recall) * read[2]), side="right")]]
    below = p[(labels == 0) & (p < highest)].max(initial=0.0)
    return Scanner(training.network, slope, offset, float(highest + below) / 2, read)


def _spans_udf(scanner, result: Callable, returns: pa.DataType, schema: str):
    """An Arrow UDF over texts: ``result`` of each text and its spans; many texts go through the network together."""
    names = [f.name for f in returns] if pa.types.is_struct(returns) else None

    def run(texts: pa.Array) -> pa.Array:
        out = [result(t, spans) for part in batches_of(texts) for t, spans in zip(part, scanner.value.spans_of(part))]
        return pa.array([dict(zip(names, row)) for row in out] if names else out, returns)

    return F.arrow_udf(run, schema)


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def secret_findings(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    Spans are in code points of the whole text, the end exclusive.  A null or
    empty text has none.  Only ``doc_id`` and ``text`` are read; repeated rows
    give repeated results and an empty table none.
    """
    model = docs.sparkSession.sparkContext.broadcast(scanner)
    returns = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())])

    def found(text: str, spans: list) -> tuple:
        base = [s for s in spans if s[1] < 3]
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    udf = _spans_udf(model, found, returns, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", udf(F.col("text")).alias("_f")).select("doc_id", "_f.*")


def redacted(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``; null stays null."""
    model = docs.sparkSession.sparkContext.broadcast(scanner)

    def cleaned(text: str, spans: list) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if at else text

    return F.when(F.col("text").isNotNull(), _spans_udf(model, cleaned, pa.string(), "string")(F.col("text")))
