"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one merge gadget after the other, into a deterministic
automaton whose arcs are labelled with tokens and which accepts exactly the
sequences that BPE produces.  After Berglund, Martens and van der Merwe,
"Constructing a BPE Tokenization DFA".  A pre-split word is encoded by one
table-driven pass over its bytes, and decoded by emitting the labels of its arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.llm.common import text_udf

# white space and word pattern of the vocabulary file's own pre-tokenizer
SPACE = "\t-\r \u0085   -     　"
CHUNK = re.compile(f"[^{SPACE}]+")
# words remembered by a worker, with half as many runs without white space and as many arcs and two thirds more; only speed depends on it
CACHED = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over tokens.

    Every state is the set of arcs that may be taken there; an arc's target
    depends on its label only.  A merge gadget for ``u v -> w`` gives the arcs
    labelled ``u`` a new target, a copy of the old one without ``v``, and puts an
    arc ``w`` beside every arc ``u`` that could be followed by ``v``, to where
    ``v`` led.  States are stored as differences: the state copied, when it was
    copied, and the arcs removed since with their time.  ``step`` fills the
    transition table as it is asked for.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], most: int = CACHED * 5 // 3):
        self.parent, self.copied_at, self.removed = [-1], [0], [{}]
        self.target: dict[int, int] = dict.fromkeys(base, 0)
        self.left: dict[int, int] = {}   # token -> the left half it was merged from
        self.born: dict[int, int] = dict.fromkeys(base, -1)
        self.table: dict[int, int] = {}     # state and token -> target or -1, at most ``most``
        self.most = most
        shared = {0: len(base)}          # arcs labels per target state
        for time, (u, v, w) in enumerate(merges):
            if w in self.born or u not in self.born or v not in self.born:
                raise ValueError(f"merge {time} is out of order or repeats a token")
            old, after = self.target[u], self.target[v]
            if shared[old] == 1 and u != v:
                state = old              # no other arc leads here: the copy replaces it
            else:
                state = len(self.parent)
                self.parent.append(old)
                self.copied_at.append(time)
                self.removed.append({})
                shared[old] -= 1
                shared[state] = 1
                self.target[u] = state
            self.removed[state].setdefault(v, time)
            if u != v:
                after = self.target[v]
            self.target[w], self.left[w], self.born[w] = after, u, time
            shared[after] = shared.get(after, 0) + 1

    def _gone(self, state: int, token: int) -> float:
        """When the arc left this state's line of copies; never: infinity."""
        limit = when = float("inf")
        removed, copied_at, parent = self.removed, self.copied_at, self.parent
        while state >= 0:
            at = removed[state].get(token)
            if at is not None and at < limit and at < when:
                when = at
            if copied_at[state] < limit:
                limit = copied_at[state]
            state = parent[state]
        return when

    def step(self, state: int, token: int) -> int:
        """The target of the arc, or -1 where there is none; fills the table."""
        known, later, at = self.target[token], float("inf"), token
        while True:
            # an arc was put here only if its left half was here at that time;
            # a token merged with itself goes as its double comes
            gone = self._gone(state, at)
            if gone < float("inf") and gone <= later:
                known = -1
                break
            if at not in self.left:
                break
            later, at = self.born[at], self.left[at]
        if len(self.table) >= self.most:
            self.table.clear()
        self.table[state << 20 | token] = known
        return known


class Encoder:
    """Normalises, pre-splits, encodes and decodes texts for one vocabulary file.

    Follows the file's description: special tokens are cut out of the raw text,
    then NFC, white space, lower case and the word pattern; a word's last byte
    carries the end-of-word suffix.  Other descriptions are refused.
    """

    def __init__(self, description: str, cached: int = CACHED):
        self.cached = cached
        spec = json.loads(description)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or [
                s["type"] for s in steps] != ["Split", "ByteLevel"] or model.get("byte_fallback"):
            raise ValueError("unsupported tokenizer description")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
                                 ) if self.special else None
        self.symbols = byte_symbols()
        base = [self.vocab[s + e] for s in self.symbols for e in ({"", self.suffix}) if s + e in self.vocab]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = TokenAutomaton(base, [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], cached * 5 // 3)
        made = set(base) | set(self.automaton.left)
        self.heads: dict[str, int] = {}  # every beginning of an arc's label -> its token, or -1
        self.final: dict[str, int] = {}  # labels that end a word
        cut = len(self.suffix)
        for text, token in self.vocab.items():
            if token not in made:
                continue
            if cut and text.endswith(self.suffix):
                self.final[text[:-cut]] = token
                continue
            for i in range(1, len(text)):
                self.heads.setdefault(text[:i], -1)
            self.heads[text] = token
            if not cut:
                self.final[text] = token
        self.longest = max(map(len, self.final))
        self.number = {i: str(i) for i in self.vocab.values()}
        self.label = {i: t for t, i in (self.vocab | self.special).items()}
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-split word: the only path of arcs that spells it."""
        spelled = word if word.isascii() and word.isprintable() else "".join(
            [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        known, step, heads, final = self.automaton.table.get, self.automaton.step, self.heads.get, self.final.get
        n = len(spelled)
        states: list[int] = [0] + [-1] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for begin in range(n):
            state = states[begin]
            if state < 0:
                continue
            key = state << 20
            token = final(spelled[begin:] if n - begin <= self.longest else "")
            if token is not None:
                to = known(key | token)
                if (step(state, token) if to is None else to) >= 0:
                    path = [token]
                    while begin:
                        begin, token = back[begin]
                        path.append(token)
                    return path[::-1]
            for end in range(begin + 1, n):
                token = heads(spelled[begin:end])
                if token is None:
                    break
                if token >= 0 and states[end] < 0:
                    to = known(key | token)
                    if to is None:
                        to = step(state, token)
                    if to >= 0:
                        states[end], back[end] = to, (begin, token)
        raise ValueError("the vocabulary lacks a byte of the text")

    def piece(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, ids and labels of a pre-split word."""
        known = self.cache.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                ids = self.word(word)
                number, label = self.number, self.label
                known = (len(ids), " ".join([number[i] for i in ids]), " ".join([label[i] for i in ids]))
            if len(word) <= 64:
                if len(self.cache) >= self.cached:  # what was used lately lives on as the older half
                    self.older, self.cache = self.cache, {}
                self.cache[word] = known
        return known

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """The same of a run without white space."""
        if chunk.isalpha():
            return self.piece(chunk)
        body, last = chunk[:-1], chunk[-1]
        if last in ".,;:!?" and body.isalpha():
            a, b = self.piece(body), self.piece(last)
            known = a[0] + b[0], f"{a[1]} {b[1]}", f"{a[2]} {b[2]}"
        else:
            parts = [self.piece(w) for w in self.words.findall(chunk)]
            known = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        if len(chunk) <= 24:
            if len(self.chunks) >= self.cached // 2:
                self.chunks = {}
            self.chunks[chunk] = known
        return known

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((1, str(self.special[part]), part))
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # lower case letter by letter: no final form of sigma
            chunk, known, run = self.chunk, self.cache.get, self.chunks.get
            out += [known(c) or run(c) or chunk(c) for c in CHUNK.findall(part.replace("Σ", "σ").lower())]
        return [p for p in out if p[0]]

    def ids(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by blanks: the file names no decoder."""
        return " ".join(self.label[i] for i in ids if i in self.label)

    def digest(self, text: str) -> tuple[int, str, str]:
        pieces = self.pieces(text)
        ids, labels = " ".join([p[1] for p in pieces]), " ".join([p[2] for p in pieces])
        return (sum([p[0] for p in pieces]), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(labels.encode("utf-8", "surrogatepass")).hexdigest())


@lru_cache(maxsize=2)
def encoder(description: str, cached: int = CACHED) -> Encoder:
    return Encoder(description, cached)


def _broadcast(spark: SparkSession, vocabulary: str):
    """The vocabulary file (1.7 MB, read on the driver) for all executors."""
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """array<int> of token ids; a null text is empty and has none."""
    file = _broadcast(spark, vocabulary)
    return text_udf(lambda: lambda t: encoder(file.value).ids(t), pa.list_(pa.int32()), "array<int>")(text)


def decode_column(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The text of token ids; null for null, ids the vocabulary lacks are left out."""
    file = _broadcast(spark, vocabulary)

    def decoded(values: pa.Array) -> pa.Array:
        e = encoder(file.value)
        return pa.array([None if v is None else e.decode(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(decoded, "string")(ids)


def bpe_digests(docs: DataFrame, vocabulary: str, cached: int = CACHED) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    Whole texts; a null text is encoded as an empty one (no token, digests of
    the empty string).  Only ``doc_id`` and ``text`` are read; repeated rows give
    repeated results and an empty table none.  A worker remembers ``cached`` words
    and keeps them until it ends, so fewer suit jobs with other work beside.
    """
    file = _broadcast(docs.sparkSession, vocabulary)
    returns = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digest = text_udf(lambda: lambda t: encoder(file.value, cached).digest(t), returns,
                      "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")
