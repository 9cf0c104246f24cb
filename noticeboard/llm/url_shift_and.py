"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one set of Shift-And masks of several 64-bit
words.  A batch of URLs is read one position at a time and every rule advances
for every URL in the same few vector operations.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a path prefix."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        # the canonical URL starts with a dot, so a dot precedes every label
        return f"*.{escaped(self.host + self.path)}**"


# globs over the canonical URL for pages that no rule fits: `*` stays inside
# the host or one path segment, `**` goes on to the end, `?` is one character
BLOCK_GLOBS = ("*.cheap-*.**", "*.*-pills.**", "*casino*/**", "**/wp-login*", "**.exe")
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class ShiftAnd:
    """Several glob patterns as one non-deterministic automaton in bit vectors.

    Each pattern takes one bit per character class plus a start bit.  A star is
    a loop on the bit before it: over any character, or over all but ``/``.
    """

    def __init__(self, globs: Sequence[str]):
        classes: list[tuple[int, str]] = []  # (bit, character class) of the steps
        loops: list[tuple[int, str]] = []
        starts, self.accepts, bit = [], [], 0
        for glob in globs:
            starts.append(bit)
            i = 0
            while i < len(glob):
                c = glob[i]
                if c == "*":
                    wide = glob[i:i + 2] == "**"
                    loops.append((bit, "any" if wide else "segment"))
                    i += 2 if wide else 1
                    continue
                if c == "\\":
                    i += 1
                    c = glob[i]
                    classes.append((bit + 1, c))
                else:
                    classes.append((bit + 1, "any" if c == "?" else c))
                bit += 1
                i += 1
            self.accepts.append(bit)
            bit += 1
        self.words = -(-bit // 64)
        self.start, self.step = self._mask(starts), np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for table, entries in ((self.step, classes), (self.loop, loops)):
            for at, kind in entries:
                word, one = divmod(at, 64)
                if kind == "any":
                    table[:, word] |= np.uint64(1 << one)
                elif kind == "segment":
                    table[np.arange(256) != ord("/"), word] |= np.uint64(1 << one)
                else:
                    # a character beyond ASCII is several bytes, hence refused here
                    if ord(kind) > 127:
                        raise ValueError(f"a glob may hold ASCII only: {kind!r}")
                    table[ord(kind), word] |= np.uint64(1 << one)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Which pattern matches which whole URL: booleans, URLs x patterns."""
        raw = [u.encode("utf-8", "surrogatepass") for u in urls]
        sizes = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")  # longest first: those still being read are a prefix
        state = np.tile(self.start, (len(raw), 1))
        joined = np.frombuffer(b"".join(raw[i] for i in order) + b"\0", np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]) if len(raw) else np.zeros(0, np.int64)
        active, falling = len(raw), sizes[order]
        one, top = np.uint64(1), np.uint64(63)
        for position in range(int(sizes.max(initial=0))):
            while falling[active - 1] <= position:
                active -= 1
            seen = joined[begins[:active] + position]
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.step[seen]) | (now & self.loop[seen])
        found = np.empty((len(raw), len(self.accepts)), bool)
        for k, bit in enumerate(self.accepts):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return found


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def judge_urls(host: Column, path: Column, rules: Sequence[Rule] = RULES,
               block_globs: Sequence[str] = BLOCK_GLOBS) -> Column:
    """struct(rule, verdict) for a host and a path.

    The longest rule that fits decides.  Where none fits, a page is blocked if
    one of ``block_globs`` matches its canonical URL (a dot, the host, the
    path), else allowed.  Rules of equal length: the first given wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r.name))
    automaton = ShiftAnd([r.glob for r in ordered] + list(block_globs))
    returns = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    def judged(urls: pa.Array) -> pa.Array:
        names, verdicts = [], []
        for at in range(0, len(urls), 4096):
            found = automaton.matches(urls.slice(at, 4096).to_pylist())
            by_rule, by_glob = found[:, :len(ordered)], found[:, len(ordered):]
            fits, first = by_rule.any(axis=1), by_rule.argmax(axis=1) if ordered else np.zeros(len(found), int)
            blocked = by_glob.any(axis=1)
            names += [ordered[first[i]].name if fits[i] else None for i in range(len(found))]
            verdicts += [ordered[first[i]].verdict if fits[i] else "block" if blocked[i] else "allow"
                         for i in range(len(found))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                          fields=list(returns))

    return F.arrow_udf(judged, "rule string, verdict string")(F.concat(F.lit("."), host, path))


def filtered_pages(pages: DataFrame, rules: Sequence[Rule] = RULES,
                   block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Only ``page_id`` and ``url`` are read, so other columns, whatever their
    names, do no harm.  A null url or one without ``://`` has an empty host and
    path, fits no rule and is allowed unless a glob matches the empty URL.
    Repeated rows give repeated results; an empty table gives none.
    """
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return split.withColumn("_j", judge_urls(F.col("host"), F.col("path"), rules, block_globs)).select(
        "page_id", "host", "path", "_j.rule", "_j.verdict")


def filtered_pages_sql(pages: str = "pages", rules: Sequence[Rule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> str:
    """The same in SQL, the rules one after the other and the globs as regular expressions."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def regex(glob: str) -> str:
        out, i = "(?s)", 0
        while i < len(glob):
            if glob[i:i + 2] == "**":
                out, i = out + ".*", i + 2
                continue
            if glob[i] == "\\":
                i += 1
                out += re.escape(glob[i])
            else:
                out += {"*": "[^/]*", "?": "."}.get(glob[i]) or re.escape(glob[i])
            i += 1
        return out

    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = [f"(host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)})" for r in ordered]
    names = " ".join(f"WHEN {f} THEN {text(r.name)}" for f, r in zip(fits, ordered))
    verdicts = " ".join(f"WHEN {f} THEN {text(r.verdict)}" for f, r in zip(fits, ordered))
    blocked = " OR ".join(f"regexp_full_match('.' || host || path, {text(regex(g))})" for g in block_globs)
    return f"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{PATH}', 1), '') AS path
  FROM {pages})
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {verdicts} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM split"""
