"""Small column helpers shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Without this, projections that Catalyst collapses would repeat a costly
    regular expression once per use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_struct(df: DataFrame, value: Column) -> DataFrame:
    """Add the fields of a struct column, computed once per row.

    A filter on one of the fields is otherwise pushed below the projection and
    the struct is computed again for it.  A one-row generator is a boundary
    that filters on its output do not cross.
    """
    return df.select("*", F.inline_outer(F.array(value)))


def first_by(items: Column, key: str) -> Column:
    """The structs of an array whose ``key`` did not occur before, in their order.

    Sorted by key and position, a struct is the first of its key if it differs from
    the one before it: two sorts instead of a look at all earlier items for each.
    """
    def firsts(ordered: Column) -> Column:
        fresh = F.filter(ordered, lambda x, i: (i == 0) | ~x["key"].eqNullSafe(F.get(ordered, i - 1)["key"]))
        return F.transform(F.array_sort(F.transform(fresh, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item")))),
                           lambda x: x["item"])

    placed = F.transform(items, lambda x, i: F.struct(x[key].alias("key"), i.alias("at"), x.alias("item")))
    return bind(F.array_sort(placed), firsts)


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace."""
    return F.btrim(c, F.lit(V.WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return strip(F.regexp_replace(c, f"[{V.WS}]+", " "))


def group(c: Column, pattern: str, index: int) -> Column:
    """Group of the first match, NULL instead of '' when it did not match."""
    return bind(F.regexp_extract(c, pattern, index), lambda x: F.when(x != "", x))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, V.WIDE_DIGITS, V.ASCII_DIGITS)


def to_int(c: Column) -> Column:
    return ascii_digits(c).try_cast("int")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def reduced(c: Column, words: Sequence[str]) -> Column:
    """The text without runs of characters that occur in none of the words, each run one separator.

    It contains a word exactly if the text does, so any number of words is looked
    for after one pass over the text.  Characters close to each other are taken as
    ranges; keeping some more does no harm.
    """
    points = sorted({ord(ch) for w in words for ch in w})
    if not points:
        return c
    # two ranges at most: a test of many costs more than the few characters it would drop
    widest = max(range(1, len(points)), key=lambda i: points[i] - points[i - 1], default=0)
    edges = [0, widest, len(points)] if widest and points[widest] - points[widest - 1] > 2000 else [0, len(points)]
    kept = [(points[a], points[b - 1]) for a, b in zip(edges, edges[1:])]
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in kept)
    separator = next(chr(p) for p in (10, *range(1, 10), *range(11, 1 << 16)) if not any(a <= p <= b for a, b in kept))
    return F.regexp_replace(c, f"[^{ranges}]+", separator)


# all characters but CJK ones, digits, slashes and line ends
_SPARSE = r"\x{1}-\x{9}\x{B}-\x{2E}\x{3A}-\x{2E7F}"
_HEAD = 48


def dense(c: Column) -> Column:
    """The text without most of long stretches of other scripts.

    Of a stretch without CJK characters, digits, slashes and line ends the first 48
    characters stay, followed by a mark.  Patterns that begin with one of these
    characters and bridge at most 30 others, or any number of blanks, find in it
    what they find in the text, in the same order: a stretch of blanks alone stays
    whole, and ``.*`` matches across as before.
    """
    stretch = f"([{_SPARSE}]{{{_HEAD}}})[{V.WS}&&[{_SPARSE}]]{{0,200}}+[{_SPARSE}&&[^{V.WS}]][{_SPARSE}]{{40,}}+"
    return F.regexp_replace(c, stretch, "$1\x01")


def sql_string(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(words: Sequence[str]) -> Column:
    """Array literal, parsed in one step instead of built word by word."""
    return F.expr("array(" + ", ".join(sql_string(w) for w in words) + ")").cast("array<string>")


def substrings(c: Column, max_chars: int | Column | None = None) -> Column:
    """All distinct non-empty substrings of a short string, of at most ``max_chars`` (1 or more) characters.

    They turn a containment join into an equi-join, so no pair of rows has to
    be compared that does not match.
    """
    n = F.length(c)
    starts = F.sequence(F.lit(1), n)

    def from_start(i: Column) -> Column:
        longest = n - i + 1
        if max_chars is not None:
            longest = F.least(longest, max_chars if isinstance(max_chars, Column) else F.lit(max_chars))
        return F.transform(F.sequence(F.lit(1), longest), lambda k: F.substring(c, i, k))

    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, from_start))))
