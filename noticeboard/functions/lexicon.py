"""Blocklist and weighted-term score of a title."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import array_of, bind, contains_any, reduced, sql_string


@dataclass(frozen=True)
class Lexicon:
    """Scoring parameters.  ``terms`` keeps insertion order, which breaks length ties."""

    terms: Mapping[str, float] = field(
        default_factory=lambda: {**V.WEAK_TERMS, **V.MEDIUM_TERMS, **V.STRONG_TERMS})
    action_words: Sequence[str] = tuple(V.ACTION_WORDS)
    object_words: Sequence[str] = tuple(V.OBJECT_WORDS)
    source_hints: Sequence[str] = tuple(V.SOURCE_HINTS)
    categories: Sequence[str] = tuple(V.SCORED_CATEGORIES)
    blocklist: Sequence[str] = tuple(V.BLOCKLIST)

    def extended(self, extra: Mapping[str, float]) -> "Lexicon":
        return Lexicon({**self.terms, **extra}, self.action_words, self.object_words,
                       self.source_hints, self.categories, self.blocklist)

    def longest_first(self) -> list[tuple[str, float, list[str]]]:
        """(term, weight, longer terms that contain it), longest term first."""
        ordered = sorted(self.terms, key=len, reverse=True)
        return [(t, self.terms[t], [s for s in self.terms if t in s and s != t]) for t in ordered]


def blocked_by(title: Column, blocklist: Sequence[str]) -> Column:
    """First blocklist term the title contains, NULL when there is none."""
    return bind(reduced(title, blocklist), lambda t: first_present(t, blocklist))


def first_present(title: Column, blocklist: Sequence[str]) -> Column:
    return F.get(F.filter(array_of(list(blocklist)), lambda x: F.contains(title, x)), F.lit(0))


def relevant_part(title: Column, lexicon: Lexicon) -> Column:
    """The title ``reduced`` to what the lexicon looks for: all of its tests may read it instead."""
    return reduced(title, [*lexicon.terms, *lexicon.action_words, *lexicon.object_words, *lexicon.blocklist])


def _term_table(lexicon: Lexicon) -> Column:
    def longer(words: list[str]) -> str:
        return "cast(array(" + ", ".join(map(sql_string, words)) + ") AS array<string>)"

    return F.expr("array(" + ", ".join(
        f"named_struct('term', {sql_string(t)}, 'weight', {float(w)!r}D, 'longer', {longer(s)})"
        for t, w, s in lexicon.longest_first()) + ")")


def matched_terms(title: Column, lexicon: Lexicon) -> Column:
    """Terms that count: present, and in no longer term that is present too.

    One look for each term, so ``title`` should be the ``reduced`` one.
    """
    return F.filter(_term_table(lexicon), lambda x: F.contains(title, x["term"])
                    & ~F.exists(x["longer"], lambda s: F.contains(title, s)))


def score(title: Column, category: Column, source_name: Column, lexicon: Lexicon) -> Column:
    """Relevance of an already cleaned title.

    Weights are added longest term first, so sums equal a sequential fold bit
    for bit and comparisons with the threshold are stable.
    """
    return bind(F.struct(title.alias("whole"), relevant_part(title, lexicon).alias("part")),
                lambda x: score_of(x["whole"], x["part"], category, source_name, lexicon))


def score_of(title: Column, part: Column, category: Column, source_name: Column, lexicon: Lexicon) -> Column:
    """The same, with the title's ``relevant_part`` at hand."""
    base = (F.aggregate(matched_terms(part, lexicon), F.lit(0.0), lambda acc, x: acc + x["weight"])
            if lexicon.terms else F.lit(0.0))
    pair = contains_any(part, lexicon.action_words) & contains_any(part, lexicon.object_words)
    total = base + F.when(pair, V.PAIR_BONUS).otherwise(0.0)
    total = total + F.when(category.isin(list(lexicon.categories)), V.CATEGORY_BONUS).otherwise(0.0)
    total = total + F.when(contains_any(source_name, lexicon.source_hints), V.SOURCE_BONUS).otherwise(0.0)
    total = total * F.when(F.length(title) < V.SHORT_TITLE_CHARS, V.SHORT_TITLE_FACTOR).otherwise(1.0)
    return F.when(title == "", F.lit(0.0)).otherwise(total)
