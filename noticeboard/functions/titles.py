"""Title cleaning, title facts and category columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import bind, group, squeeze, strip

_TAIL_CHARS = 24  # more than '[ 2026-12-31 ] ' with blanks on every side


def normalize_title(title: Column) -> Column:
    """Title without whitespace and punctuation marks, for comparing titles."""
    return F.translate(F.coalesce(title, F.lit("")), V.WS_CHARS + V.TITLE_MARKS, "")


def clean_title(title: Column, squeezed: bool = False) -> Column:
    """Title without the date prefix, date suffix and 'more' link of a list row.

    Blanks are collapsed first, unless the title is ``squeezed`` already.  Once they are, a date suffix fits into a short tail, and a
    'more' link ends in an arrow, so long titles are not searched as a whole.
    """
    def without_date_suffix(t: Column) -> Column:
        cut = F.greatest(F.length(t) - _TAIL_CHARS, F.lit(0))
        tail = F.regexp_replace(F.substring(t, cut + 1, F.lit(_TAIL_CHARS)), V.TITLE_DATE_SUFFIX, "")
        return strip(F.concat(F.substring(t, F.lit(1), cut), tail))

    def without_more(t: Column) -> Column:
        return F.when(t.endswith(">") | t.endswith("》"),
                      strip(F.regexp_replace(t, V.TITLE_MORE_SUFFIX, ""))).otherwise(t)

    t = F.coalesce(title, F.lit(""))
    t = t if squeezed else squeeze(t)
    t = F.regexp_replace(t, V.TITLE_DATE_PREFIX, "")
    return bind(bind(t, without_date_suffix), without_more)


def coerce_category(value: Column) -> Column:
    name = F.lower(strip(value.cast("string")))
    return F.when(name.isin(V.CATEGORIES), name).otherwise(V.DEFAULT_CATEGORY)


def refine_category(title: Column, category: Column) -> Column:
    """First matching title pattern decides; otherwise the category stays."""
    out = None
    for name, pattern in V.CATEGORY_PATTERNS:
        out = F.when(title.rlike(pattern), name) if out is None else out.when(title.rlike(pattern), name)
    return out.otherwise(category)


def joined_labels(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Labels of the patterns found, in pattern order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[
        F.when(text.rlike(p), F.lit(label)) for p, label in patterns])))


def title_audience(title: Column, current: Column) -> Column:
    labels = joined_labels(title, V.TITLE_AUDIENCE_PATTERNS)
    return F.when((current == V.AUDIENCE_UNKNOWN) & (F.size(labels) > 0),
                  F.array_join(labels, " / ")).otherwise(current)


def title_amount(title: Column, current: Column) -> Column:
    number, unit = group(title, V.TITLE_QUOTA, 1), group(title, V.TITLE_QUOTA, 2)
    found = F.concat(F.lit("房源 "), number, F.lit(" "), unit)
    return F.when(F.coalesce(current, F.lit("")) == "", F.coalesce(found, current)).otherwise(current)


def title_notes(title: Column, current: Column) -> Column:
    found = F.concat(F.lit("批次: "), group(title, V.TITLE_BATCH, 1))
    return F.when(F.coalesce(current, F.lit("")) == "", F.coalesce(found, current)).otherwise(current)
