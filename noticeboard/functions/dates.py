"""Date columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import bind, to_int

# a whole text that is one ISO date; most dates are
_ISO_DAY = r"^(?!0000){}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\z"


def iso(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def checked_iso(y: Column, m: Column, d: Column, first_year: int = 1, last_year: int = 9999) -> Column:
    """ISO text when year, month and day are in range; the calendar is not checked."""
    return bind(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda t: F.when(
        t["y"].between(first_year, last_year) & t["m"].between(1, 12) & t["d"].between(1, 31),
        iso(t["y"], t["m"], t["d"])))


def _from_first_match(text: Column, pattern: str, build) -> Column:
    """Result for the three numbers of the first match, NULL when the match has fewer."""
    def numbers(hit: Column) -> Column:
        return bind(F.regexp_extract_all(hit, F.lit(f"{V._D}+"), F.lit(0)), lambda parts: F.when(
            F.size(parts) == 1, F.array(F.substring(hit, 1, 4), F.substring(hit, 5, 2), F.substring(hit, 7, 2)),
        ).when(F.size(parts) == 3, parts))

    return bind(bind(F.regexp_substr(text, F.lit(pattern)), numbers),
                lambda n: build(*[to_int(F.get(n, F.lit(i))) for i in range(3)]))


def publish_date(text: Column) -> Column:
    """Date of the first year-month-day in the text; NULL when the calendar has no such day."""
    return F.when(text.rlike(_ISO_DAY.format("[0-9]{4}")), text.try_cast("date")).otherwise(_from_first_match(
        text, V.PUBLISH_DATE,
        lambda y, m, d: bind(y, lambda v: F.when(v >= 1, iso(v, m, d))).try_cast("date")))


def age_days(published: Column, today: Column) -> Column:
    return F.datediff(today, published)


def parse_date_text(text: Column, patterns: Sequence[str] = tuple(V.ROW_DATE_PATTERNS)) -> Column:
    """First pattern whose first hit is a date between 2000 and 2100."""
    found = F.coalesce(*[
        _from_first_match(text, p, lambda y, m, d: checked_iso(y, m, d, 2000, 2100)) for p in patterns])
    if tuple(patterns) != tuple(V.ROW_DATE_PATTERNS):
        return found
    return F.when(text.rlike(_ISO_DAY.format("20[0-9]{2}")), text).otherwise(found)


def heuristic_date(text: Column) -> Column:
    """As ``parse_date_text``, but a month-day that comes first hides a later full date."""
    return _from_first_match(text, V.HEURISTIC_DATE, lambda y, m, d: checked_iso(y, m, d, 2000, 2100))
