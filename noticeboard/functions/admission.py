"""Which links of a listing are notices."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import contains_any, strip

_SKIP_PREFIX = "(?i)^(?:" + "|".join(V.HREF_SKIP_PREFIXES) + ")"
# the extension ends the part before a query
_SKIP_EXTENSION = "(?is)^[^?]*(?:" + "|".join(re.escape(e) for e in V.HREF_SKIP_EXTENSIONS) + ")(?:[?]|\\z)"


def usable_href(href: Column) -> Column:
    """Not a script, mail, anchor or data link and not an attachment."""
    return ~href.rlike(_SKIP_PREFIX) & ~href.rlike(_SKIP_EXTENSION)


def admitted_by_rule(title: Column, href: Column, min_chars: int = V.RULE_MIN_TITLE_CHARS) -> Column:
    ok = (href != "") & (F.length(title) >= min_chars) & ~strip(title).rlike(V.RULE_NAV_TITLE) & usable_href(href)
    return F.coalesce(ok, F.lit(False))


def admitted_by_heuristic(title: Column, href: Column, min_chars: int = V.HEURISTIC_MIN_TITLE_CHARS) -> Column:
    ok = ((href != "") & (F.length(title) >= min_chars) & ~strip(title).isin(V.HEURISTIC_NAV_TITLES)
          & ~contains_any(title, V.HEURISTIC_NAV_PARTS) & ~strip(title).rlike("^[0-9０-９]+$") & usable_href(href))
    return F.coalesce(ok, F.lit(False))
