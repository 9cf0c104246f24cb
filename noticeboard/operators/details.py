"""Facts from detail pages for the best notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.functions.facts import apply_facts


def top_by_score(notices: DataFrame, limit: int, key: str) -> DataFrame:
    """The best notices; a sorted limit keeps ``limit`` rows per task, unlike a global window."""
    return notices.orderBy(F.desc("relevance_score"), key).limit(limit)


def enrich_with_details(notices: DataFrame, details: DataFrame, key: str = "unique_id",
                        limit: int | None = None, head_chars: int | None = None) -> DataFrame:
    """Overwrite fields of the best notices with facts from ``details(key, main_text)``.

    The other notices, and those without a usable detail page, pass unchanged.
    All notices get their details unless ``limit`` gives a budget; then only the
    details of the chosen notices reach the join.
    """
    if limit is not None:
        chosen = top_by_score(notices, limit, key).select(key)
        details = details.join(chosen, key, "left_semi")
    # texts swell when they are read, so their stored size is no reason to broadcast them
    joined = notices.join(details.select(key, "main_text").hint("merge"), key, "left")
    return apply_facts(joined, "main_text", head_chars).select(*notices.columns)
