"""Stable keys of a notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.dates import publish_date
from noticeboard.functions.titles import normalize_title
from noticeboard.functions.urls import normalize_url


def unique_id(url: Column) -> Column:
    return F.md5(normalize_url(url))


def dedup_key(city: Column, title: Column) -> Column:
    return F.md5(F.concat(city, F.lit("|"), normalize_title(title)))


def content_fingerprint(title: Column, published: Column, deadline: Column) -> Column:
    return F.sha2(F.concat(normalize_title(title), F.lit("_"), F.coalesce(published, F.lit("")),
                           F.lit("_"), deadline), 256)


def has_actionable_detail(amount: Column, deadline: Column, audience: Column) -> Column:
    def known(c: Column, unknown: str) -> Column:
        return ~F.coalesce(c, F.lit("")).isin("", unknown)

    return (F.coalesce(amount, F.lit("")) != "") | known(deadline, V.DEADLINE_UNKNOWN) | known(audience, V.AUDIENCE_UNKNOWN)


def with_keys(notices: DataFrame) -> DataFrame:
    """Add canonical_url, unique_id, dedup_key, content_fingerprint and publish_dt."""
    return notices.withColumns({
        "canonical_url": normalize_url(F.col("url")),
        "dedup_key": dedup_key(F.col("city"), F.col("title")),
        "content_fingerprint": content_fingerprint(F.col("title"), F.col("publish_date"), F.col("deadline")),
        "publish_dt": publish_date(F.col("publish_date")),
    }).withColumn("unique_id", F.md5("canonical_url"))


def with_title_keys(notices: DataFrame) -> DataFrame:
    """Take dedup_key and content_fingerprint again after a change of title, city or deadline; keys of address and date stay."""
    return notices.withColumns({
        "dedup_key": dedup_key(F.col("city"), F.col("title")),
        "content_fingerprint": content_fingerprint(F.col("title"), F.col("publish_date"), F.col("deadline")),
    })


def to_brief(notices: DataFrame) -> DataFrame:
    """The fourteen display columns; the exact score stays available as relevance_score_raw."""
    return notices.select(
        "title", "url", "city", "district", "source_name", "category", "target_audience",
        "deadline", "amount_or_quota", "age_limit", "apply_channel",
        F.coalesce(F.nullif(F.col("publish_date"), F.lit("")), F.lit(V.RECENTLY)).alias("publish_date"),
        "notes", F.round("relevance_score", 2).alias("relevance_score"),
        F.col("relevance_score").alias("relevance_score_raw"))
