"""Filtering and scoring of notices, and selection of rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import dates, lexicon as lx, titles
from noticeboard.functions.text import bind, dense, squeeze, strip, with_struct


@dataclass(frozen=True)
class Policy:
    """What counts as relevant.  ``today`` is always given, never read from the clock."""

    today: str
    lexicon: lx.Lexicon = field(default_factory=lx.Lexicon)
    threshold: float = V.SCORE_THRESHOLD
    max_age_days: int | None = V.MAX_AGE_DAYS


def validated(notices: DataFrame) -> DataFrame:
    """Notices in canonical form: title squeezed and not empty, names trimmed, category known."""
    return notices.filter(F.col("title").rlike(f"[^{V.WS}]")).withColumns({
        "title": squeeze(F.col("title")), "city": strip(F.coalesce("city", F.lit(""))),
        "source_name": strip(F.coalesce("source_name", F.lit(""))),
        "category": titles.coerce_category(F.col("category"))})


def is_fresh(age: Column, max_age_days: int | None) -> Column:
    """Unknown and future dates pass; the limit itself is included."""
    if max_age_days is None:
        return F.lit(True)
    return F.coalesce(age <= max_age_days, F.lit(True))


def judge(notices: DataFrame, policy: Policy) -> DataFrame:
    """Add title_clean, blocked_term, age_days, relevance_score and reason to ``validated`` notices.

    Cheap tests come first: a blocked or stale notice is never scored and its
    relevance_score stays NULL.
    """
    today = F.lit(policy.today).cast("date")

    def parts(title: Column) -> Column:
        return F.struct(title.alias("title_clean"), lx.relevant_part(title, policy.lexicon).alias("part"))

    def tests(t: Column) -> Column:
        return F.struct(
            t["title_clean"].alias("title_clean"), t["part"].alias("part"),
            lx.first_present(t["part"], policy.lexicon.blocklist).alias("blocked_term"),
            dates.age_days(dates.publish_date(F.col("publish_date")), today).alias("age_days"))

    def scored(t: Column) -> Column:
        open_ = t["blocked_term"].isNull() & is_fresh(t["age_days"], policy.max_age_days)
        value = lx.score_of(t["title_clean"], t["part"], F.col("category"), F.col("source_name"), policy.lexicon)
        return F.struct(t["title_clean"].alias("title_clean"), t["blocked_term"].alias("blocked_term"),
                        t["age_days"].alias("age_days"), F.when(open_, value).alias("relevance_score"))

    def verdict(t: Column) -> Column:
        reason = (F.when(t["blocked_term"].isNotNull(), "blacklisted")
                  .when(t["relevance_score"].isNull(), "stale")
                  .when(t["relevance_score"] < policy.threshold, "low_score")
                  .otherwise("kept"))
        return F.struct(*[t[c].alias(c) for c in ("title_clean", "blocked_term", "age_days", "relevance_score")],
                        reason.alias("reason"))

    clean = titles.clean_title(F.col("title"), squeezed=True)
    return with_struct(notices, bind(bind(bind(bind(clean, parts), tests), scored), verdict))


def funnel(judged: DataFrame) -> DataFrame:
    """One row: how many notices each test dropped."""
    return judged.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("blacklisted", "stale", "low_score", "kept")])


def kept(judged: DataFrame) -> DataFrame:
    """Relevant notices with facts read from the title and a refined category."""
    return enrich_from_title(judged.filter(F.col("reason") == "kept"))


def enrich_from_title(notices: DataFrame) -> DataFrame:
    title = F.col("_dense")
    return notices.withColumn("_dense", dense(F.col("title_clean"))).withColumns({
        "title": F.col("title_clean"),
        "target_audience": titles.title_audience(title, F.col("target_audience")),
        "amount_or_quota": titles.title_amount(title, F.col("amount_or_quota")),
        "notes": titles.title_notes(title, F.col("notes")),
        "category": titles.refine_category(title, F.col("category")),
    }).drop("title_clean", "blocked_term", "age_days", "reason", "_dense")


def select_rules_by_city(rules: DataFrame, target: str) -> DataFrame:
    """Rules whose city contains the target or is contained in it; a rule without city never matches."""
    target, city = target.strip(), F.col("city")
    return rules.filter((F.coalesce(city, F.lit("")) != "")
                        & (F.contains(city, F.lit(target)) | F.contains(F.lit(target), city)))


def select_rules_for_scan(rules: DataFrame, target: str) -> DataFrame:
    """As above, or the district or source name contains the target."""
    target, city = target.strip(), F.coalesce(F.col("city"), F.lit(""))
    return rules.filter(
        ((city != "") & (F.contains(city, F.lit(target)) | F.contains(F.lit(target), city)))
        | F.coalesce(F.contains(F.col("district"), F.lit(target)), F.lit(False))
        | F.coalesce(F.contains(F.col("source_name"), F.lit(target)), F.lit(False)))


def select_rules_by_subscription(rules: DataFrame, subscriptions: DataFrame | None) -> DataFrame:
    """Rules of the subscribed cities; without subscriptions all rules."""
    if subscriptions is None:
        return rules
    return rules.join(subscriptions.select("city").distinct(), "city", "left_semi")


def search(ledger: DataFrame, city: str | None = None, category: str | None = None,
           text: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored notices, newest first; text tests ignore ASCII case and treat % and _ as plain.

    ``limit`` cuts the result for display.
    """
    def has(columns: Sequence[str], needle: str) -> Column:
        wanted = F.lit(needle.lower())
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
        return out

    out = ledger
    if city and city != V.ALL_CITIES:
        out = out.filter(has(["city", "district"], city))
    if category and category != "all":
        out = out.filter(F.col("category") == category)
    if text:
        out = out.filter(has(["city", "district", "title", "source_name"], text.strip()))
    out = out.orderBy(F.desc("first_seen_at"), F.desc("publish_date"), "unique_id")
    return out if limit is None else out.limit(limit)
