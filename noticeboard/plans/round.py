"""One full round: collect, judge, read details, discover, queue, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.keys import with_keys, with_title_keys
from noticeboard.operators import details, filters, health, outbox
from noticeboard.operators.dedup import first_per_key
from noticeboard.session import shared_dir
from noticeboard.sources import fetched, listing
from noticeboard.streaming.batch_log import BatchLog
from noticeboard.streaming.dated_log import DatedLog

ORDER = ["negative_score", "rule_id", "page", "position"]


@dataclass(frozen=True)
class Inputs:
    """Tables of a round.

    ``pages(rule_id, url, page, html)`` are the HTML pages read this time; pages of
    bytes come as ``content, header_charset, forced_charset`` instead of ``html``.
    ``responses(rule_id, url, page, body)`` are the bodies read from JSON sources.
    """

    rules: DataFrame
    pages: DataFrame
    fetch_log: DataFrame
    details: DataFrame | None = None  # (unique_id, main_text)
    ledger: DataFrame | None = None
    run_log: DataFrame | None = None
    responses: DataFrame | None = None


@dataclass(frozen=True)
class Round:
    results: DataFrame
    judged: DataFrame
    relevant: DataFrame
    new_rows: DataFrame
    log_rows: DataFrame
    health: DataFrame | None


KEPT = ["rule_id", "city", "district", "source_name", "category"]
ITEM = ["page", "from_fallback", "title", "url", "publish_date", "position"]


def found_items(inputs: Inputs, rules: DataFrame, failures: DataFrame) -> DataFrame:
    """Items of all sources, each read the way its rule's parser type says.

    HTML pages and the HTML inside JSON bodies go through the listing, plain
    JSON bodies through their paths.
    """
    raw = inputs.pages if "html" in inputs.pages.columns else fetched.decode_pages(inputs.pages)
    pages = fetched.before_failure(raw.select("rule_id", "url", "page", "html"), failures)
    if inputs.responses is None:
        return listing.listing_items(pages, rules).select(*KEPT, *ITEM)
    kind = F.lower(F.coalesce("parser_type", F.lit("html")))
    asked = rules.filter(kind.isin("json", "json_html")).select("rule_id", kind.alias("_kind"), "json_path")
    bodies = fetched.before_failure(inputs.responses, failures).join(F.broadcast(asked), "rule_id")
    inside = fetched.json_html_pages(bodies.filter(F.col("_kind") == "json_html")).select("rule_id", "url", "page", "html")
    plain = fetched.json_items(bodies.filter(F.col("_kind") == "json").drop("_kind")).withColumn("from_fallback", F.lit(False))
    listed = listing.listing_items(pages.unionByName(inside), rules)
    return listed.select(*KEPT, *ITEM).unionByName(plain.join(F.broadcast(rules.select(*KEPT)), "rule_id").select(*KEPT, *ITEM))


def collect(inputs: Inputs) -> DataFrame:
    """Items of the successfully read pages of valid rules, each address once per source."""
    bad = fetched.fetch_outcome(F.col("kind"), F.col("http_status"), F.col("error")).isNotNull()
    # a row per rule: broadcast like the rules, so that no task gets all pages of a source
    failures = F.broadcast(fetched.first_failures(inputs.fetch_log.withColumn("failed", bad)))
    rules = inputs.rules.filter(F.size(fetched.rule_problems(
        F.col("url"), F.col("city"), F.col("source_name"), F.col("parser_type"))) == 0).withColumnRenamed("id", "rule_id")
    items = found_items(inputs, rules, failures).withColumns({
        "target_audience": F.lit(V.AUDIENCE_UNKNOWN), "deadline": F.lit(V.DEADLINE_UNKNOWN),
        **{c: F.lit(None).cast("string") for c in ("amount_or_quota", "age_limit", "apply_channel", "notes")},
        "raw_content": F.lit(""), "detail_fetched": F.lit(False)})
    return first_per_key(with_keys(filters.validated(items)), ["rule_id", "unique_id"], ["page", "position"])


def plan_round(inputs: Inputs, policy: filters.Policy, now: Column, as_baseline: bool = False,
               detail_limit: int | None = None) -> Round:
    """The round as DataFrames; nothing is stored but the items in the shared folder.

    The items feed the source results, the judgement and the ledger, so they
    are written once instead of parsing all pages three times.
    """
    shared_dir(inputs.rules.sparkSession)
    items = collect(inputs).checkpoint()
    results = fetched.source_results(inputs.rules, inputs.fetch_log, items.select(
        "rule_id", "title", F.struct("page", "position").alias("pos")))
    judged = filters.judge(items, policy)
    # titles were cleaned, so their keys are taken again
    relevant = with_title_keys(filters.kept(judged)).withColumn("negative_score", -F.col("relevance_score"))
    if inputs.details is not None:
        relevant = details.enrich_with_details(relevant, inputs.details, "unique_id", detail_limit)
    new_rows = outbox.discover(relevant, inputs.ledger, ORDER, now, as_baseline).drop("negative_score")
    log_rows = health.run_log_rows(results, now)
    log = log_rows if inputs.run_log is None else inputs.run_log.unionByName(log_rows.select(*inputs.run_log.columns))
    report = health.health_report(log) if inputs.run_log is not None else None
    return Round(results, judged, relevant, new_rows, log_rows, report)


def run_round(inputs: Inputs, policy: filters.Policy, now: Column, ledger: BatchLog, run_log: BatchLog | DatedLog, number: int,
              cold_start_baseline: bool = True, outcomes: BatchLog | None = None, detail_limit: int | None = None) -> DataFrame:
    """Run and store a round; returns the delivery queue afterwards.

    The first round of a new ledger is its baseline.  A round that runs again
    under the same number gives the same tables.  Health looks at the run log of
    the earlier rounds, and the queue at the delivery outcomes stored by
    ``record_delivery``.
    """
    known, earlier = ledger.before(number), run_log.before(number)
    planned = plan_round(
        Inputs(inputs.rules, inputs.pages, inputs.fetch_log, inputs.details, known,
               inputs.run_log if earlier is None else earlier, inputs.responses), policy, now,
        as_baseline=known is None and cold_start_baseline, detail_limit=detail_limit)
    ledger.write(planned.new_rows, number)
    run_log.write(planned.log_rows, number)
    return outbox.delivery_queue(current_ledger(ledger, outcomes, number))


def current_ledger(ledger: BatchLog, outcomes: BatchLog | None = None, number: int | None = None) -> DataFrame:
    """The ledger with the delivery outcomes of earlier rounds applied; stored rows are never rewritten."""
    done = None if outcomes is None else outcomes.rows_or_none() if number is None else outcomes.before(number)
    return ledger.rows() if done is None else outbox.apply_attempts(ledger.rows(), done)


def record_delivery(queue: DataFrame, deliveries: DataFrame, outcomes: BatchLog, number: int) -> None:
    """Store what became of a round's queue: ``deliveries(channel_pos, channel, ok, error, at)`` of its channels.

    The queue counts as delivered if one channel took it; without a channel nothing is stored as tried.
    """
    result = outbox.batch_outcome(deliveries.withColumn("batch_id", F.lit(number).cast("long")))
    members = queue.select("unique_id", F.lit(number).cast("long").alias("batch_id"))
    outcomes.write(members.join(result, "batch_id").select(
        "unique_id", F.col("batch_id").alias("seq"), F.col("delivered").alias("ok"), F.col("errors").alias("error"), "at"), number)


def alert_due(run_log: BatchLog | DatedLog, alerts: BatchLog, number: int, now: Column, cooldown_hours: int = V.ALERT_COOLDOWN_HOURS,
              keep_days: int = V.KEEP_LOG_DAYS) -> DataFrame:
    """One row ``(total, broken, due)`` after a round: is an alert to be sent?

    Something is broken and the last delivered alert, the stored clock, is older
    than the cooldown.  Health counts the log within its retention.
    """
    report = health.health_report(health.prune_log(run_log.rows(), now, keep_days))
    summary = health.health_summary(report)
    before = alerts.before(number)
    clock = F.lit(None).cast("timestamp") if before is None else before.filter("delivered").agg(F.max("alert_at")).scalar()
    waited = clock.isNull() | (now.cast("timestamp") > clock + F.make_dt_interval(F.lit(0), F.lit(cooldown_hours)))
    return summary.withColumn("due", (F.col("broken") > 0) & waited)


def record_alert(alerts: BatchLog, number: int, now: Column, delivered: bool) -> None:
    """Store an alert that was tried; only a delivered one starts the cooldown."""
    row = alerts.spark.range(1).select(now.cast("timestamp").alias("alert_at"), F.lit(delivered).alias("delivered"))
    alerts.write(row, number)


def dry_run(inputs: Inputs, policy: filters.Policy, now: Column, detail_limit: int | None = None) -> DataFrame:
    """What a round would keep, best first, without storing anything."""
    judged = filters.judge(collect(inputs), policy)
    relevant = with_title_keys(filters.kept(judged))
    if inputs.details is not None:
        relevant = details.enrich_with_details(relevant, inputs.details, "unique_id", detail_limit)
    return relevant.orderBy(F.desc("relevance_score"), "rule_id", "page", "position")
