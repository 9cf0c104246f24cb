"""The ledger as an outbox: discovery, delivery queue, attempts, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import keys
from noticeboard.operators.dedup import greedy_first, not_in_ledger
from noticeboard.session import shared_dir


def discover(notices: DataFrame, ledger: DataFrame | None, order: list[str], now: Column,
             as_baseline: bool = False) -> DataFrame:
    """Rows to add to the ledger: unknown on both keys, first of their kind in this round.

    ``notices`` carries the key columns of ``with_keys``.  The candidates are
    written once to the shared folder, since the rounds of the greedy step and
    the caller's writes all read them.
    """
    shared_dir(notices.sparkSession)
    fresh = (notices if ledger is None else not_in_ledger(notices, ledger)).checkpoint()
    return initial_state(greedy_first(fresh, order), now, as_baseline)


def initial_state(rows: DataFrame, now: Column, as_baseline: bool) -> DataFrame:
    """Baseline rows count as delivered at once, other rows wait for delivery."""
    return rows.withColumns({
        "state": F.lit(V.STATE_BASELINE if as_baseline else V.STATE_PENDING),
        "notify_attempts": F.lit(0),
        "notify_error": F.lit(None).cast("string"),
        "first_seen_at": now.cast("timestamp"),
        "notified_at": now.cast("timestamp") if as_baseline else F.lit(None).cast("timestamp"),
    })


def pending(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.col("state") == V.STATE_PENDING) & (F.col("notify_attempts") < V.MAX_NOTIFY_ATTEMPTS))


def queue_order() -> list[Column]:
    return [F.desc_nulls_last("publish_date"), F.desc("relevance_score"), F.desc("first_seen_at")]


def delivery_queue(ledger: DataFrame, limit: int = V.PUSH_LIMIT) -> DataFrame:
    """The next notices to deliver; unique_id settles what the order leaves open."""
    return pending(ledger).orderBy(*queue_order(), "unique_id").limit(limit)


def batch_outcome(deliveries: DataFrame) -> DataFrame:
    """One row per batch: delivered if any channel was; otherwise the joined errors.

    ``deliveries(batch_id, channel_pos, channel, ok, error, at)`` has one row per
    batch and channel, and channels are few.
    """
    failures = F.transform(
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(
            "channel_pos", F.concat_ws(": ", "channel", F.coalesce("error", F.lit("返回失败"))).alias("text"))))),
        lambda x: x["text"])
    return deliveries.groupBy("batch_id").agg(
        F.bool_or("ok").alias("delivered"), F.max("at").alias("at"),
        F.array_join(failures, "; ").alias("errors"))


def apply_attempts(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """Ledger after delivery attempts ``(unique_id, seq, ok, error, at)`` of one or more rounds.

    The fold over attempts has a closed form, so it is an aggregate with a
    partial step: any success means SENT, failures add up, the last attempt
    decides the error text.  Waiting rows that have used up their attempts are
    abandoned, whether or not they were tried this time.
    """
    folded = attempts.groupBy("unique_id").agg(
        F.bool_or("ok").alias("_sent"),
        F.count_if(~F.col("ok")).cast("int").alias("_failed"),
        F.max_by(F.struct("ok", "error"), "seq").alias("_last"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("_sent_at"))
    joined = ledger.join(folded, "unique_id", "left")
    tries = F.col("notify_attempts") + F.coalesce("_failed", F.lit(0))
    error = (F.when(F.col("_last").isNull(), F.col("notify_error"))
             .when(F.col("_last.ok"), F.lit(None).cast("string"))
             .otherwise(F.coalesce("_last.error", F.lit(""))))
    state = (F.when(F.coalesce("_sent", F.lit(False)), V.STATE_SENT)
             .when((F.col("state") == V.STATE_PENDING) & (tries >= V.MAX_NOTIFY_ATTEMPTS), V.STATE_ABANDONED)
             .otherwise(F.col("state")))
    changed = {"state": state, "notify_attempts": tries, "notify_error": error}
    if "notified_at" in ledger.columns:
        changed["notified_at"] = F.coalesce("_sent_at", "notified_at")
    return joined.withColumns(changed).select(*ledger.columns)


def apply_batch_outcomes(ledger: DataFrame, members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger after whole batches were delivered or not; batches without a channel change nothing."""
    attempts = members.join(outcomes, "batch_id").select(
        "unique_id", F.col("batch_id").alias("seq"), F.col("delivered").alias("ok"),
        F.col("errors").alias("error"), "at")
    return apply_attempts(ledger, attempts)


def run_summary(queue: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: attempted, succeeded, failed, channels that worked or not, why nothing was sent."""
    size = queue.agg(F.count("*").alias("attempted"))

    def names(ok: Column) -> Column:
        hit = F.collect_set(F.when(ok, F.struct("channel_pos", "channel")))
        return F.array_join(F.transform(F.array_sort(hit), lambda x: x["channel"]), ",")

    sent = deliveries.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_ok"),
                          names(F.col("ok")).alias("ok_names"), names(~F.col("ok")).alias("bad_names"))
    tried = (F.col("attempted") > 0) & (F.col("n") > 0)
    return sent.withColumn("attempted", size.scalar()).select(
        "attempted",
        F.when(tried & F.col("any_ok"), F.col("attempted")).otherwise(0).alias("succeeded"),
        F.when(tried & ~F.col("any_ok"), F.col("attempted")).otherwise(0).alias("failed"),
        F.when(tried, F.col("ok_names")).otherwise("").alias("channels_ok"),
        F.when(tried, F.col("bad_names")).otherwise("").alias("channels_failed"),
        F.when(F.col("attempted") == 0, "no_pending").when(F.col("n") == 0, "no_channel").alias("skipped_reason"))


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ledger whose batches were written with fewer or more columns over time.

    The columns of all files are united; where a file lacks one, its rows have NULL
    there, for ``backfill`` to fill in.  Footers are read by tasks.
    """
    return spark.read.option("mergeSchema", "true").parquet(path)


def backfill(ledger: DataFrame, expected: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Add missing columns, fill in defaults and compute missing keys; stored values stay.

    A column with a default has no NULL afterwards: a row older than the column
    reads like one written with the default.
    """
    out = ledger
    for name, kind in expected.items():
        default = F.lit((defaults or {}).get(name)).cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    return out.withColumns({
        "canonical_url": F.coalesce("canonical_url", keys.normalize_url(F.col("url"))),
        "dedup_key": F.coalesce("dedup_key", keys.dedup_key(F.col("city"), F.col("title"))),
    })
