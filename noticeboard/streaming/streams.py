"""Rounds over growing inputs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeboard import fixed_values as V
from noticeboard.functions.keys import with_keys
from noticeboard.operators import health, outbox
from noticeboard.streaming import stateful
from noticeboard.streaming.batch_log import BatchLog


def _start(stream: DataFrame, root: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())


def discover_stream(notices: DataFrame, root: str, order: list[str], now: Callable[[], Column],
                    cold_start_baseline: bool = True) -> StreamingQuery:
    """Add every micro-batch of notices to the ledger below ``root``.

    Rows are never forgotten, so a batch is compared with the ledger itself
    instead of growing operator state.  The first batch of a new ledger is the
    baseline; a restart continues the same ledger.
    """
    ledger = BatchLog(notices.sparkSession, f"{root}/ledger")

    def step(batch: DataFrame, number: int) -> None:
        known = ledger.before(number)
        first = known is None
        found = outbox.discover(with_keys(batch), known, order, now(), as_baseline=first and cold_start_baseline)
        ledger.write(found, number)

    return _start(notices, root, step)


@contextmanager
def _rocks(spark: SparkSession):
    """Stateful processors need the state store on RocksDB; a query keeps the setting it was started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def streak_stream(run_log: DataFrame, root: str, lateness_hours: int = 48) -> StreamingQuery:
    """Keep the health of every source as keyed state; every batch stores the sources it touched below ``root``.

    The state of a source is its streak, its last run and the failures of the last
    ``lateness_hours``; rows may arrive that much late.
    """
    spark = run_log.sparkSession
    out = BatchLog(spark, f"{root}/latest")
    rows = run_log.select(
        *health.SOURCE, F.unix_micros("created_at").alias("run_at"), F.col("id").cast("long").alias("run_id"), health.failed().alias("is_failed"),
        "status", "error_message", F.coalesce("items_found", F.lit(0)).cast("long").alias("items"))
    kind = ", ".join(f"{c} {run_log.schema[c].dataType.simpleString()}" for c in health.SOURCE)
    reports = rows.groupBy(*health.SOURCE).transformWithStateInPandas(
        stateful.Streak(lateness_hours * 3_600_000_000, health.SOURCE), f"{kind}, {stateful.STREAK_OUTPUT}", "Update", "None")
    with _rocks(spark):
        return (reports.writeStream.outputMode("update").foreachBatch(out.write).option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start())


def streak_report(spark, root: str, broken_streak: int = V.BROKEN_STREAK) -> DataFrame:
    """Health report from the newest row of every source."""
    rows = spark.read.parquet(f"{root}/latest")
    rest = [c for c in rows.columns if c not in (*health.SOURCE, "batch")]
    newest = rows.groupBy(*health.SOURCE).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*health.SOURCE, "_r.*")
    return newest.select(
        *health.SOURCE, F.col("consecutive_failures").cast("int").alias("consecutive_failures"), "last_status", "last_error",
        F.col("last_items_found").cast("int").alias("last_items_found"), F.timestamp_micros("last_success_us").alias("last_success_at"),
        (F.col("consecutive_failures") >= broken_streak).alias("is_broken"))


def attempt_fold(attempts: DataFrame) -> DataFrame:
    """Running outcome per notice of a stream of delivery attempts, for update or complete mode.

    Success, failures and the last attempt are aggregates with a partial step,
    so a notice with very many attempts is no hot spot.
    """
    return attempts.groupBy("unique_id").agg(
        F.bool_or("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), "seq").alias("last_error"))


def alert_stream(seen: DataFrame, root: str, group: list[str], cooldown_hours: int = V.ALERT_COOLDOWN_HOURS,
                 round_seconds: int = 3600, lateness: str = "1 hour") -> StreamingQuery:
    """Rounds that send an alert, each stored once below ``root`` in the batch that closed it.

    ``seen(group.., at, broken, delivered)`` are parts of rounds: a round of a group
    covers ``round_seconds``, sums up what was broken, and counts as delivered if one
    part was.  It is over once the watermark, ``lateness`` behind the newest ``at``,
    has passed its end; what arrives later is dropped.
    """
    spark = seen.sparkSession
    sent = BatchLog(spark, f"{root}/alerts")
    at = F.unix_timestamp("at")
    parts = seen.withWatermark("at", lateness).select(
        *group, "at", (at - F.pmod(at, F.lit(round_seconds))).alias("round_start"), F.col("broken").cast("long").alias("broken"),
        F.coalesce("delivered", F.lit(False)).alias("delivered"))
    kind = ", ".join(f"{c} {seen.schema[c].dataType.simpleString()}" for c in group)
    alerts = parts.groupBy(*group).transformWithStateInPandas(
        stateful.Cooldown(cooldown_hours * 3600, round_seconds, group), f"{kind}, round_start long, delivered boolean", "Append", "EventTime")

    def step(batch: DataFrame, number: int) -> None:
        sent.write(batch.select(*group, F.timestamp_seconds("round_start").alias("alert_at"), "delivered"), number)

    with _rocks(spark):
        return (alerts.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start())
