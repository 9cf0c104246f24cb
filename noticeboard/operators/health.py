"""Health of sources from the run log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard import fixed_values as V

SOURCE = ["city", "source_name"]
SALTS = 32


def failed() -> Column:
    """A run that did not succeed, or succeeded without finding anything."""
    return (F.col("status") != "SUCCESS") | (F.coalesce("items_found", F.lit(0)) == 0)


def _at() -> Column:
    return F.struct("created_at", "id")


def _since_success(run_log: DataFrame) -> DataFrame:
    """The log with ``_good``, time and id of the source's last useful run."""
    good = run_log.groupBy(*[F.col(c).alias(f"_{c}") for c in SOURCE]).agg(F.max(F.when(~failed(), _at())).alias("_good"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SOURCE]
    return run_log.join(good, same).drop(*[f"_{c}" for c in SOURCE])


def open_runs(run_log: DataFrame) -> DataFrame:
    """The last useful run of every source and all runs after it: what its health depends on."""
    rows = _since_success(run_log).filter(F.col("_good").isNull() | (_at() >= F.col("_good")))
    return rows.select(*run_log.columns)


def latest_runs(run_log: DataFrame, runs: int = V.HEALTH_RUNS, salts: int = SALTS) -> DataFrame:
    """The newest runs of every source with their position ``rn``.

    Two steps: first per source and salt, so a source with a large share of the
    log is spread over tasks and trimmed there, then per source over what is
    left, at most ``runs * salts`` rows.
    """
    newest = [F.desc("created_at"), F.desc("id")]
    salted = run_log.withColumn("_salt", F.pmod(F.hash("id"), F.lit(salts)))
    first = Window.partitionBy(*SOURCE, "_salt").orderBy(*newest)
    second = Window.partitionBy(*SOURCE).orderBy(*newest)
    return (salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= runs)
            .drop("_rn", "_salt")
            .withColumn("rn", F.row_number().over(second)).filter(F.col("rn") <= runs))


def health_report(run_log: DataFrame, broken_streak: int = V.BROKEN_STREAK) -> DataFrame:
    """Per source over the whole log: failures since the last useful run, last run and last useful run.

    Aggregates with a partial step, so a source with a large share of the log is
    no hot spot.
    """
    last = F.max_by(F.struct("status", "error_message", "items_found"), _at())
    return _since_success(run_log).groupBy(*SOURCE).agg(
        F.count_if(F.col("_good").isNull() | (_at() > F.col("_good"))).cast("int").alias("consecutive_failures"),
        last.alias("_last"), F.max("_good.created_at").alias("last_success_at"),
    ).select(
        *SOURCE, "consecutive_failures",
        F.col("_last.status").alias("last_status"), F.col("_last.error_message").alias("last_error"),
        F.coalesce("_last.items_found", F.lit(0)).alias("last_items_found"), "last_success_at",
        (F.col("consecutive_failures") >= broken_streak).alias("is_broken"))


def health_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("total"), F.count_if("is_broken").alias("broken"))


def worst_first(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("consecutive_failures"), *SOURCE)


def prune_log(run_log: DataFrame, now: Column, keep_days: int = V.KEEP_LOG_DAYS) -> DataFrame:
    return run_log.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(keep_days)))


def _segments(rounds: DataFrame, group: list[str], seconds: int) -> DataFrame:
    """The rounds with ``_segment``, a new one after every gap longer than ``seconds``.

    Time is cut into spans of that length: such a gap always lies between the last
    round of one span and the first of a later one, so a row a span tells where
    the segments begin, and only those rows are ordered within their group.
    """
    width = max(seconds, 1)
    span = F.floor(F.col("_s") / width)
    rows = rounds.withColumn("_span", span)
    spans = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in group], F.col("_span").alias("_at")).agg(
        F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    running = Window.partitionBy(*[f"_{c}" for c in group]).orderBy("_at")
    begins = F.coalesce(F.col("_low") - F.lag("_high").over(running) > seconds, F.lit(True))
    spans = spans.withColumn("_begins", begins.cast("int")).withColumn("_segment", F.sum("_begins").over(running))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_span") == F.col("_at")]
    return rows.join(spans.drop("_low", "_high", "_begins"), same).drop("_span", "_at", *[f"_{c}" for c in group])


def alert_rounds(rounds: DataFrame, group: list[str], cooldown_hours: int = V.ALERT_COOLDOWN_HOURS) -> DataFrame:
    """Rounds that send an alert: something is broken and the last delivered alert is older than the cooldown.

    ``rounds(group.., round_at, broken, delivered)`` holds one row per scheduled
    round.  An attempt that no channel delivered does not reset the clock.

    Whether a round alerts depends on the one before, but after a gap longer than
    the cooldown any clock has run out.  So a group is cut at those gaps, and its
    segments are folded by separate tasks, each as an ordered stream of which only
    the clock is kept.  A group broken without such a gap is one segment.
    """
    seconds = cooldown_hours * 3600
    wanted = [*group, "_segment", "_s", "delivered"]
    broken = rounds.filter(F.col("broken") > 0).select(*group, F.unix_timestamp("round_at").alias("_s"), "delivered")
    ordered = _segments(broken, group, seconds).select(*wanted)
    schema = ordered.schema

    def fold(batches):
        key, clock = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in wanted]
            sends = []
            for *at, s, delivered in zip(*columns):
                if at != key:
                    key, clock = at, None
                due = clock is None or s - clock > seconds
                if due and delivered:
                    clock = s
                sends.append(due)
            yield batch.filter(pa.array(sends, pa.bool_()))

    sent = ordered.repartition(*group, "_segment").sortWithinPartitions(*group, "_segment", "_s").mapInArrow(fold, schema)
    return sent.select(*group, F.timestamp_seconds("_s").alias("alert_at"), "delivered")


def run_log_rows(results: DataFrame, now: Column) -> DataFrame:
    """Collector results as run-log rows; the whole error text, '' as NULL."""
    ok = F.col("error").isNull()
    return results.select(
        "id", "source_name", "city", F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(ok, F.coalesce("items_found", F.lit(0))).otherwise(0).alias("items_found"),
        F.nullif("error", F.lit("")).alias("error_message"),
        now.cast("timestamp").alias("created_at"))


def doctor(results: DataFrame) -> DataFrame:
    """Tri-state per source result with a hint, ordered by city and source."""
    state = (F.when(F.col("error").isNotNull(), "failed")
             .when(F.coalesce("items_found", F.lit(0)) == 0, "empty").otherwise("healthy"))
    hint = F.when(state == "empty", V.EMPTY_HINT)
    for kind, text in V.ERROR_HINTS.items():
        hint = hint.when((state == "failed") & (F.col("error_type") == kind), text)
    hint = hint.when(state == "failed", V.ERROR_HINT_DEFAULT)
    return results.select(*SOURCE, state.alias("health"), F.coalesce("items_found", F.lit(0)).alias("items_found"),
                          "sample_title", hint.alias("hint")).orderBy(*SOURCE)
