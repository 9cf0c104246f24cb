"""Queries over the run log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.operators import health, reports
from noticeboard.plans import bindings as B
from noticeboard.plans.queries_ledger import STATES_SQL, STATS_DAY
from noticeboard.plans.registry import query
from noticeboard.session import scratch_path
from noticeboard.streaming.dated_log import DatedLog

LATEST_SQL = B.RUN_LOG_SQL + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY city, source_name ORDER BY created_at DESC, id DESC) AS rn FROM run_log),
latest AS (SELECT *, (status <> 'SUCCESS' OR coalesce(items_found, 0) = 0) AS bad FROM numbered WHERE rn <= {V.HEALTH_RUNS}),
whole AS (SELECT *, (status <> 'SUCCESS' OR coalesce(items_found, 0) = 0) AS bad FROM numbered),
report AS (
  SELECT city, source_name, coalesce(min(rn) FILTER (NOT bad) - 1, count(*)) AS consecutive_failures,
    max(status) FILTER (rn = 1) AS last_status, max(error_message) FILTER (rn = 1) AS last_error,
    max(items_found) FILTER (rn = 1) AS last_items_found, CAST(max(created_at) FILTER (NOT bad) AS VARCHAR) AS last_success_at
  FROM whole GROUP BY 1, 2)"""


@query("w1_latest_runs", f"WITH {LATEST_SQL} SELECT id, city, source_name, rn FROM latest")
def w1(spark, sf):
    return health.latest_runs(B.run_log(spark, sf)).select("id", "city", "source_name", "rn")


@query("a7_health_report", f"""WITH {LATEST_SQL} SELECT city, source_name, consecutive_failures, last_status, last_error,
  last_items_found, last_success_at, consecutive_failures >= 3 AS is_broken FROM report""")
def a7(spark, sf):
    return health.health_report(B.run_log(spark, sf)).withColumn(
        "last_success_at", F.col("last_success_at").cast("string"))


@query("a8_health_summary", f"WITH {LATEST_SQL} SELECT count(*) AS total, count(*) FILTER (consecutive_failures >= 3) AS broken FROM report")
def a8(spark, sf):
    return health.health_summary(health.health_report(B.run_log(spark, sf)))


@query("t3_health_order", f"""WITH {LATEST_SQL} SELECT city, source_name, consecutive_failures FROM report
ORDER BY consecutive_failures DESC, city, source_name""")
def t3(spark, sf):
    return health.worst_first(health.health_report(B.run_log(spark, sf))).select("city", "source_name", "consecutive_failures")


@query("a6_dashboard", f"""WITH {LATEST_SQL}, {B.OUTBOX_SQL} SELECT count(*) AS total_policies, count(DISTINCT city) AS active_cities,
  count(*) FILTER (CAST(first_seen_at AS DATE) = DATE '{STATS_DAY}') AS today_count, {STATES_SQL},
  (SELECT count(*) FROM supplier) AS total_rules, (SELECT count(*) FROM report WHERE consecutive_failures >= 3) AS broken_sources,
  CASE WHEN (SELECT count(*) FROM report WHERE consecutive_failures >= 3) = 0 THEN 'Healthy' ELSE 'Degraded' END AS status FROM outbox""")
def a6(spark, sf):
    return reports.dashboard(B.outbox(spark, sf), B.table(spark, sf, "supplier"),
                             health.health_report(B.run_log(spark, sf)), F.lit(STATS_DAY).cast("date"))


ROUNDS_SQL = B.RUN_LOG_SQL + """,
rounds AS (SELECT city, date_trunc('hour', created_at) AS round_at, count(*) FILTER (status = 'FAILED') AS broken,
    min(id) % 3 <> 0 AS delivered FROM run_log GROUP BY 1, 2),
numbered AS MATERIALIZED (SELECT *, CAST(epoch(round_at) AS BIGINT) AS s, row_number() OVER (PARTITION BY city ORDER BY round_at) AS rn FROM rounds WHERE broken > 0),
walk AS (
  SELECT DISTINCT city, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS clock, false AS sent, CAST(NULL AS BIGINT) AS s, false AS delivered FROM numbered
  UNION ALL
  SELECT n.city, n.rn, CASE WHEN (w.clock IS NULL OR n.s - w.clock > 86400) AND n.delivered THEN n.s ELSE w.clock END,
    w.clock IS NULL OR n.s - w.clock > 86400, n.s, n.delivered
  FROM walk w JOIN numbered n ON n.city = w.city AND n.rn = w.rn + 1)"""


def rounds(spark, sf) -> DataFrame:
    return B.run_log(spark, sf).groupBy("city", F.date_trunc("hour", "created_at").alias("round_at")).agg(
        F.count_if(F.col("status") == "FAILED").alias("broken"), (F.min("id") % 3 != 0).alias("delivered"))


@query("i6_alert_gate", f"WITH RECURSIVE {ROUNDS_SQL} SELECT city, s AS alert_at, delivered FROM walk WHERE sent")
def i6(spark, sf):
    return health.alert_rounds(rounds(spark, sf), ["city"]).select(
        "city", F.unix_timestamp("alert_at").alias("alert_at"), "delivered")


@query("i7_log_retention", f"WITH {B.RUN_LOG_SQL} SELECT id FROM run_log WHERE created_at >= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY")
def i7(spark, sf):
    return health.prune_log(B.run_log(spark, sf), F.to_timestamp(F.lit("2024-02-10 12:00:00"))).select("id")


@query("i7_dated_log", f"WITH {B.RUN_LOG_SQL} SELECT id, status, created_at FROM run_log WHERE CAST(created_at AS DATE) >= DATE '2024-01-21'")
def i7_dated(spark, sf):
    """The run log stored in three batches, merged and pruned twice; old days are gone as partitions."""
    log, runs = DatedLog(spark, scratch_path(spark, "dated")), B.run_log(spark, sf)
    for n in range(3):
        log.write(runs.filter(F.col("id") % 3 == n), n)
        log.merge(n - 1)
    for day in (11, 21):
        log.keep_from(dt.date(2024, 1, day))
    return log.rows().select("id", "status", "created_at")


RESULTS_SQL = """
results AS (SELECT event_id AS id, 'source ' || user_id AS source_name, 'city ' || (user_id % 12) AS city,
    CASE WHEN event_type = 'error' THEN repeat(props || ' ', 1 + event_id % 60) WHEN event_type = 'view' AND event_id % 5 = 0 THEN '' END AS error,
    CASE event_id % 4 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'BAD_RULE' ELSE 'ERROR' END AS error_type,
    CAST(floor(value) AS BIGINT) AS items_found, 'sample ' || event_id AS sample_title FROM events)"""


def results(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return B.table(spark, sf, "events").select(
        i.alias("id"), F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("source_name"),
        F.concat(F.lit("city "), (F.col("user_id") % 12).cast("string")).alias("city"),
        F.when(F.col("event_type") == "error", F.repeat(F.concat("props", F.lit(" ")), (1 + i % 60).cast("int")))
         .when((F.col("event_type") == "view") & (i % 5 == 0), "").alias("error"),
        F.when(i % 4 == 0, "NOT_FOUND").when(i % 4 == 1, "BLOCKED").when(i % 4 == 2, "BAD_RULE").otherwise("ERROR").alias("error_type"),
        F.floor("value").alias("items_found"), F.concat(F.lit("sample "), i.cast("string")).alias("sample_title"))


@query("s16_run_log_rows", f"""WITH {RESULTS_SQL} SELECT id, source_name, city, CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN error IS NULL THEN items_found ELSE 0 END AS items_found, nullif(error, '') AS error_message FROM results""")
def s16(spark, sf):
    return health.run_log_rows(results(spark, sf), F.to_timestamp(F.lit("2024-03-15 08:00:00"))).drop("created_at")


@query("a9_doctor", f"""WITH {RESULTS_SQL} SELECT city, source_name, items_found, sample_title,
  CASE WHEN error IS NOT NULL THEN 'failed' WHEN items_found = 0 THEN 'empty' ELSE 'healthy' END AS health,
  CASE WHEN error IS NULL THEN CASE WHEN items_found = 0 THEN '{V.EMPTY_HINT}' END
    WHEN error_type = 'NOT_FOUND' THEN '{V.ERROR_HINTS['NOT_FOUND']}' WHEN error_type = 'BLOCKED' THEN '{V.ERROR_HINTS['BLOCKED']}'
    WHEN error_type = 'BAD_RULE' THEN '{V.ERROR_HINTS['BAD_RULE']}' ELSE '{V.ERROR_HINT_DEFAULT}' END AS hint FROM results""")
def a9(spark, sf):
    return health.doctor(results(spark, sf))
