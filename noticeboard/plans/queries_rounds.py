"""Queries for whole rounds, sinks and streams."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.keys import unique_id
from noticeboard.functions.urls import resolve_url
from noticeboard.operators import health, outbox
from noticeboard.plans import bindings as B
from noticeboard.plans import round as rounds
from noticeboard.plans.queries_health import LATEST_SQL, ROUNDS_SQL
from noticeboard.plans.queries_ledger import ATTEMPTS_SQL, KEYED_SQL, NOW_TEXT, attempts, greedy_sql, keyed, ledger, now
from noticeboard.plans.queries_notices import POLICY, sql_clean_title, sql_norm_title, sql_refine, sql_score, sql_url
from noticeboard.plans.queries_sources import LISTING_SQL, listing_pages, listing_rows
from noticeboard.plans.registry import query
from noticeboard.session import scratch_path
from noticeboard.streaming import streams
from noticeboard.streaming.batch_log import BatchLog
from noticeboard.streaming.dated_log import DatedLog

# --- full round over the listing pages made of orders ---------------------------------
TODAY = "2019-06-30"
ROUND_POLICY = type(POLICY)(today=TODAY, lexicon=POLICY.lexicon, max_age_days=1500)


def round_inputs(spark, sf) -> rounds.Inputs:
    pages = listing_pages(spark, sf)
    rules = spark.createDataFrame(
        [("r0", "深圳", "全市", "住房保障中心", "housing", "https://gov.example.org", "html", ("ul.news-list li", "a", "a", "span.date")),
         ("r1", "北京", "全市", "人社局", "subsidy", "https://gov.example.org", "html", ("table.list tr", "a", "a", None)),
         ("r2", "", "全市", "政府网", "other", "gov", "html", ("ul.missing li", "a", "a", "span"))],
        "id string, city string, district string, source_name string, category string, url string, parser_type string, "
        "selectors struct<list_item:string,title:string,link:string,date:string>")
    # every page of a rule is numbered; pages from 900 on of the second rule were not reached
    pages = pages.withColumn("page", (F.floor(F.col("page_no") / 3) + 1).cast("int"))
    log = pages.select(
        "rule_id", "page", "url", F.lit("html").alias("kind"),
        F.when((F.col("rule_id") == "r1") & (F.col("page") == 90), 404).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"))
    return rounds.Inputs(rules=rules, pages=pages, fetch_log=log)


_CASE = "CASE kind WHEN 0 THEN {0} ELSE {1} END"
ROUND_SQL = LISTING_SQL + f""",
items AS (SELECT o_orderkey, page_no, trim(title) AS title, url, publish_date, kind, {_CASE.format("'深圳'", "'北京'")} AS city,
    {_CASE.format("'housing'", "'subsidy'")} AS category, {_CASE.format("'住房保障中心'", "'人社局'")} AS source_name
  FROM listed WHERE kind = 0 OR (kind = 1 AND page_no // 3 + 1 < 90)),
cleaned AS (SELECT *, {sql_clean_title('title')} AS title_clean FROM items),
scored AS (SELECT *, {sql_score('title_clean', 'category', 'source_name')} AS score,
    list_filter({B.sql_list(list(POLICY.lexicon.blocklist))}, lambda t: contains(title_clean, t))[1] AS blocked FROM cleaned),
relevant AS (SELECT *, {sql_refine('title_clean', 'category')} AS refined FROM scored WHERE blocked IS NULL AND score >= 2.5
  AND coalesce(datediff('day', CAST(publish_date AS DATE), DATE '{TODAY}') <= 1500, true))"""


@query("i9_full_round", f"WITH {ROUND_SQL} SELECT title_clean AS title, url, city, refined AS category, publish_date, round(score, 6) AS relevance_score, 0 AS state FROM relevant")
def i9(spark, sf):
    done = rounds.plan_round(round_inputs(spark, sf), ROUND_POLICY, now())
    return done.new_rows.select("title", "url", "city", "category", "publish_date", F.round("relevance_score", 6).alias("relevance_score"), "state")


@query("i9_second_round", f"""WITH {ROUND_SQL} SELECT title_clean AS title, url, city, refined AS category, publish_date, round(score, 6) AS relevance_score
FROM relevant WHERE page_no // 3 + 1 > 12""")
def i9_second(spark, sf):
    """The first round has read twelve pages of every rule; the second one finds the rest."""
    every = round_inputs(spark, sf)
    ledger, log = (BatchLog(spark, scratch_path(spark, name)) for name in ("ledger", "run_log"))
    early = F.col("page") <= 12
    first = rounds.Inputs(every.rules, every.pages.filter(early), every.fetch_log.filter(early))
    rounds.run_round(first, ROUND_POLICY, now(), ledger, log, 0)
    rounds.run_round(every, ROUND_POLICY, now(), ledger, log, 1)
    return ledger.only(1).select("title", "url", "city", "category", "publish_date", F.round("relevance_score", 6).alias("relevance_score"))


# --- rounds with every kind of input, deliveries, retention and alerts -------------------
DETAIL = "经研究，现将有关事项公告如下，请符合条件的单位和个人按要求准备材料并提交申请，报名不得晚于2025年4月6日，逾期不再受理。"
FULL_RULE = ("id string, city string, district string, source_name string, category string, url string, parser_type string, "
             "selectors struct<list_item:string,title:string,link:string,date:string>, "
             "json_path struct<list:string,title:string,link:string,date:string,html:string>")
LAST_PAGE, KEEP_DAYS = 12, 60


def every_input(spark, sf) -> rounds.Inputs:
    """HTML pages, the same kind of pages inside JSON bodies, JSON listings, and details of every second notice."""
    shown = listing_pages(spark, sf).withColumn("page", (F.floor(F.col("page_no") / 3) + 1).cast("int"))
    inside = shown.filter("rule_id = 'r1'").select(
        F.lit("x1").alias("rule_id"), "url", "page", F.to_json(F.struct(F.struct("html").alias("data"))).alias("body"))
    number = F.col("page_no").cast("string")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "title", "href", "day"))), lambda x: F.struct(
        x["title"].alias("name"), x["href"].alias("link"), x["day"].alias("pubDate")))
    plain = listing_rows(spark, sf).filter("kind = 2").groupBy("page_no").agg(F.to_json(F.struct(rows.alias("rows"))).alias("body")).select(
        F.lit("j2").alias("rule_id"), F.concat(F.lit("https://gov"), number, F.lit(".example.org/list/a/api")).alias("url"),
        (F.floor(F.col("page_no") / 3) + 1).cast("int").alias("page"), "body")
    pages, bodies = shown.filter("rule_id = 'r0'").select("rule_id", "url", "page", "html"), inside.unionByName(plain)
    rules = spark.createDataFrame(
        [("r0", "深圳", "全市", "住房保障中心", "housing", "https://gov.example.org", "html", ("ul.news-list li", "a", "a", "span.date"), None),
         ("x1", "北京", "全市", "人社局", "subsidy", "https://gov.example.org", "json_html", ("table.list tr", "a", "a", None), None),
         ("j2", "上海", "全市", "人社局", "employment", "https://gov.example.org", "json", None, ("rows", "name", "link", "pubDate", None)),
         ("b3", "广州", "全市", "政府网", "other", "gov", "html", None, None)], FULL_RULE)
    log = pages.select("rule_id", "page", F.lit("html").alias("kind")).unionByName(
        bodies.select("rule_id", "page", F.when(F.col("rule_id") == "x1", "json_html").otherwise("json").alias("kind")))
    log = log.withColumns({"http_status": F.when((F.col("rule_id") == "x1") & (F.col("page") == 90), 500).otherwise(200),
                           "error": F.lit(None).cast("string")})
    seen = listing_rows(spark, sf).filter(F.col("o_orderkey") % 2 == 0)
    address = resolve_url(F.concat(F.lit("https://gov"), number, F.lit(".example.org/list/a/api")), F.col("href"))
    texts = seen.withColumn("address", address).select(unique_id(F.col("address")).alias("unique_id"), F.lit(DETAIL).alias("main_text"))
    return rounds.Inputs(rules, pages, log, details=texts, responses=bodies)


def until(inputs: rounds.Inputs, page: int) -> rounds.Inputs:
    read = F.col("page") <= page
    return replace(inputs, pages=inputs.pages.filter(read), fetch_log=inputs.fetch_log.filter(read), responses=inputs.responses.filter(read))


_KINDS = "CASE kind WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
_QUEUE = "ORDER BY publish_date DESC NULLS LAST, score DESC, seen DESC, uid LIMIT 30"
EVERY_SQL = LISTING_SQL + f""",
found AS (SELECT o_orderkey, page_no, kind, title, url, publish_date FROM listed WHERE kind = 0 OR (kind = 1 AND page_no // 3 + 1 < 90)
  UNION ALL SELECT o_orderkey, page_no, kind, title, CASE WHEN o_orderkey % 10 = 3 THEN 'javascript:void(0)'
    WHEN o_orderkey % 10 = 5 THEN 'https://gov' || page_no || '.example.org/f/' || o_orderkey || '.PDF?x=1' ELSE url END AS url, publish_date
  FROM listing_rows WHERE kind = 2 AND o_orderkey % 10 <> 7
    AND (o_orderkey % 10 <> 3 OR o_orderkey = (SELECT min(o_orderkey) FROM listing_rows WHERE kind = 2 AND o_orderkey % 10 = 3))),
items AS (SELECT *, {_KINDS.format("'深圳'", "'北京'", "'上海'")} AS city, {_KINDS.format("'housing'", "'subsidy'", "'employment'")} AS category,
    {_KINDS.format("'住房保障中心'", "'人社局'", "'人社局'")} AS source_name FROM found),
cleaned AS (SELECT *, {sql_clean_title('title')} AS title_clean FROM items),
scored AS (SELECT *, {sql_score('title_clean', 'category', 'source_name')} AS score,
    list_filter({B.sql_list(list(POLICY.lexicon.blocklist))}, lambda t: contains(title_clean, t))[1] AS blocked FROM cleaned),
relevant AS MATERIALIZED (SELECT *, {sql_refine('title_clean', 'category')} AS refined, md5({sql_url('url')}) AS uid,
    CASE WHEN page_no // 3 + 1 <= {LAST_PAGE} THEN 0 ELSE 1 END AS seen
  FROM scored WHERE blocked IS NULL AND score >= 2.5 AND coalesce(datediff('day', CAST(publish_date AS DATE), DATE '{TODAY}') <= 1500, true)),
first AS (SELECT o_orderkey FROM relevant WHERE seen = 0 {_QUEUE}),
second AS (SELECT o_orderkey FROM relevant {_QUEUE}),
{LATEST_SQL.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-16 08:00:00')")}"""


@query("i9_every_input", f"""WITH {EVERY_SQL} SELECT title_clean AS title, url, city, refined AS category, publish_date,
  round(score, 6) AS relevance_score, CASE WHEN o_orderkey IN (FROM second) THEN 1 ELSE 0 END AS state,
  CASE WHEN o_orderkey IN (FROM first) THEN 1 ELSE 0 END AS notify_attempts,
  o_orderkey % 2 = 0 AS detail_fetched, CASE WHEN o_orderkey % 2 = 0 THEN '2025-04-06 截止' ELSE '{V.DEADLINE_UNKNOWN}' END AS deadline,
  (SELECT count(*) FROM report) + 4 AS sources, (SELECT count(*) FROM report WHERE consecutive_failures >= 3) AS broken,
  (SELECT count(*) FROM report WHERE consecutive_failures >= 3) > 0 AS alert_due FROM relevant""")
def i9_every(spark, sf):
    """Two rounds, the second one reads further: its delivery works after the first one failed.

    The run log holds earlier runs, of which retention leaves sixty days; their
    broken sources make an alert due.
    """
    inputs, texts = every_input(spark, sf), scratch_path(spark, "details")
    inputs.details.write.parquet(texts)     # both rounds read them
    inputs = replace(inputs, details=spark.read.parquet(texts))
    ledger, outcomes, alerts = (BatchLog(spark, scratch_path(spark, name)) for name in ("ledger", "outcomes", "alerts"))
    log = DatedLog(spark, scratch_path(spark, "run_log"))
    log.write(B.run_log(spark, sf).withColumns({"id": F.col("id").cast("string"), "items_found": F.col("items_found").cast("long")}), 0)
    for n, read in ((1, until(inputs, LAST_PAGE)), (2, inputs)):
        at = F.to_timestamp(F.lit(NOW_TEXT)) + F.make_dt_interval(F.lit(n - 1))
        queue = rounds.run_round(read, ROUND_POLICY, at, ledger, log, n, cold_start_baseline=False, outcomes=outcomes)
        sent = spark.range(2).select(
            F.col("id").cast("int").alias("channel_pos"), F.when(F.col("id") == 0, "mail").otherwise("hook").alias("channel"),
            ((F.col("id") == 1) & F.lit(n == 2)).alias("ok"), F.lit("down").alias("error"), at.alias("at"))
        rounds.record_delivery(queue, sent, outcomes, n)
        log.prune(dt.datetime.fromisoformat(NOW_TEXT) + dt.timedelta(days=n - 1), KEEP_DAYS)
        log.merge(n - 1)
    due = rounds.alert_due(log, alerts, n, at, keep_days=KEEP_DAYS)
    return rounds.current_ledger(ledger, outcomes).select(
        "title", "url", "city", "category", "publish_date", F.round("relevance_score", 6).alias("relevance_score"), "state",
        "notify_attempts", "detail_fetched", "deadline", due.select("total").scalar().alias("sources"),
        due.select("broken").scalar().alias("broken"), due.select("due").scalar().alias("alert_due"))


@query("i10_dry_run", f"WITH {ROUND_SQL} SELECT title_clean AS title, url, round(score, 6) AS relevance_score FROM relevant")
def i10(spark, sf):
    return rounds.dry_run(round_inputs(spark, sf), ROUND_POLICY, now()).select(
        "title", "url", F.round("relevance_score", 6).alias("relevance_score"))


# --- sinks ------------------------------------------------------------------------------
@query("s15_append_to_ledger", f"""WITH RECURSIVE {KEYED_SQL}, {greedy_sql('fresh')}
SELECT notice_id, unique_id FROM ledger UNION ALL SELECT f.notice_id, f.unique_id FROM walk JOIN fresh f ON f.notice_id = walk.kept""")
def s15(spark, sf):
    log = BatchLog(spark, scratch_path(spark, "ledger"))
    log.write(outbox.initial_state(ledger(spark, sf), now(), True), 0)
    log.write(outbox.discover(keyed(spark, sf), log.before(1), ["notice_id"], now()), 1)
    return log.rows().select("notice_id", "unique_id")


# --- streams -------------------------------------------------------------------------------
def _stream(spark, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a pattern, since the table is a single file and a stream reads folders
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


@query("i1_stream_discover", f"""WITH RECURSIVE {KEYED_SQL}, {greedy_sql('keyed')}
SELECT k.notice_id, k.unique_id, 2 AS state FROM walk JOIN keyed k ON k.notice_id = walk.kept""")
def i1_stream(spark, sf):
    root = scratch_path(spark, "discover")
    notices = B.notices_from(_stream(spark, sf, "documents"))
    streams.discover_stream(notices, root, ["notice_id"], now).awaitTermination()
    return BatchLog(spark, f"{root}/ledger").rows().select("notice_id", "unique_id", "state")


@query("i5_stream_streaks", f"WITH {LATEST_SQL} SELECT city, source_name, consecutive_failures, last_status, last_success_at FROM report")
def i5_stream(spark, sf):
    root = scratch_path(spark, "streaks")
    streams.streak_stream(B.run_log_from(_stream(spark, sf, "events")), root).awaitTermination()
    return streams.streak_report(spark, root).select(
        "city", "source_name", "consecutive_failures", "last_status", F.col("last_success_at").cast("string").alias("last_success_at"))


SEEN_SQL = ROUNDS_SQL.replace("min(id) % 3 <> 0 AS delivered", "bool_or(id % 3 <> 0) AS delivered").replace(
    "WHERE broken > 0)", "WHERE broken > 0 AND epoch_ms(round_at) + 3600000 <= (SELECT max(epoch_ms(created_at)) FROM run_log))")


def seen_runs(run_log: DataFrame) -> DataFrame:
    """Every run as a part of its city's round."""
    return run_log.select("city", F.col("created_at").alias("at"), (F.col("status") == "FAILED").cast("int").alias("broken"),
                          (F.col("id") % 3 != 0).alias("delivered"))


@query("i6_stream_alerts", f"WITH RECURSIVE {SEEN_SQL} SELECT city, s AS alert_at, delivered FROM walk WHERE sent")
def i6_stream(spark, sf):
    """The alerts of all rounds that are over when the stream has been read."""
    root = scratch_path(spark, "alerts")
    streams.alert_stream(seen_runs(B.run_log_from(_stream(spark, sf, "events"))), root, ["city"], lateness="0 seconds").awaitTermination()
    return BatchLog(spark, f"{root}/alerts").rows().select("city", F.unix_timestamp("alert_at").alias("alert_at"), "delivered")


@query("i3_stream_attempts", f"""WITH {ATTEMPTS_SQL} SELECT unique_id, sent, failed,
  CASE WHEN last_ok THEN NULL ELSE last_error END AS last_error FROM folded""")
def i3_stream(spark, sf):
    root = scratch_path(spark, "attempts")
    attempts(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    out = BatchLog(spark, f"{root}/out")
    q = (streams.attempt_fold(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: out.write(df, 0))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out.rows().select("unique_id", "sent", "failed", "last_error")
