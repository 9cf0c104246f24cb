"""Queries over the ledger: two-key dedup, discovery, outbox, queue, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.keys import to_brief, with_keys
from noticeboard.operators import dedup, filters, outbox, reports
from noticeboard.plans import bindings as B
from noticeboard.plans.queries_notices import sql_norm_title, sql_url
from noticeboard.plans.registry import query
from noticeboard.session import scratch_path

NOW_TEXT = "2024-03-15 08:00:00"

KEYED_SQL = B.NOTICES_SQL + f""",
keyed AS MATERIALIZED (
  SELECT notice_id, title, url, city, md5({sql_url('url')}) AS unique_id,
    md5(city || '|' || {sql_norm_title('title')}) AS dedup_key FROM notices),
ledger AS MATERIALIZED (SELECT * FROM keyed WHERE notice_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
fresh AS MATERIALIZED (
  SELECT * FROM keyed WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.unique_id = keyed.unique_id)
    AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.dedup_key = keyed.dedup_key))"""


def greedy_sql(source: str) -> str:
    return f"""
ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY notice_id) AS rn, notice_id, unique_id, dedup_key FROM {source}),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ds, CAST(NULL AS BIGINT) AS kept
  UNION ALL
  SELECT o.rn,
    CASE WHEN list_contains(w.us, o.unique_id) OR list_contains(w.ds, o.dedup_key) THEN w.us ELSE list_append(w.us, o.unique_id) END,
    CASE WHEN list_contains(w.us, o.unique_id) OR list_contains(w.ds, o.dedup_key) THEN w.ds ELSE list_append(w.ds, o.dedup_key) END,
    CASE WHEN list_contains(w.us, o.unique_id) OR list_contains(w.ds, o.dedup_key) THEN NULL ELSE o.notice_id END
  FROM walk w JOIN ordered o ON o.rn = w.rn + 1)"""


def now():
    return F.to_timestamp(F.lit(NOW_TEXT))


def keyed(spark, sf) -> DataFrame:
    return with_keys(B.notices(spark, sf))


def ledger(spark, sf) -> DataFrame:
    known = B.table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("notice_id"))
    return keyed(spark, sf).join(known, "notice_id", "left_semi")


@query("j1_ledger_anti_join", f"WITH {KEYED_SQL} SELECT notice_id, unique_id, dedup_key FROM fresh")
def j1(spark, sf):
    return dedup.not_in_ledger(keyed(spark, sf), ledger(spark, sf)).select("notice_id", "unique_id", "dedup_key")


@query("j1_bucketed_ledger", f"WITH {KEYED_SQL} SELECT notice_id, unique_id, dedup_key FROM fresh")
def j1_bucketed(spark, sf):
    """The ledger is entered in two batches and then stays where it lies."""
    index, known = dedup.KeyIndex(spark, scratch_path(spark, "ledger-keys")), ledger(spark, sf)
    for part in (0, 1):
        index.add(known.filter(F.col("notice_id") % 2 == part))
    return index.unknown(keyed(spark, sf)).select("notice_id", "unique_id", "dedup_key")


@query("u2_new_minus_known", f"WITH {KEYED_SQL} SELECT count(*) AS new_rows FROM fresh")
def u2(spark, sf):
    return dedup.not_in_ledger(keyed(spark, sf), ledger(spark, sf)).agg(F.count("*").alias("new_rows"))


@query("u3_greedy_two_key_dedup",
       f"WITH RECURSIVE {KEYED_SQL}, {greedy_sql('keyed')} SELECT kept AS notice_id FROM walk WHERE kept IS NOT NULL")
def u3(spark, sf):
    rows = keyed(spark, sf).select("notice_id", "unique_id", "dedup_key")
    return dedup.greedy_first(rows, ["notice_id"]).select("notice_id")


@query("i1_discover_new", f"""WITH RECURSIVE {KEYED_SQL}, {greedy_sql('fresh')}
SELECT f.notice_id, f.unique_id, 0 AS state, CAST(TIMESTAMP '{NOW_TEXT}' AS VARCHAR) AS first_seen_at
FROM walk JOIN fresh f ON f.notice_id = walk.kept""")
def i1(spark, sf):
    found = outbox.discover(keyed(spark, sf), ledger(spark, sf), ["notice_id"], now())
    return found.select("notice_id", "unique_id", "state", F.col("first_seen_at").cast("string").alias("first_seen_at"))


@query("i2_cold_start_baseline", f"""WITH RECURSIVE {KEYED_SQL}, {greedy_sql('keyed')}
SELECT k.notice_id, 2 AS state, '{NOW_TEXT}' AS notified_at FROM walk JOIN keyed k ON k.notice_id = walk.kept""")
def i2(spark, sf):
    found = outbox.discover(keyed(spark, sf), None, ["notice_id"], now(), as_baseline=True)
    return found.select("notice_id", "state", F.col("notified_at").cast("string").alias("notified_at"))


# --- outbox --------------------------------------------------------------------
ATTEMPTS_SQL = B.OUTBOX_SQL + """,
attempts AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS unique_id, l_linenumber AS seq,
    bool_or(l_returnflag = 'N' AND l_quantity > 40) AS ok, 'error ' || max(l_partkey) AS error, max(l_shipdate) AS at
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
folded AS (
  SELECT unique_id, bool_or(ok) AS sent, count(*) FILTER (NOT ok) AS failed, arg_max(ok, seq) AS last_ok,
    arg_max(error, seq) AS last_error FROM attempts GROUP BY 1)"""


def attempts(spark, sf) -> DataFrame:
    return B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.bool_or((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)).alias("ok"),
        F.concat(F.lit("error "), F.max("l_partkey").cast("string")).alias("error"),
        F.max("l_shipdate").alias("at"),
    ).select(F.md5(F.col("l_orderkey").cast("string")).alias("unique_id"), F.col("l_linenumber").alias("seq"),
             "ok", "error", F.col("at").cast("timestamp").alias("at"))


@query("i3_outbox_state_machine", f"""WITH {ATTEMPTS_SQL}
SELECT notice_id,
  CASE WHEN coalesce(sent, false) THEN 1 WHEN state = 0 AND notify_attempts + coalesce(failed, 0) >= 5 THEN 3 ELSE state END AS state,
  notify_attempts + coalesce(failed, 0) AS notify_attempts,
  CASE WHEN last_ok IS NULL OR last_ok THEN NULL ELSE last_error END AS notify_error
FROM outbox LEFT JOIN folded USING (unique_id)""")
def i3(spark, sf):
    return outbox.apply_attempts(B.outbox(spark, sf), attempts(spark, sf)).select(
        "notice_id", "state", F.col("notify_attempts").cast("bigint").alias("notify_attempts"), "notify_error")


DELIVERIES_SQL = B.OUTBOX_SQL + """,
deliveries AS (
  SELECT l_orderkey // 30 AS batch_id, l_linenumber AS channel_pos, 'channel ' || l_linenumber AS channel,
    bool_or(l_returnflag = 'N' AND l_quantity >= 50) AS ok, 'error ' || max(l_partkey) AS error, max(l_shipdate) AS at
  FROM lineitem GROUP BY 1, 2, 3),
outcomes AS (
  SELECT batch_id, bool_or(ok) AS delivered,
    coalesce(string_agg(channel || ': ' || error, '; ' ORDER BY channel_pos) FILTER (NOT ok), '') AS errors
  FROM deliveries GROUP BY 1)"""


def deliveries(spark, sf) -> DataFrame:
    line = B.table(spark, sf, "lineitem").withColumn("batch_id", F.floor(F.col("l_orderkey") / 30))
    return line.groupBy("batch_id", F.col("l_linenumber").alias("channel_pos")).agg(
        F.bool_or((F.col("l_returnflag") == "N") & (F.col("l_quantity") >= 50)).alias("ok"),
        F.concat(F.lit("error "), F.max("l_partkey").cast("string")).alias("error"),
        F.max("l_shipdate").cast("timestamp").alias("at"),
    ).withColumn("channel", F.concat(F.lit("channel "), F.col("channel_pos").cast("string")))


@query("i4_any_channel_success", f"""WITH {DELIVERIES_SQL}
SELECT notice_id,
  CASE WHEN delivered THEN 1 WHEN state = 0 AND notify_attempts + CASE WHEN delivered IS NULL THEN 0 ELSE 1 END >= 5 THEN 3 ELSE state END AS state,
  notify_attempts + CASE WHEN coalesce(delivered, true) THEN 0 ELSE 1 END AS notify_attempts,
  CASE WHEN NOT delivered THEN errors END AS notify_error
FROM outbox LEFT JOIN outcomes ON outcomes.batch_id = notice_id // 30""")
def i4(spark, sf):
    box = B.outbox(spark, sf)
    members = box.select("unique_id", F.floor(F.col("notice_id") / 30).alias("batch_id"))
    done = outbox.apply_batch_outcomes(box, members, outbox.batch_outcome(deliveries(spark, sf)))
    return done.select("notice_id", "state", F.col("notify_attempts").cast("bigint").alias("notify_attempts"), "notify_error")


@query("p9_pending", f"WITH {B.OUTBOX_SQL} SELECT notice_id FROM outbox WHERE state = 0 AND notify_attempts < 5")
def p9(spark, sf):
    return outbox.pending(B.outbox(spark, sf)).select("notice_id")


QUEUE_SQL = ("SELECT * FROM outbox WHERE state = 0 AND notify_attempts < 5 ORDER BY publish_date DESC NULLS LAST, "
             "relevance_score DESC, first_seen_at DESC, unique_id LIMIT {0}")


@query("t2_delivery_queue", f"""WITH {B.OUTBOX_SQL} SELECT notice_id, publish_date, round(relevance_score, 6) AS relevance_score
FROM ({QUEUE_SQL.format(V.PUSH_LIMIT)})""")
def t2(spark, sf):
    return outbox.delivery_queue(B.outbox(spark, sf)).select(
        "notice_id", "publish_date", F.round("relevance_score", 6).alias("relevance_score"))


@query("t4_pending_view", f"""WITH {B.OUTBOX_SQL} SELECT title, url, coalesce(publish_date, '{V.RECENTLY}') AS publish_date, category,
  count(*) OVER () AS total FROM ({QUEUE_SQL.format(V.PENDING_VIEW_LIMIT)})""")
def t4(spark, sf):
    view = to_brief(outbox.delivery_queue(B.outbox(spark, sf), V.PENDING_VIEW_LIMIT))
    total = view.agg(F.count("*").alias("total"))
    return view.select("title", "url", "publish_date", "category", total.scalar().alias("total"))


@query("i8_backfill", f"""WITH {KEYED_SQL} SELECT notice_id, {sql_url('url')} AS canonical_url,
  CASE WHEN notice_id % 2 = 0 THEN 'stored ' || notice_id ELSE dedup_key END AS dedup_key, 0 AS notify_attempts,
  '{V.WHOLE_CITY}' AS district FROM keyed""")
def i8(spark, sf):
    old = B.notices(spark, sf).select(
        "notice_id", "title", "url", "city", F.lit(None).cast("string").alias("canonical_url"),
        F.when(F.col("notice_id") % 2 == 0, F.concat(F.lit("stored "), F.col("notice_id").cast("string"))).alias("dedup_key"))
    full = outbox.backfill(old, {"district": "string", "notify_attempts": "int"},
                           {"district": V.WHOLE_CITY, "notify_attempts": 0})
    return full.select("notice_id", "canonical_url", "dedup_key", "notify_attempts", "district")


@query("i8_mixed_versions", f"""WITH {B.OUTBOX_SQL},
o AS (SELECT notice_id, title, city, 'HTTP://X.example.org:80/n/' || notice_id || '?b=2&a=1#top' AS url, attempts, notice_id % 3 AS version FROM (
  SELECT notice_id, title, city, notify_attempts AS attempts FROM outbox))
SELECT notice_id, 'https://x.example.org/n/' || notice_id || '?a=1&b=2' AS canonical_url,
  CASE WHEN version = 2 THEN 'stored ' || notice_id ELSE md5(city || '|' || {sql_norm_title('title')}) END AS dedup_key,
  CASE WHEN version = 0 THEN 0 ELSE attempts END AS notify_attempts, CASE WHEN version = 2 THEN 'east' ELSE '{V.WHOLE_CITY}' END AS district FROM o""")
def i8_versions(spark, sf):
    """A ledger whose batches have four, five and eight columns, read as one and brought up to date."""
    root, i = scratch_path(spark, "versions"), F.col("notice_id")
    name = i.cast("string")
    rows = B.outbox(spark, sf).withColumn("url", F.concat(F.lit("HTTP://X.example.org:80/n/"), name, F.lit("?b=2&a=1#top")))
    first, added = ["notice_id", "title", "city", "url"], {
        "canonical_url": F.concat(F.lit("https://x.example.org/n/"), name, F.lit("?a=1&b=2")),
        "dedup_key": F.concat(F.lit("stored "), name), "district": F.lit("east")}
    rows.filter(i % 3 == 0).select(*first).write.parquet(f"{root}/batch=0")
    rows.filter(i % 3 == 1).select(*first, "notify_attempts").write.parquet(f"{root}/batch=1")
    rows.filter(i % 3 == 2).withColumns(added).select(*first, "notify_attempts", *added).write.parquet(f"{root}/batch=2")
    full = outbox.backfill(outbox.stored_versions(spark, root), {"district": "string", "notify_attempts": "int"},
                           {"district": V.WHOLE_CITY, "notify_attempts": 0})
    return full.select("notice_id", "canonical_url", "dedup_key", "notify_attempts", "district")


# --- reports ---------------------------------------------------------------------
STATES_SQL = ", ".join(f"count(*) FILTER (state = {s}) AS {n}" for s, n in V.STATE_NAMES.items())
STATS_DAY = "1998-03-15"


@query("a4_count_by_state", f"WITH {B.OUTBOX_SQL} SELECT {STATES_SQL} FROM outbox")
def a4(spark, sf):
    return reports.count_by_state(B.outbox(spark, sf))


@query("a5_ledger_stats", f"""WITH {B.OUTBOX_SQL} SELECT count(*) AS total_policies, count(DISTINCT city) AS active_cities,
  count(*) FILTER (CAST(first_seen_at AS DATE) = DATE '{STATS_DAY}') AS today_count, {STATES_SQL} FROM outbox""")
def a5(spark, sf):
    return reports.ledger_stats(B.outbox(spark, sf), F.lit(STATS_DAY).cast("date"))


@query("a12_run_summary", f"""WITH {DELIVERIES_SQL},
q AS ({QUEUE_SQL.format(V.PUSH_LIMIT)}), names AS (
  SELECT bool_or(ok) AS any_ok, count(*) AS n, coalesce(string_agg(DISTINCT channel, ',' ORDER BY channel) FILTER (ok), '') AS ok_names,
    coalesce(string_agg(DISTINCT channel, ',' ORDER BY channel) FILTER (NOT ok), '') AS bad_names FROM deliveries)
SELECT (SELECT count(*) FROM q) AS attempted, CASE WHEN any_ok THEN (SELECT count(*) FROM q) ELSE 0 END AS succeeded,
  CASE WHEN any_ok THEN 0 ELSE (SELECT count(*) FROM q) END AS failed, ok_names AS channels_ok, bad_names AS channels_failed,
  CAST(NULL AS VARCHAR) AS skipped_reason FROM names""")
def a12(spark, sf):
    return outbox.run_summary(outbox.delivery_queue(B.outbox(spark, sf)), deliveries(spark, sf))


@query("p8_search", f"""WITH {B.OUTBOX_SQL} SELECT notice_id, city, title FROM outbox
WHERE (contains(lower(city), 'city_1') OR contains(lower(district), 'city_1'))
  AND (contains(lower(title), 'high') OR contains(lower(source_name), 'high') OR contains(lower(city), 'high') OR contains(lower(district), 'high'))
ORDER BY first_seen_at DESC, publish_date DESC NULLS LAST, unique_id""")
def p8(spark, sf):
    return filters.search(B.outbox(spark, sf), city="city_1", text=" HIGH ").select("notice_id", "city", "title")


DIGEST_BATCH_SQL = B.OUTBOX_SQL + """,
batches AS (SELECT *, notice_id // 30 AS batch_id, notice_id % 30 + 1 AS pos FROM outbox)"""


def sql_digest(style: str) -> str:
    place = "city || '·' || district"
    if style == "markdown":
        lines = [f"'### 📍 [' || {place} || '] ' || title", "'- **发布单位**: ' || source_name", "'- **发布时间**: ' || publish_date",
                 f"CASE WHEN deadline <> '{V.DEADLINE_UNKNOWN}' THEN '- **⏰ 申报期限**: ' || deadline END",
                 "'- **适合人群**: ' || target_audience", "'- **额度/房源**: ' || amount_or_quota", "'- **年龄要求**: ' || age_limit",
                 "'- **原文链接**: [点击查看官方公告](' || url || ')'", "''", "'---'", "''"]
    elif style == "plain":
        lines = [f"'[' || pos || '] ' || {place} || ' ' || title", "'    发布单位: ' || source_name", "'    发布时间: ' || publish_date",
                 f"CASE WHEN deadline <> '{V.DEADLINE_UNKNOWN}' THEN '    申报期限: ' || deadline END",
                 "'    适合人群: ' || target_audience", "'    额度/房源: ' || amount_or_quota", "'    年龄要求: ' || age_limit",
                 "'    原文链接: ' || url", "''"]
    else:
        lines = [f"'**[' || {place} || ']** [' || title || '](' || url || ')'",
                 f"CASE WHEN deadline <> '{V.DEADLINE_UNKNOWN}' THEN '> ⏰ 期限: <font color=\"warning\">' || deadline || '</font>' END",
                 "'> 👥 ' || target_audience", "'> 🎯 ' || amount_or_quota", "''"]
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


SUBJECT_SQL = """'【政策速递】' || array_to_string(cities, '/') || ' ' || n || ' 条新政策 · ' || headline AS subject"""


def digest_sql(style: str) -> str:
    return f"""WITH {DIGEST_BATCH_SQL},
city_pos AS (SELECT batch_id, city, min(pos) AS p FROM batches GROUP BY 1, 2),
city_lists AS (SELECT batch_id, list(city ORDER BY p) AS cities FROM city_pos GROUP BY 1),
d AS (SELECT batch_id, count(*) AS n, string_agg({sql_digest(style)}, chr(10) ORDER BY pos) AS body,
    arg_min(title, pos) AS headline FROM batches GROUP BY 1)
SELECT batch_id, n, body, {SUBJECT_SQL} FROM d JOIN city_lists USING (batch_id)"""


def batches(spark, sf) -> DataFrame:
    k = F.col("notice_id")
    return B.outbox(spark, sf).withColumns({"batch_id": F.floor(k / 30), "pos": (k % 30 + 1).cast("int")})


@query("s17_digest_markdown", digest_sql("markdown"))
def s17_markdown(spark, sf):
    return reports.digest(batches(spark, sf), "markdown")


@query("s17_digest_plain", digest_sql("plain"))
def s17_plain(spark, sf):
    return reports.digest(batches(spark, sf), "plain")


@query("s17_digest_wecom", f"""WITH {DIGEST_BATCH_SQL}
SELECT batch_id, '### 🏠 新政策 · ' || count(*) || ' 条新动态' || chr(10) || chr(10)
  || string_agg({sql_digest('wecom')}, chr(10) ORDER BY pos) AS body FROM batches GROUP BY 1""")
def s17_wecom(spark, sf):
    return reports.digest(batches(spark, sf), "wecom").select("batch_id", "body")
