"""Views of the given tables in the shapes the operators work on.

Each binding exists twice: as a DataFrame and as a SQL common table expression.
Rows are derived from the given tables alone and grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import array_of
from noticeboard.operators import filters

TODAY = "2024-03-15"
PLACES = ["深圳市", "北京市", "上海市", "杭州市"]
KINDS = ["公告", "通知", "名单", "办理指南"]
TERMS = [*V.WEAK_TERMS, *V.MEDIUM_TERMS, *V.STRONG_TERMS]
OFFICES = ["住房保障中心", "人才服务局", "教育局"]
DEADLINES = [
    "报名不得晚于2025年4月6日", "窗口开放时段2025年2月3日9:30至2025年2月27日17:30", "本年度（2025年）征集3月4日至3月29日",
    "自通告发布之日起二十个工作日内递交", "2025年14月2日前提交者无效，截止2025-12-3", "从收件之日起45日内答复", "常年开放",
]
AMOUNTS = [
    "硕士7万元、高级工4万元、大专1万元", "租金每月标准为 860 元", "购房给一次性奖励6万元",
    "资助额度：4.5万", "本科2500元，本科2500元，专科900元", "标准面议",
]
QUOTAS = ["提供64套，配租35套，另有12套", "合计17户，推出9间", "房源若干"]
AUDIENCES = [
    "毕业四年内的应届生与学士", "海外高层次人才、博士研究生", "大专、技能人才以及创业人员、新就业大学生",
    "毕业五年以内的硕士与往届毕业生", "人人可报",
]
AGES = ["年龄在42岁以下", "不满16岁的儿童，申请人不超过55岁", "年龄20至50岁", "未满14周岁未成年人"]
CHANNELS = [
    "通过“滨海市青年服务小程序”报名", "见 http://apply.sample.org/form/start?no=7;",
    "海报 https://img.sample.org/poster/one.JPG，进入安居云平台查看", "请到现场",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(array_of(words), (index % len(words) + 1).cast("int"))


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_pick(words: list[str], index: str) -> str:
    return f"{sql_list(words)}[CAST(({index}) % {len(words)} + 1 AS INTEGER)]"


# --------------------------------------------------------------------------
# notices: every document is one notice; every tenth reuses another's address
# --------------------------------------------------------------------------
def raw_notices(spark: SparkSession, sf: str) -> DataFrame:
    return raw_notices_from(table(spark, sf, "documents"))


def raw_notices_from(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 120).cast("int"))
    phrase = F.concat(
        pick(PLACES, i), pick(TERMS, i), pick(TERMS, F.floor(i / 56) + i),
        F.when(i % 6 == 5, pick(V.BLOCKLIST, i)).otherwise(""), pick(KINDS, F.floor(i / 3)))
    key = F.when(i % 10 == 9, i - 4).otherwise(i)
    return d.select(
        i.alias("notice_id"),
        F.concat(
            F.when(i % 5 == 0, "[2024-01-05] ").otherwise(""), "text", F.lit(" "), phrase,
            F.when(i % 4 == 1, " (2024/1/5)").when(i % 4 == 2, " 更多>> ").otherwise("")).alias("title_raw"),
        F.concat(
            F.when(i % 2 == 0, "https").otherwise("HTTP"), F.lit("://WWW.Example.org"),
            F.when(i % 3 == 0, ":80").when(i % 3 == 1, ":443").otherwise(""),
            F.when(i % 4 == 0, "//notice/").when(i % 4 == 1, "/notice//").when(i % 4 == 2, "/notice/INDEX.html").otherwise("/notice/"),
            F.lit("?utm_source=feed&id="), key.cast("string"), F.lit("&q=&a=b%20c*~&t="), i.cast("string"),
            F.when(i % 4 == 1, "#top").otherwise("")).alias("url"),
        F.col("lang").alias("city"),
        F.concat("source", pick(OFFICES, i)).alias("source_name"),
        pick([*V.CATEGORIES[:-1], " Housing ", "unknown"], i).alias("category_raw"),
        F.when(i % 7 == 0, F.lit(None).cast("string"))
         .when(i % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
         .when(i % 4 == 1, F.date_format(day, "yyyy/M/d"))
         .when(i % 4 == 2, F.date_format(day, "yyyy.MM.dd"))
         .otherwise(F.concat(F.lit("发布于"), F.date_format(day, "yyyy年M月d日"))).alias("publish_date"),
    )


RAW_NOTICES_SQL = f"""
raw_notices AS (
  SELECT doc_id AS notice_id,
    CASE WHEN doc_id % 5 = 0 THEN '[2024-01-05] ' ELSE '' END || text || ' '
      || {sql_pick(PLACES, 'doc_id')} || {sql_pick(TERMS, 'doc_id')} || {sql_pick(TERMS, 'doc_id // 56 + doc_id')}
      || CASE WHEN doc_id % 6 = 5 THEN {sql_pick(V.BLOCKLIST, 'doc_id')} ELSE '' END
      || {sql_pick(KINDS, 'doc_id // 3')}
      || CASE doc_id % 4 WHEN 1 THEN ' (2024/1/5)' WHEN 2 THEN ' 更多>> ' ELSE '' END AS title_raw,
    CASE WHEN doc_id % 2 = 0 THEN 'https' ELSE 'HTTP' END || '://WWW.Example.org'
      || CASE doc_id % 3 WHEN 0 THEN ':80' WHEN 1 THEN ':443' ELSE '' END
      || CASE doc_id % 4 WHEN 0 THEN '//notice/' WHEN 1 THEN '/notice//' WHEN 2 THEN '/notice/INDEX.html' ELSE '/notice/' END
      || '?utm_source=feed&id=' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 4 ELSE doc_id END
      || '&q=&a=b%20c*~&t=' || doc_id || CASE WHEN doc_id % 4 = 1 THEN '#top' ELSE '' END AS url,
    lang AS city,
    source || {sql_pick(OFFICES, 'doc_id')} AS source_name,
    {sql_pick([*V.CATEGORIES[:-1], ' Housing ', 'unknown'], 'doc_id')} AS category_raw,
    DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER) AS day,
    CASE WHEN doc_id % 7 = 0 THEN NULL
         WHEN doc_id % 4 = 0 THEN strftime(day, '%Y-%m-%d')
         WHEN doc_id % 4 = 1 THEN year(day) || '/' || month(day) || '/' || day(day)
         WHEN doc_id % 4 = 2 THEN strftime(day, '%Y.%m.%d')
         ELSE '发布于' || year(day) || '年' || month(day) || '月' || day(day) || '日' END AS publish_date
  FROM documents)"""

def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{V.WS}]+', ' ', 'g'))"


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """Validated notices: title squeezed and not empty, defaults filled in."""
    return notices_from(table(spark, sf, "documents"))


def notices_from(documents: DataFrame) -> DataFrame:
    raw = raw_notices_from(documents).withColumnsRenamed({"title_raw": "title", "category_raw": "category"})
    return filters.validated(raw).select(
        "notice_id", "title", "url", "city", F.lit(V.WHOLE_CITY).alias("district"), "source_name", "category",
        F.lit(V.AUDIENCE_UNKNOWN).alias("target_audience"), F.lit(V.DEADLINE_UNKNOWN).alias("deadline"),
        *[F.lit(None).cast("string").alias(c) for c in ("amount_or_quota", "age_limit", "apply_channel", "notes")],
        "publish_date", F.lit("").alias("raw_content"), F.lit(False).alias("detail_fetched"))


NOTICES_SQL = RAW_NOTICES_SQL + f""",
notices AS (
  SELECT notice_id, {sql_squeeze('title_raw')} AS title, url, city, '{V.WHOLE_CITY}' AS district, source_name,
    CASE WHEN lower(trim(category_raw)) IN ('housing','subsidy','rent_subsidy','living_subsidy','employment','other')
         THEN lower(trim(category_raw)) ELSE 'other' END AS category,
    '{V.AUDIENCE_UNKNOWN}' AS target_audience, '{V.DEADLINE_UNKNOWN}' AS deadline,
    CAST(NULL AS VARCHAR) AS amount_or_quota, CAST(NULL AS VARCHAR) AS notes, publish_date
  FROM raw_notices WHERE {sql_squeeze('title_raw')} <> '')"""


# --------------------------------------------------------------------------
# fact texts: every document followed by sentences that carry facts
# --------------------------------------------------------------------------
_FACT_LISTS = [DEADLINES, AMOUNTS, QUOTAS, AUDIENCES, AGES, CHANNELS]


def fact_texts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    parts = []
    for words in _FACT_LISTS:
        parts += [pick(words, i), F.lit("。\n")]
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.regexp_replace("text", "\r", ""), F.lit("\n"), *parts).alias("text"))


FACT_TEXTS_SQL = """
fact_texts AS (
  SELECT doc_id, regexp_replace(text, '\\r', '', 'g') || chr(10) || """ + " || '。' || chr(10) || ".join(
    sql_pick(words, "doc_id") for words in _FACT_LISTS) + """ || '。' || chr(10) AS text FROM documents)"""


# --------------------------------------------------------------------------
# run log: every event is one collector run of the source 'user'
# --------------------------------------------------------------------------
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return run_log_from(table(spark, sf, "events"))


def run_log_from(e: DataFrame) -> DataFrame:
    items = F.floor("value").cast("int")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("source_name"),
        F.concat(F.lit("city "), (F.col("user_id") % 12).cast("string")).alias("city"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(failed | F.col("event_type").isin("view", "click"), 0).otherwise(items).alias("items_found"),
        F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error_message"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


RUN_LOG_SQL = """
run_log AS (
  SELECT event_id AS id, 'source ' || user_id AS source_name, 'city ' || (user_id % 12) AS city,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS items_found,
    CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message,
    ts AS created_at
  FROM events)"""


# --------------------------------------------------------------------------
# outbox: every order is one stored notice
# --------------------------------------------------------------------------
def outbox(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("notice_id"), F.md5(k.cast("string")).alias("unique_id"),
        F.concat(F.lit("notice "), k.cast("string"), F.lit(" "), "o_orderpriority").alias("title"),
        F.concat(F.lit("https://example.org/n/"), k.cast("string")).alias("url"),
        F.concat(F.lit("City_"), (F.col("o_custkey") % 40).cast("string")).alias("city"),
        F.when(k % 5 == 0, "North").otherwise(V.WHOLE_CITY).alias("district"),
        F.col("o_orderpriority").alias("source_name"),
        pick(V.CATEGORIES, k).alias("category"),
        F.when(k % 3 == 0, V.AUDIENCE_UNKNOWN).otherwise("本科").alias("target_audience"),
        F.when(k % 4 == 0, V.DEADLINE_UNKNOWN).otherwise("2024-09-01 截止").alias("deadline"),
        F.when(k % 5 == 1, "每月 1500 元").alias("amount_or_quota"),
        F.when(k % 6 == 1, "35周岁以下").alias("age_limit"),
        F.lit(None).cast("string").alias("apply_channel"), F.lit(None).cast("string").alias("notes"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publish_date"),
        (F.col("o_totalprice") / 1000).alias("relevance_score"),
        F.when(F.col("o_orderstatus") == "O", V.STATE_PENDING).when(F.col("o_orderstatus") == "F", V.STATE_SENT)
         .when(k % 2 == 0, V.STATE_BASELINE).otherwise(V.STATE_PENDING).cast("int").alias("state"),
        (k % 7).cast("int").alias("notify_attempts"),
        F.lit(None).cast("string").alias("notify_error"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")).alias("first_seen_at"),
    )


OUTBOX_SQL = f"""
outbox AS (
  SELECT o_orderkey AS notice_id, md5(CAST(o_orderkey AS VARCHAR)) AS unique_id,
    'notice ' || o_orderkey || ' ' || o_orderpriority AS title, 'https://example.org/n/' || o_orderkey AS url,
    'City_' || (o_custkey % 40) AS city,
    CASE WHEN o_orderkey % 5 = 0 THEN 'North' ELSE '{V.WHOLE_CITY}' END AS district, o_orderpriority AS source_name,
    {sql_pick(V.CATEGORIES, 'o_orderkey')} AS category,
    CASE WHEN o_orderkey % 3 = 0 THEN '{V.AUDIENCE_UNKNOWN}' ELSE '本科' END AS target_audience,
    CASE WHEN o_orderkey % 4 = 0 THEN '{V.DEADLINE_UNKNOWN}' ELSE '2024-09-01 截止' END AS deadline,
    CASE WHEN o_orderkey % 5 = 1 THEN '每月 1500 元' END AS amount_or_quota,
    CASE WHEN o_orderkey % 6 = 1 THEN '35周岁以下' END AS age_limit,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS publish_date,
    o_totalprice / 1000 AS relevance_score,
    CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS state,
    o_orderkey % 7 AS notify_attempts,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS first_seen_at
  FROM orders)"""
