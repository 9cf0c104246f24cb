"""Queries over notices: keys, dates, filters, score and funnel."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import dates, keys, lexicon as lx, titles
from noticeboard.functions.text import squeeze
from noticeboard.functions.urls import normalize_url
from noticeboard.operators import filters
from noticeboard.plans import bindings as B
from noticeboard.plans.registry import query
from noticeboard.session import shared_dir

POLICY = filters.Policy(today=B.TODAY)


# --- SQL building blocks ----------------------------------------------------
def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_url(u: str) -> str:
    """Canonical address in SQL, for any http(s) address with a host."""
    volatile = ", ".join(sql_text(k) for k in V.VOLATILE_QUERY_KEYS)
    files = ", ".join(sql_text(k) for k in V.INDEX_FILENAMES)
    host = rf"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g')"
    last = f"lower(regexp_extract({path}, '[^/]*$'))"
    path = f"(CASE WHEN {last} IN ({files}) THEN left({path}, length({path}) - length({last})) ELSE {path} END)"
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    qs = rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
    enc = "replace(url_encode({0}), '%20', '+')"
    pairs = (f"list_sort(list_transform(list_filter(string_split({qs}, '&'), "
             f"lambda p: contains(p, '=') AND length(regexp_extract(p, '=(.*)$', 1)) > 0 "
             f"AND lower(url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' '))) NOT IN ({volatile})), "
             f"lambda p: {{'k': url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')), "
             f"'v': url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' '))}}))")
    query_ = f"array_to_string(list_transform({pairs}, lambda s: {enc.format('s.k')} || '=' || {enc.format('s.v')}), '&')"
    return f"('https://' || {host} || {path} || CASE WHEN {query_} <> '' THEN '?' || {query_} ELSE '' END)"


def sql_norm_title(t: str) -> str:
    return f"regexp_replace({t}, {sql_text('[' + V.WS + re.escape(V.TITLE_MARKS) + ']+')}, '', 'g')"


def sql_clean_title(t: str) -> str:
    out = B.sql_squeeze(t)
    for p in (V.TITLE_DATE_PREFIX, V.TITLE_DATE_SUFFIX, V.TITLE_MORE_SUFFIX):
        out = f"regexp_replace({out}, {sql_text(p)}, '')"
    return f"trim({out})"


def sql_publish_date(p: str) -> str:
    m = [f"regexp_extract({p}, {sql_text(V.PUBLISH_DATE)}, {n})" for n in range(4)]
    return (f"TRY_CAST(CASE WHEN {m[0]} <> '' THEN {m[1]} || '-' || lpad({m[2]}, 2, '0') "
            f"|| '-' || lpad({m[3]}, 2, '0') END AS DATE)")


def sql_score(title: str, category: str, source: str) -> str:
    lex = POLICY.lexicon
    table = "[" + ", ".join(f"{{'t': {sql_text(t)}, 'w': {w}::DOUBLE}}" for t, w, _ in lex.longest_first()) + "]"
    present = f"list_filter({table}, lambda x: contains({title}, x.t))"
    counted = (f"list_filter({present}, lambda x: len(list_filter({present}, "
               f"lambda y: y.t <> x.t AND contains(y.t, x.t))) = 0)")
    base = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform({counted}, lambda x: x.w)), lambda a, b: a + b)"

    def any_of(words, c):
        return "(" + " OR ".join(f"contains({c}, {sql_text(w)})" for w in words) + ")"

    cats = ", ".join(sql_text(c) for c in lex.categories)
    return (f"CASE WHEN {title} = '' THEN 0.0::DOUBLE ELSE ({base} "
            f"+ CASE WHEN {any_of(lex.action_words, title)} AND {any_of(lex.object_words, title)} THEN 1.2::DOUBLE ELSE 0 END "
            f"+ CASE WHEN {category} IN ({cats}) THEN 0.5::DOUBLE ELSE 0 END "
            f"+ CASE WHEN {any_of(lex.source_hints, source)} THEN 0.5::DOUBLE ELSE 0 END) "
            f"* CASE WHEN length({title}) < 10 THEN 0.5::DOUBLE ELSE 1 END END")


BLOCKED_SQL = f"list_filter({B.sql_list(V.BLOCKLIST)}, lambda t: contains(title_clean, t))[1]"
JUDGED_SQL = B.NOTICES_SQL + f""",
cleaned AS (SELECT *, {sql_clean_title('title')} AS title_clean FROM notices),
measured AS (
  SELECT *, {BLOCKED_SQL} AS blocked_term,
    datediff('day', {sql_publish_date('publish_date')}, DATE '{B.TODAY}') AS age_days,
    {sql_score('title_clean', 'category', 'source_name')} AS score FROM cleaned),
judged AS (
  SELECT *, CASE WHEN blocked_term IS NOT NULL THEN 'blacklisted'
    WHEN coalesce(age_days > {V.MAX_AGE_DAYS}, false) THEN 'stale'
    WHEN score < {V.SCORE_THRESHOLD} THEN 'low_score' ELSE 'kept' END AS reason FROM measured)"""


def sql_refine(title: str, category: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({title}, {sql_text(p)}) THEN '{c}'" for c, p in V.CATEGORY_PATTERNS) + f" ELSE {category} END"


def sql_labels(text: str, patterns) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {sql_text(p)}) THEN {sql_text(label)} END" for p, label in patterns)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_group(text: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({text}, {sql_text(pattern)}, {n}), '')"


KEPT_SQL = JUDGED_SQL + f""",
kept AS (
  SELECT notice_id, title_clean AS title, url, city, district, source_name, publish_date, deadline, score AS relevance_score,
    {sql_refine('title_clean', 'category')} AS category,
    CASE WHEN len({sql_labels('title_clean', V.TITLE_AUDIENCE_PATTERNS)}) > 0
         THEN array_to_string({sql_labels('title_clean', V.TITLE_AUDIENCE_PATTERNS)}, ' / ') ELSE target_audience END AS target_audience,
    '房源 ' || {sql_group('title_clean', V.TITLE_QUOTA, 1)} || ' ' || {sql_group('title_clean', V.TITLE_QUOTA, 2)} AS amount_or_quota,
    '批次: ' || {sql_group('title_clean', V.TITLE_BATCH, 1)} AS notes
  FROM judged WHERE reason = 'kept')"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return filters.judge(B.notices(spark, sf), POLICY)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return filters.kept(judged(spark, sf))


# --- K: keys and canonical forms ----------------------------------------------
@query("k1_normalize_url", f"""SELECT page_id, {sql_url('url')} AS canonical_url FROM pages
UNION ALL SELECT notice_id, {sql_url('url')} FROM (WITH {B.RAW_NOTICES_SQL} SELECT * FROM raw_notices)""")
def k1(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    both = pages.unionByName(B.raw_notices(spark, sf).select(F.col("notice_id").alias("page_id"), "url"))
    return both.select("page_id", normalize_url(F.col("url")).alias("canonical_url"))


@query("k2_normalize_title", f"""SELECT doc_id, {sql_norm_title('text')} AS title_normal FROM documents""")
def k2(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", titles.normalize_title(F.col("text")).alias("title_normal"))


@query("k3_unique_id", f"SELECT page_id, md5({sql_url('url')}) AS unique_id FROM pages")
def k3(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", keys.unique_id(F.col("url")).alias("unique_id"))


@query("k4_dedup_key", f"""WITH {B.NOTICES_SQL}
SELECT notice_id, md5(city || '|' || {sql_norm_title('title')}) AS dedup_key FROM notices""")
def k4(spark, sf):
    return B.notices(spark, sf).select("notice_id", keys.dedup_key(F.col("city"), F.col("title")).alias("dedup_key"))


@query("k5_content_fingerprint", f"""WITH {B.NOTICES_SQL}
SELECT notice_id, sha256({sql_norm_title('title')} || '_' || coalesce(publish_date, '') || '_' || deadline) AS fingerprint
FROM notices""")
def k5(spark, sf):
    return B.notices(spark, sf).select("notice_id", keys.content_fingerprint(
        F.col("title"), F.col("publish_date"), F.col("deadline")).alias("fingerprint"))


@query("k6_publish_date", f"""WITH {B.RAW_NOTICES_SQL}
SELECT notice_id, CAST({sql_publish_date('publish_date')} AS VARCHAR) AS publish_dt FROM raw_notices
UNION ALL SELECT notice_id, CAST({sql_publish_date('title_raw')} AS VARCHAR) FROM raw_notices""")
def k6(spark, sf):
    raw = B.raw_notices(spark, sf)
    return raw.select("notice_id", dates.publish_date(F.col("publish_date")).cast("string").alias("publish_dt")).unionByName(
        raw.select("notice_id", dates.publish_date(F.col("title_raw")).cast("string").alias("publish_dt")))


@query("k7_age_days", f"""WITH {B.RAW_NOTICES_SQL}
SELECT notice_id, CAST(datediff('day', {sql_publish_date('publish_date')}, DATE '{B.TODAY}') AS VARCHAR) AS age_days
FROM raw_notices""")
def k7(spark, sf):
    today = F.lit(B.TODAY).cast("date")
    return B.raw_notices(spark, sf).select(
        "notice_id", dates.age_days(dates.publish_date(F.col("publish_date")), today).cast("string").alias("age_days"))


def sql_row_date(t: str) -> str:
    parts = []
    for i, p in enumerate(V.ROW_DATE_PATTERNS):
        if i == 2:
            p = p.replace(f"(?!{V._D})", f"(?:[^0-9０-９]|$)")
        g = [f"TRY_CAST(nullif(regexp_extract({t}, {sql_text(p)}, {n}), '') AS INTEGER)" for n in (1, 2, 3)]
        parts.append(f"CASE WHEN {g[0]} BETWEEN 2000 AND 2100 AND {g[1]} BETWEEN 1 AND 12 AND {g[2]} BETWEEN 1 AND 31 "
                     f"THEN printf('%04d-%02d-%02d', {g[0]}, {g[1]}, {g[2]}) END")
    return "coalesce(" + ", ".join(parts) + ")"


@query("k8_parse_date_text", "WITH texts AS (SELECT doc_id, text || chr(10) || CASE doc_id % 5 "
       "WHEN 0 THEN '发布日期 ' || (2010 + doc_id % 120) || ' 年 ' || (1 + doc_id % 13) || ' 月 ' || (1 + doc_id % 31) || ' 日' "
       "WHEN 1 THEN (1990 + doc_id % 120) || '/' || (1 + doc_id % 12) || ' / ' || (1 + doc_id % 31) "
       "WHEN 2 THEN '编号2024' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '109 20240115' "
       "WHEN 3 THEN '2024-' || (1 + doc_id % 12) || '-99 2023' || lpad(CAST(1 + doc_id % 14 AS VARCHAR), 2, '0') || '15x' "
       "ELSE '无日期' END AS body FROM documents) "
       f"SELECT doc_id, {sql_row_date('body')} AS parsed FROM texts")
def k8(spark, sf):
    i = F.col("doc_id")

    def s(c, width=0):
        return F.lpad(c.cast("string"), width, "0") if width else c.cast("string")

    tail = (F.when(i % 5 == 0, F.concat(F.lit("发布日期 "), s(2010 + i % 120), F.lit(" 年 "), s(1 + i % 13), F.lit(" 月 "), s(1 + i % 31), F.lit(" 日")))
            .when(i % 5 == 1, F.concat(s(1990 + i % 120), F.lit("/"), s(1 + i % 12), F.lit(" / "), s(1 + i % 31)))
            .when(i % 5 == 2, F.concat(F.lit("编号2024"), s(1 + i % 12, 2), F.lit("109 20240115")))
            .when(i % 5 == 3, F.concat(F.lit("2024-"), s(1 + i % 12), F.lit("-99 2023"), s(1 + i % 14, 2), F.lit("15x")))
            .otherwise("无日期"))
    body = F.concat("text", F.lit("\n"), tail)
    return B.table(spark, sf, "documents").select("doc_id", dates.parse_date_text(body).alias("parsed"))


@query("k9_clean_title", f"""WITH {B.RAW_NOTICES_SQL}
SELECT notice_id, {sql_clean_title('title_raw')} AS title_clean FROM raw_notices""")
def k9(spark, sf):
    return B.raw_notices(spark, sf).select("notice_id", titles.clean_title(F.col("title_raw")).alias("title_clean"))


@query("k10_coerce_category", f"""WITH {B.NOTICES_SQL} SELECT notice_id, category FROM notices""")
def k10(spark, sf):
    return B.raw_notices(spark, sf).filter(squeeze(F.col("title_raw")) != "").select(
        "notice_id", titles.coerce_category(F.col("category_raw")).alias("category"))


@query("k11_has_actionable_detail", f"""WITH {B.OUTBOX_SQL} SELECT notice_id,
  (amount_or_quota IS NOT NULL OR deadline <> '{V.DEADLINE_UNKNOWN}' OR target_audience <> '{V.AUDIENCE_UNKNOWN}') AS actionable
FROM outbox""")
def k11(spark, sf):
    return B.outbox(spark, sf).select("notice_id", keys.has_actionable_detail(
        F.col("amount_or_quota"), F.col("deadline"), F.col("target_audience")).alias("actionable"))


@query("k12_to_brief", f"""WITH {B.OUTBOX_SQL} SELECT title, url, city, district, source_name, category, target_audience, deadline,
  amount_or_quota, age_limit, coalesce(publish_date, '{V.RECENTLY}') AS publish_date,
  round(relevance_score, 6) AS relevance_score_raw FROM outbox""")
def k12(spark, sf):
    return keys.to_brief(B.outbox(spark, sf)).select(
        "title", "url", "city", "district", "source_name", "category", "target_audience", "deadline", "amount_or_quota",
        "age_limit", "publish_date", F.round("relevance_score_raw", 6).alias("relevance_score_raw"))


# --- P, A1, A2, T1: filters, funnel, score ---------------------------------------
@query("p1_blocklist", f"WITH {JUDGED_SQL} SELECT notice_id, blocked_term FROM judged")
def p1(spark, sf):
    n = B.notices(spark, sf)
    return n.select("notice_id", lx.blocked_by(titles.clean_title(F.col("title")), V.BLOCKLIST).alias("blocked_term"))


@query("p2_freshness", f"""WITH {B.NOTICES_SQL} SELECT notice_id, title FROM notices
WHERE coalesce(datediff('day', {sql_publish_date('publish_date')}, DATE '{B.TODAY}') <= {V.MAX_AGE_DAYS}, true)""")
def p2(spark, sf):
    age = dates.age_days(dates.publish_date(F.col("publish_date")), F.lit(B.TODAY).cast("date"))
    return B.notices(spark, sf).filter(filters.is_fresh(age, V.MAX_AGE_DAYS)).select("notice_id", "title")


@query("p3_relevant", f"WITH {JUDGED_SQL} SELECT notice_id, round(score, 6) AS relevance_score FROM judged WHERE reason = 'kept'")
def p3(spark, sf):
    return judged(spark, sf).filter(F.col("reason") == "kept").select(
        "notice_id", F.round("relevance_score", 6).alias("relevance_score"))


@query("p4_drop_reason", f"WITH {JUDGED_SQL} SELECT notice_id, reason FROM judged")
def p4(spark, sf):
    return judged(spark, sf).select("notice_id", "reason")


@query("a1_funnel", f"""WITH {JUDGED_SQL} SELECT count(*) AS total, count(*) FILTER (reason = 'blacklisted') AS blacklisted,
  count(*) FILTER (reason = 'stale') AS stale, count(*) FILTER (reason = 'low_score') AS low_score,
  count(*) FILTER (reason = 'kept') AS kept FROM judged""")
def a1(spark, sf):
    return filters.funnel(judged(spark, sf))


@query("a2_lexicon_score", f"WITH {JUDGED_SQL} SELECT notice_id, round(score, 6) AS score FROM judged")
def a2(spark, sf):
    cleaned = B.notices(spark, sf).withColumn("title_clean", titles.clean_title(F.col("title")))
    return cleaned.select("notice_id", F.round(lx.score(
        F.col("title_clean"), F.col("category"), F.col("source_name"), POLICY.lexicon), 6).alias("score"))


@query("t1_top_notices", f"""WITH {KEPT_SQL} SELECT notice_id, category, round(relevance_score, 6) AS relevance_score
FROM kept ORDER BY kept.relevance_score DESC, notice_id""")
def t1(spark, sf):
    # written first: a sort reads its input twice, once to find the ranges
    shared_dir(spark)
    best = kept(spark, sf).select("notice_id", "category", "relevance_score").checkpoint()
    return best.orderBy(F.desc("relevance_score"), "notice_id").select(
        "notice_id", "category", F.round("relevance_score", 6).alias("relevance_score"))


@query("x11_title_enrichment", f"""WITH {KEPT_SQL} SELECT notice_id, title, target_audience, amount_or_quota, notes FROM kept""")
def x11(spark, sf):
    return kept(spark, sf).select("notice_id", "title", "target_audience", "amount_or_quota", "notes")


@query("x12_refine_category", f"""WITH {KEPT_SQL} SELECT notice_id, category FROM kept""")
def x12(spark, sf):
    return kept(spark, sf).select("notice_id", "category")
