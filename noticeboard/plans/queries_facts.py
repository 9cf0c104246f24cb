"""Queries for facts in notice texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import facts
from noticeboard.operators import details
from noticeboard.plans import bindings as B
from noticeboard.plans.queries_notices import KEPT_SQL, kept, sql_group, sql_labels, sql_text
from noticeboard.plans.registry import query

TEXTS = f"WITH {B.FACT_TEXTS_SQL}"


def texts(spark, sf) -> DataFrame:
    return B.fact_texts(spark, sf)


# --- SQL building blocks ---------------------------------------------------------
def sql_iso(y: str, m: str, d: str, low: int = 0, high: int = 9999) -> str:
    y, m, d = (f"TRY_CAST({x} AS INTEGER)" for x in (y, m, d))
    return (f"CASE WHEN {y} BETWEEN {low} AND {high} AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 "
            f"THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END")


def sql_match_iso(t: str, pattern: str, first: int = 1) -> str:
    return sql_iso(*[sql_group(t, pattern, first + i) for i in range(3)])


def sql_number(n: str) -> str:
    digits = "map([" + ", ".join(f"'{k}'" for k in V.CHINESE_DIGITS) + "], [" + ", ".join(
        str(v) for v in V.CHINESE_DIGITS.values()) + "])"
    tens, ones = f"split_part({n}, '十', 1)", f"split_part({n}, '十', 2)"
    return (f"CASE WHEN regexp_full_match({n}, '[0-9]+') THEN {n} "
            f"WHEN {digits}[{n}] IS NOT NULL THEN CAST({digits}[{n}] AS VARCHAR) "
            f"WHEN contains({n}, '十') THEN CAST((CASE WHEN {tens} = '' THEN 1 ELSE coalesce({digits}[{tens}], 1) END) * 10 "
            f"+ (CASE WHEN {ones} = '' THEN 0 ELSE coalesce({digits}[{ones}], 0) END) AS VARCHAR) ELSE {n} END")


def sql_deadline(t: str) -> str:
    parts = [f"{sql_match_iso(t, p)} || ' 截止'" for p in V.DEADLINE_EXPLICIT]
    parts.append(f"{sql_match_iso(t, V.DEADLINE_RANGE)} || ' 至 ' || {sql_match_iso(t, V.DEADLINE_RANGE, 4)}")
    year = sql_group(t, V.YEAR_IN_TEXT, 1)
    md = [sql_group(t, V.DEADLINE_MD_RANGE, i) for i in (1, 2, 3, 4)]
    parts.append(f"{sql_iso(year, md[0], md[1])} || ' 至 ' || {sql_iso(year, md[2], md[3])}")
    parts.append(f"'公告发布起 ' || {sql_number(sql_group(t, V.DEADLINE_RELATIVE, 1))} || ' ' || "
                 f"{sql_group(t, V.DEADLINE_RELATIVE, 2)} || '内'")
    return "coalesce(" + ", ".join(parts) + ")"


def sql_unit(u: str) -> str:
    return f"CASE WHEN {u} IN ('万元', '万') THEN '万元' WHEN {u} IS NOT NULL THEN '元' END"


def sql_tiered(t: str) -> str:
    p = sql_text(V.TIERED_AMOUNT)
    zipped = (f"list_zip(regexp_extract_all({t}, {p}, 1), regexp_extract_all({t}, {p}, 2), regexp_extract_all({t}, {p}, 3))")
    kept_ = (f"list_filter({zipped}, lambda x, i: len(list_filter(({zipped})[1:i - 1], "
             f"lambda y: y[1] = x[1] AND y[2] = x[2])) = 0)")
    return (f"CASE WHEN len(regexp_extract_all({t}, {p}, 1)) >= 2 THEN array_to_string(list_transform({kept_}, "
            f"lambda x: x[1] || x[2] || {sql_unit('x[3]')}), ' / ') END")


def sql_quotas(t: str) -> str:
    p = sql_text(V.QUOTA)
    units, numbers = f"regexp_extract_all({t}, {p}, 2)", f"regexp_extract_all({t}, {p}, 1)"
    first = f"list_filter({units}, lambda u, i: list_position({units}, u) = i)"
    total = f"list_sum(list_transform(list_filter(list_zip({numbers}, {units}), lambda z: z[2] = u), lambda z: CAST(z[1] AS BIGINT)))"
    return f"list_transform({first}, lambda u: '房源 ' || CAST({total} AS BIGINT) || ' ' || u)"


def sql_amount(t: str) -> str:
    def single(p, prefix, plain=False):
        u = sql_group(t, p, 2)
        return f"{sql_text(prefix)} || {sql_group(t, p, 1)} || ' ' || {u if plain else sql_unit(u)}"

    money = (f"coalesce({sql_tiered(t)}, {single(V.MONTHLY_AMOUNT, '每月 ', True)}, "
             f"{single(V.ONE_OFF_AMOUNT, '一次性 ')}, {single(V.GENERIC_AMOUNT, '')})")
    parts = f"list_concat(list_filter([{money}], lambda x: x IS NOT NULL), {sql_quotas(t)})"
    return f"nullif(array_to_string({parts}, ' ｜ '), '')"


def sql_audience(t: str, title: str) -> str:
    c = f"({title} || chr(10) || {t})"
    labels = sql_labels(c, V.AUDIENCE_PATTERNS)
    within = f"'毕业' || {sql_number(sql_group(c, V.GRADUATED_WITHIN, 1))} || '年内'"
    every = f"list_concat({labels}, list_filter([{within}], lambda x: x IS NOT NULL))"
    return f"nullif(array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i), ' / '), '')"


def sql_age(t: str) -> str:
    # RE2 has no lookahead: take the words behind the match along and drop the matches for children
    wide = V.AGE_NOT_OVER.replace("(?!", "(?:").replace("未成年人))", "未成年人))?")
    hit = (f"list_filter(regexp_extract_all({t}, {sql_text(wide)}, 0), "
           f"lambda x: NOT regexp_matches(x, '(子女|儿童|未成年人)$'))[1]")
    below = f"{sql_group(t, V.AGE_BELOW, 1)} || '周岁以下'"
    not_over = f"regexp_extract({hit}, '([0-9]{{2}})', 1) || '周岁以下'"
    between = f"{sql_group(t, V.AGE_BETWEEN, 1)} || '-' || {sql_group(t, V.AGE_BETWEEN, 2)} || '周岁'"
    return f"coalesce({below}, {not_over}, {between})"


def sql_channel(t: str) -> str:
    url = f"regexp_replace({sql_group(t, V.CHANNEL_URL, 1)}, '[.,;]+$', '')"
    return f"coalesce(CASE WHEN NOT regexp_matches({url}, {sql_text(V.CHANNEL_ASSET)}) THEN {url} END, {sql_group(t, V.CHANNEL_NAME, 1)})"


def sql_strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^[{V.WS}]+', ''), '[{V.WS}]+$', '')"


def sql_summary(t: str) -> str:
    return (f"list_filter(list_transform(string_split({t}, chr(10)), lambda s: {sql_strip('s')}), "
            f"lambda x: length(x) >= 25 AND NOT regexp_matches(x, {sql_text(V.SUMMARY_DOC_NUMBER)}) "
            f"AND NOT regexp_matches(x, {sql_text(V.SUMMARY_BOILERPLATE)}))[1]")


def sql_clean(t: str) -> str:
    blanks = "regexp_replace({0}, '[ \\t\\x{{3000}}]+', ' ', 'g')".format(t)
    return sql_strip(f"regexp_replace({blanks}, '\\n{{2,}}', chr(10), 'g')")


# --- queries -----------------------------------------------------------------------
@query("x2_clean_text", f"{TEXTS} SELECT doc_id, {sql_clean('text')} AS cleaned FROM fact_texts")
def x2(spark, sf):
    return texts(spark, sf).select("doc_id", facts.clean_text(F.col("text")).alias("cleaned"))


@query("x3_deadline", f"{TEXTS} SELECT doc_id, {sql_deadline('text')} AS deadline FROM fact_texts")
def x3(spark, sf):
    return texts(spark, sf).select("doc_id", facts.deadline(F.col("text")).alias("deadline"))


@query("x4_chinese_numeral", "SELECT doc_id, doc_id % 100 AS n FROM documents")
def x4(spark, sf):
    n = F.col("doc_id") % 100
    names = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
    tens, ones = F.floor(n / 10), n % 10
    spelled = (F.when(n < 10, B.pick(names, n))
               .otherwise(F.concat(F.when(tens > 1, B.pick(names, tens)).otherwise(""), F.lit("十"),
                                   F.when(ones > 0, B.pick(names, ones)).otherwise(""))))
    return B.table(spark, sf, "documents").select("doc_id", facts.chinese_to_int(spelled).cast("bigint").alias("n"))


@query("x5_amount", f"{TEXTS} SELECT doc_id, {sql_amount('text')} AS amount FROM fact_texts")
def x5(spark, sf):
    return texts(spark, sf).select("doc_id", facts.amount(F.col("text")).alias("amount"))


@query("a11_quota_totals", f"{TEXTS} SELECT doc_id, array_to_string({sql_quotas('text')}, ' ｜ ') AS quotas FROM fact_texts")
def a11(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(facts.quotas(F.col("text")), " ｜ ").alias("quotas"))


@query("x6_audience", f"{TEXTS} SELECT doc_id, {sql_audience('text', repr('标题'))} AS audience FROM fact_texts")
def x6(spark, sf):
    return texts(spark, sf).select("doc_id", facts.audience(F.col("text"), F.lit("标题")).alias("audience"))


@query("x7_age_limit", f"{TEXTS} SELECT doc_id, {sql_age('text')} AS age_limit FROM fact_texts")
def x7(spark, sf):
    return texts(spark, sf).select("doc_id", facts.age_limit(F.col("text")).alias("age_limit"))


@query("x8_apply_channel", f"{TEXTS} SELECT doc_id, {sql_channel('text')} AS channel FROM fact_texts")
def x8(spark, sf):
    return texts(spark, sf).select("doc_id", facts.apply_channel(F.col("text")).alias("channel"))


@query("x9_summary", f"{TEXTS} SELECT doc_id, {sql_summary('text')} AS summary FROM fact_texts")
def x9(spark, sf):
    return texts(spark, sf).select("doc_id", facts.summary(F.col("text")).alias("summary"))


FACT_COLUMNS = ["deadline", "amount_or_quota", "target_audience", "age_limit", "apply_channel", "raw_content"]
FOUND_SQL = f"""found AS (SELECT doc_id, {sql_deadline('text')} AS f_deadline, {sql_amount('text')} AS f_amount,
  {sql_age('text')} AS f_age, {sql_channel('text')} AS f_channel, {sql_summary('text')} AS f_summary, text FROM fact_texts)"""
ENRICHED_SQL = f"""SELECT kept.notice_id, coalesce(f_deadline, deadline) AS deadline, coalesce(f_amount, amount_or_quota) AS amount_or_quota,
  coalesce({sql_audience('text', 'title')}, target_audience) AS target_audience, f_age AS age_limit, f_channel AS apply_channel,
  coalesce(f_summary, '') AS raw_content, text IS NOT NULL AS detail_fetched"""


def detail_texts(spark, sf) -> DataFrame:
    return texts(spark, sf).select(F.col("doc_id").alias("notice_id"), F.col("text").alias("main_text"))


@query("x10_apply_facts", f"WITH {B.FACT_TEXTS_SQL}, {KEPT_SQL}, {FOUND_SQL} {ENRICHED_SQL} FROM kept LEFT JOIN found ON doc_id = kept.notice_id")
def x10(spark, sf):
    done = details.enrich_with_details(kept(spark, sf), detail_texts(spark, sf), "notice_id", limit=None)
    return done.select("notice_id", *FACT_COLUMNS, "detail_fetched")


@query("j2_detail_budget", f"""WITH {B.FACT_TEXTS_SQL}, {KEPT_SQL}, {FOUND_SQL},
top AS (SELECT notice_id FROM kept ORDER BY relevance_score DESC, notice_id LIMIT {V.DETAIL_LIMIT})
{ENRICHED_SQL} FROM kept LEFT JOIN (SELECT * FROM found WHERE doc_id IN (SELECT notice_id FROM top)) f ON doc_id = kept.notice_id""")
def j2(spark, sf):
    done = details.enrich_with_details(kept(spark, sf), detail_texts(spark, sf), "notice_id", limit=V.DETAIL_LIMIT)
    return done.select("notice_id", *FACT_COLUMNS, "detail_fetched")
