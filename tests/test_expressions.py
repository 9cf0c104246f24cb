"""Literal inputs and expected values of the column expressions."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import admission, dates, facts, keys, lexicon, titles, urls
from noticeboard.functions import text as T


def values(spark, expr, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.select(expr(F.col("v")).alias("out"), "i").orderBy("i").select("out").collect()]


def test_same_page_has_one_address(spark):
    pairs = [
        ("https://a.gov.cn/x?t=1", "https://a.gov.cn/x?t=2"), ("https://a.gov.cn/x?utm_source=q&spm=1", "https://a.gov.cn/x"),
        ("https://a.gov.cn/x?b=2&a=1", "https://a.gov.cn/x?a=1&b=2"), ("HTTP://A.GOV.CN/x", "https://a.gov.cn/x"),
        ("https://a.gov.cn/x/index.html", "https://a.gov.cn/x/"), ("https://a.gov.cn:443/x", "http://a.gov.cn:80/x"),
        ("https://a.gov.cn/x#top", "https://a.gov.cn//x"), ("https://a.gov.cn", "https://a.gov.cn/"),
    ]
    left = values(spark, urls.normalize_url, [a for a, _ in pairs])
    assert left == values(spark, urls.normalize_url, [b for _, b in pairs])
    different = values(spark, urls.normalize_url, ["https://a.cn/x?id=100", "https://a.cn/x?id=200", "https://a.cn/X?id=100"])
    assert len(set(different)) == 3
    assert values(spark, urls.normalize_url, ["", "www.x/a", "https://[x/a", "https://a.com/p?a=%zz&q=c++%20d*~&id="]) == [
        "", "https:www.x/a", "https://[x/a", "https://a.com/p?a=%25zz&q=c+++d%2A~"]


def test_relative_references(spark):
    base = "https://h.com/a/b/c.html?z=1#q"
    hrefs = ["../p/a.html", "/p?x=1", "?q=1", "p/b", "//h/z", "https://q/w", "./k", "../../../z", "#top", "a/../b/..", "",
             "p?x=a/../b", "mailto:a@b", "/x/./y//z", "n.html?id=1#f", "http://o/./p"]
    got = values(spark, lambda c: urls.resolve_url(F.lit(base), c), hrefs)
    assert got == [urljoin(base, h) for h in hrefs]


@pytest.mark.parametrize("text,expected", [
    ("2026/8/5", "2026-08-05"), ("20260820", "2026-08-20"), ("9999-99-99", None), ("2026年8月5日", "2026-08-05"),
    ("发布：2026 - 08 - 05 10:00", "2026-08-05"), ("1999-01-01", None), ("2026-13-01 20260102", "2026-01-02"), ("", None),
    ("２０２６-８-５", "2026-08-05"), ("123456789", None)])
def test_row_dates(spark, text, expected):
    assert values(spark, dates.parse_date_text, [text]) == [expected]


def test_publish_dates(spark):
    got = values(spark, lambda c: dates.publish_date(c).cast("string"),
                 ["2026-8-5", "2026.08.05", "2026年8月5日", "发布于2026/8/5", "2026-02-30", "none", None])
    assert got == ["2026-08-05"] * 4 + [None] * 3
    assert values(spark, dates.heuristic_date, ["8-5 2026-08-05", "2026-08-05"]) == [None, "2026-08-05"]


def test_titles(spark):
    assert values(spark, titles.clean_title, ["[2026-08-20]  关于 公告", "公告名称 (2026-08-20)", "公告更多>>", "　公告　"]) == [
        "关于 公告", "公告名称", "公告", "公告"]
    assert values(spark, titles.normalize_title, ["【公告】关于 A-B（第1批）", None]) == ["公告关于AB第1批", ""]
    assert values(spark, titles.coerce_category, [" Housing ", "x", None]) == ["housing", "other", "other"]


def test_score_counts_contained_terms_once(spark):
    lex = lexicon.Lexicon()

    def score(c):
        return lexicon.score(c, F.lit("other"), F.lit("x"), lex)

    got = values(spark, score, ["关于做好高校毕业生档案转递工作的通知", "深圳市人才公寓配租公告通知", "补贴公示", ""])
    assert got == pytest.approx([1.5, 3.0 + 2.0 + 1.2, (0.3 + 1.2) * 0.5, 0.0])
    assert values(spark, lambda c: lexicon.blocked_by(c, lex.blocklist), ["某某招聘公告", "人才公寓"]) == ["招聘", None]


def test_deadlines(spark):
    assert values(spark, facts.deadline, [
        "报名不得晚于2027年4月6日。", "窗口开放2027年2月3日9:30至2027年2月27日17:30", "2027年度征集 3月4日至3月29日",
        "自通告发布之日起二十个工作日内", "截止日期2027年14月2日，不得晚于2027-12-3", "起45日内", "常年开放"]) == [
        "2027-04-06 截止", "2027-02-03 至 2027-02-27", "2027-03-04 至 2027-03-29", "公告发布起 20 工作日内",
        "2027-12-03 截止", "公告发布起 45 日内", None]


def test_amounts_and_quotas(spark):
    assert values(spark, facts.amount, [
        "硕士7万元、高级工4万元、大专1万元", "租金每月标准为860元", "购房给一次性奖励6万元", "资助额度：4.5万",
        "推出64套，另配租35套", "本科2万，本科2万元，共17户，合计9间", "面议"]) == [
        "硕士7万元 / 高级工4万元 / 大专1万元", "每月 860 元", "一次性 6 万元", "4.5 万元", "房源 99 套",
        "本科2万元 ｜ 房源 17 户 ｜ 房源 9 间", None]


def test_audience_age_channel_summary(spark):
    assert values(spark, lambda c: facts.audience(c, F.lit("")), ["学士、应届生，毕业五年内", "x"]) == [
        "本科 / 应届毕业生 / 毕业5年内", None]
    assert values(spark, lambda c: facts.audience(c, F.lit(""), 5), ["12345本科"]) == [None]
    assert values(spark, facts.age_limit, ["年龄在42岁以下", "不满16岁的儿童", "未满14岁儿童，不超过55岁", "年龄20至50岁"]) == [
        "42周岁以下", None, "55周岁以下", "20-50周岁"]
    assert values(spark, facts.apply_channel, [
        "https://a.gov.cn/apply/x.", "https://a.gov.cn/x.pdf 登录“某市人才服务平台”", "现场"]) == [
        "https://a.gov.cn/apply/x", "某市人才服务平台", None]
    long = "内容" * 80
    assert values(spark, facts.summary, ["各有关单位：" + "内容" * 20 + "\n" + long, "短"]) == [long, None]
    assert values(spark, lambda c: facts.summary(c, V.SUMMARY_MAX_CHARS), [long, "短"]) == [long[:130] + "…", None]


def test_admission(spark):
    pairs = [("关于公寓的公告", "/a.html", True), ("关于公寓的公告", "JavaScript:void(0)", False), ("关于公寓的公告", "/a.PDF?x=1", False),
             ("关于公寓的公告", "/a.pdfx", True), ("首页", "/a", False), ("123456", "/a", False), ("关于公寓的公告", "", False),
             ("关于公寓的公告", "/a?f=x.pdf", True)]
    rows = spark.createDataFrame(pairs, "t string, h string, ok boolean")
    assert all(r.ok == r.got for r in rows.withColumn("got", admission.admitted_by_rule(F.col("t"), F.col("h"))).collect())


def test_actionable(spark):
    rows = spark.createDataFrame([(None, "以官方公告为准", "详见官方正文"), ("3万", "以官方公告为准", "详见官方正文"),
                                  ("", "2026-01-01", None)], "a string, d string, p string")
    assert [r[0] for r in rows.select(keys.has_actionable_detail(F.col("a"), F.col("d"), F.col("p"))).collect()] == [
        False, True, True]


WORDS = ["公告", "公告栏", "住房保障", "Notice", "名单a", "补贴", "a"]


def test_reduced_texts_contain_the_same_words(spark):
    r = random.Random(2)
    texts = ["".join(r.choice([*WORDS, "公", "告", "notice", " ", "Note", "房 保", "z" * 9, "\n"]) for _ in range(r.randrange(30))) for _ in range(200)]
    for words in (WORDS, WORDS[:3], [], ["\n"]):
        got = values(spark, lambda c: T.reduced(c, words), texts)
        assert [[w in t for w in words] for t in texts] == [[w in t for w in words] for t in got]
        assert all(len(g) <= len(t) for t, g in zip(texts, got))


def test_dense_texts_hold_the_same_facts(spark):
    r = random.Random(3)
    prose = ["the quick brown fox jumps over the lazy dog " * 6, "naïve éé ", " " * 300, "\n", "x" * 200, "see https://a.example.org/" + "p" * 90 + " now ",
             "2025-3-4", " - ", "至", "below"]
    facts_ = ["年龄在42岁以下", "年龄 35 岁 below ", "截止日期：2025年4月6日", "一次性", "补贴", "博士5万元、硕士4万元", "通过", "青年服务小程序", "毕业四年内", "提供64套", "每月 860 元"]
    texts = ["".join(r.choice(prose if r.random() < 0.6 else facts_) for _ in range(r.randrange(1, 14))) for _ in range(300)]
    thin = values(spark, T.dense, texts)
    assert sum(map(len, thin)) < 0.6 * sum(map(len, texts))
    pattern = "一次性.*补贴|租赁"
    raw = {"deadline": facts._deadline, "amount": facts._amount, "audience": lambda c: facts._audience(c, F.lit("t")), "age": facts._age_limit,
           "channel": lambda c: facts._apply_channel(c, c), "category": lambda c: c.rlike(pattern), "batch": lambda c: titles.title_notes(c, F.lit(None))}
    for name, expr in raw.items():
        assert values(spark, expr, texts) == (values(spark, expr, thin) if name != "channel" else values(spark, facts.apply_channel, texts)), name
    assert any(values(spark, facts.deadline, texts)) and any(values(spark, facts.age_limit, texts))


def test_first_of_each_key_in_order(spark):
    rows = spark.createDataFrame([([("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5), (None, 6), ("c", 7)],), ([],)], "x array<struct<k:string,n:int>>")
    got = [[y.n for y in r[0]] for r in rows.select(T.first_by(F.col("x"), "k")).collect()]
    assert got == [[1, 2, 4, 7], []]


def test_many_terms(spark):
    lex = lexicon.Lexicon(terms={chr(0x4E00 + i % 5000) + chr(0x4E00 + i // 7) + "房": 1.0 for i in range(2000)}, blocklist=())
    titles_ = ["一一房屋和" + "long english text " * 400, "丁一房丂一房"]
    got = values(spark, lambda c: lexicon.score(c, F.lit("x"), F.lit("y"), lex), titles_)
    want = [sum(w for t, w in lex.terms.items() if t in x) * (0.5 if len(x) < 10 else 1) for x in titles_]
    assert got == want and got[0] > 0
