"""Pages, JSON bodies and rules."""

import json

import pytest
from pyspark.sql import functions as F

from noticeboard.sources import fetched, html_nodes, listing, rules as rule_ops

LIST_PAGE = """<html><body><nav><a href="/nav">导航一导航一导航一</a></nav><div class="wrap"><ul class="list plain">
<li><a href="./a/1.html" title="关于开展人才公寓配租的公告（完整标题）">关于开展…</a><span class="date">2026-08-20</span></li>
<li><a href="/b/2.html">关于发放<b>租房</b>补贴的通知</a><em>2026年8月19日</em></li>
<li><a href="javascript:void(0)">关于脚本链接的通知公告</a></li><li><a href="/x.pdf">附件下载某某某某</a></li>
<li><a href="/p2">下一页</a></ul></div></body></html>"""
TABLE_PAGE = """<body><div><a href=/1>首页</a><a href=/2>更多</a><a href=/3>登录</a></div><table><tbody>
<tr><td><a href="/n/1">第一条很长的公告标题内容</a></td><td>2026-08-01</td></tr><tr><td><a href="/n/2">第二条很长的公告标题内容</a></td><td>2026-08-02
<tr><td><a href="/n/3">第三条很长的公告标题内容</a></td><td>8-3</td></tr></table>"""
RULE = ("rule_id string, city string, district string, source_name string, category string, "
        "selectors struct<list_item:string,title:string,link:string,date:string>")


def items(spark, html, list_item):
    pages = spark.createDataFrame([("r", "https://h.cn/l/index.html", 1, html)], "rule_id string, url string, page int, html string")
    rules = spark.createDataFrame([("r", "深圳", "全市", "s", "housing", (list_item, "a", "a", "span, em"))], RULE)
    return [(r.title, r.url, r.publish_date, r.from_fallback) for r in listing.listing_items(pages, rules).orderBy("position").collect()]


@pytest.mark.parametrize("selector", ["ul.list li", "div.none li, div.wrap ul.list.plain li", ".wrap li", "li"])
def test_rule_listing(spark, selector):
    assert items(spark, LIST_PAGE, selector) == [
        ("关于开展人才公寓配租的公告（完整标题）", "https://h.cn/l/a/1.html", "2026-08-20", False),
        ("关于发放租房补贴的通知", "https://h.cn/b/2.html", "2026-08-19", False)]


def test_fallback_listing(spark):
    assert items(spark, TABLE_PAGE, "ul.gone li") == [
        ("第一条很长的公告标题内容", "https://h.cn/n/1", "2026-08-01", True),
        ("第二条很长的公告标题内容", "https://h.cn/n/2", "2026-08-02", True),
        ("第三条很长的公告标题内容", "https://h.cn/n/3", None, True)]
    assert items(spark, "<p>no list</p>", "li") == []


def main_text(spark, html):
    return spark.createDataFrame([(html,)], "html string").withColumn("n", html_nodes.nodes_of(F.col("html"))).select(
        listing.main_text(F.col("n"))).collect()[0][0]


def test_main_text(spark):
    body = "".join(f"<p>正文段落{i}，{'内容' * 10}</p>" for i in range(10))
    lines = "\n".join(f"正文段落{i}，{'内容' * 10}" for i in range(10))
    assert main_text(spark, f'<div class="article"><h1>标题</h1><div class="TRS_Editor">{body}</div></div>') == lines
    links = "".join(f'<a href="/{i}">很长的导航链接文字{i}</a>' for i in range(60))
    assert main_text(spark, f"<div>{links}</div><td>{body}</td><script>var x='<div>'</script>") == lines
    assert main_text(spark, "<title>t</title><div>短</div>") == "t\n短"
    assert main_text(spark, "<div><p>没有<b>关闭") == "没有\n关闭"


def test_nodes_of_broken_markup(spark):
    html = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<br>g</b></div><!-- x --><a href='1'>h<a href='2'>i"
    nodes = html_nodes.nodes_table(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    parents = {n.own_text: next(p for p in nodes if p.node_id == n.parent_id) for n in nodes if n.own_text}
    assert [parents[t].tag for t in "abcdefghi"] == ["li"] * 4 + ["p"] * 3 + ["a"] * 2
    assert parents["c"].depth == parents["b"].depth + 2 and parents["a"].depth == parents["d"].depth
    assert html_nodes.nodes_table(spark.createDataFrame([(1, None), (2, "")], "page_id int, html string")).count() == 0


def test_decode(spark):
    text = "关于公租房的公告，朱镕基"
    gb = f'<meta http-equiv="Content-Type" content="text/html; charset=gb2312">{text}'
    rows = [(1, gb.encode("gb18030"), None, None), (2, text.encode("gbk"), None, "GBK"), (3, text.encode("utf-8"), None, "ISO-8859-1"),
            (4, text.encode("gb18030"), "gb18030", "utf-8"), (5, b"ok\xff", None, None), (6, text.encode(), None, "no-such-charset")]
    df = spark.createDataFrame(rows, "i int, content binary, forced_charset string, header_charset string")
    got = {r.i: r.html for r in fetched.decode_pages(df).collect()}
    assert got == {1: gb, 2: text, 3: text, 4: text, 5: "ok�", 6: text}


def test_json_items(spark):
    body = json.dumps({"data": {"rows": [
        {"t": "关于公寓的公告通知", "u": "a.html", "d": "2026-08-01"}, {"t": "短", "u": "b"}, "x", 3, {"t": "没有链接的公告"},
        {"t": "关于公寓的公告通知", "u": "a.html", "d": 20260802}]}}, ensure_ascii=False)
    path = "struct<list:string,title:string,link:string,date:string,html:string>"
    rows = [("r", "https://h.cn/l/api", body, (p, "t", "u", "d", None)) for p in ("data.rows", "data.rows.deeper", "data", "no.path")]
    df = spark.createDataFrame(rows, f"rule_id string, url string, body string, json_path {path}")
    got = fetched.json_items(df).orderBy("position").collect()
    assert [(r.url, r.publish_date) for r in got] == [("https://h.cn/l/a.html", "2026-08-01")] * 2 + [("https://h.cn/l/a.html", "2026-08-02")] * 2
    html = json.dumps({"data": {"html": "<ul></ul>", "blank": " "}})
    pages = spark.createDataFrame([("r", "u", html, (None, None, None, None, p)) for p in (None, "data.blank", "data.x")],
                                  f"rule_id string, url string, body string, json_path {path}")
    assert [r.html for r in fetched.json_html_pages(pages).collect()] == ["<ul></ul>"]


def test_outcomes(spark):
    rows = [("html", 404, "NOT_FOUND"), ("html", 410, "NOT_FOUND"), ("html", 401, "BLOCKED"), ("html", 412, "BLOCKED"), ("html", 500, "ERROR"),
            ("json", 404, "BLOCKED"), ("json_html", 403, "ERROR"), ("html", None, "ERROR"), ("html", 200, None)]
    df = spark.createDataFrame(rows, "kind string, status int, want string")
    got = df.withColumn("got", fetched.fetch_outcome(F.col("kind"), F.col("status"), F.lit(None).cast("string"))).collect()
    assert all(r.want == r.got for r in got)


def test_contiguous_prefix(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, True), ("c", 1, False), ("c", 2, False)]
    df = spark.createDataFrame(rows, "rule_id string, page int, failed boolean")
    assert sorted((r.rule_id, r.page) for r in fetched.contiguous_prefix(df).collect()) == [("a", 1), ("c", 1), ("c", 2)]


def test_rules_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "rules.yaml"
    path.write_text("rules:\n  - {id: a, city: 深圳, source_name: s, url: 'https://x', max_pages: 3, verified: true,\n"
                    "     selectors: {list_item: ul li, date: null}, params: {n: 3, e: null}}\n  - text\n  - {id: b, url: ftp://x}\n", encoding="utf-8")
    rules = rule_ops.load_rules(spark, str(path))
    got = {r.id: r for r in rule_ops.check_rules(rules).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].problems == [] and got["a"].params == {"n": "3", "e": None} and got["a"].max_pages == 3
    assert len(got["b"].problems) == 3
    with pytest.raises(KeyError):
        rule_ops.delete_rule(rules, "zzz")
    assert rule_ops.delete_rule(rules, "a").count() == 1


def test_rule_upsert(spark):
    rules = spark.createDataFrame([(0, "r0", "u0", "c0"), (1, None, "u1", "c1"), (2, "r2", "u0", "c2")], "pos long, id string, url string, city string")
    changes = spark.createDataFrame([(1, "u0", "n0"), (2, "u1", "n1"), (3, "u9", "n8"), (4, "u9", "n9")], "pos long, url string, city string")
    got = {(r.url, r.id, r.city) for r in rule_ops.upsert_rules(rules, changes).collect()}
    assert got == {("u0", "r0", "n0"), ("u1", "rule_3_n1", "n1"), ("u0", "r2", "c2"), ("u9", "rule_6_n9", "n9")}
