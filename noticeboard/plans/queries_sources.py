"""Queries over pages, listings, JSON bodies, rules and the catalogue."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import admission
from noticeboard.functions.text import array_of
from noticeboard.functions.urls import resolve_url
from noticeboard.operators import catalog as cat
from noticeboard.operators import dedup, details, filters, reports
from noticeboard.plans import bindings as B
from noticeboard.plans.queries_facts import sql_clean, sql_strip
from noticeboard.plans.queries_ledger import KEYED_SQL, keyed
from noticeboard.plans.queries_notices import JUDGED_SQL, KEPT_SQL, judged, kept, sql_text
from noticeboard.plans.registry import query
from noticeboard.session import scratch_path
from noticeboard.sources import fetched, html_nodes, listing, rules as rule_ops


# --------------------------------------------------------------------------
# listing pages: twenty orders are one page; each order is one row of it
# --------------------------------------------------------------------------
def listing_rows(spark, sf) -> DataFrame:
    o, k = B.table(spark, sf, "orders"), F.col("o_orderkey")
    text = k.cast("string")
    page = F.floor(k / 20)
    good_href = (F.when(k % 4 == 0, F.concat(F.lit("../n/"), text, F.lit(".html?id="), text))
                 .when(k % 4 == 1, F.concat(F.lit("/abs/"), text))
                 .when(k % 4 == 2, F.concat(F.lit("https://x.example.org/"), text))
                 .otherwise(F.concat(F.lit("//y.example.org/"), text)))
    return o.select(
        k, page.alias("page_no"), (page % 3).alias("kind"),
        F.when(k % 10 == 7, "简讯").otherwise(F.concat(
            B.pick(B.PLACES, k), B.pick(B.TERMS, k), B.pick(B.TERMS, page), B.pick(B.KINDS, page), F.lit("第"), text, F.lit("号")
        )).alias("title"),
        F.when(k % 10 == 3, "javascript:void(0)").when(k % 10 == 5, F.concat(F.lit("/f/"), text, F.lit(".PDF?x=1")))
         .otherwise(good_href).alias("href"),
        F.when(k % 9 == 0, "未定").otherwise(F.date_format(F.date_add("o_orderdate", 9200), "yyyy-MM-dd")).alias("day"))


LISTING_SQL = f"""
listing_rows AS (
  SELECT o_orderkey, o_orderkey // 20 AS page_no, (o_orderkey // 20) % 3 AS kind,
    CASE WHEN o_orderkey % 10 = 7 THEN '简讯' ELSE {B.sql_pick(B.PLACES, 'o_orderkey')} || {B.sql_pick(B.TERMS, 'o_orderkey')}
      || {B.sql_pick(B.TERMS, 'o_orderkey // 20')} || {B.sql_pick(B.KINDS, 'o_orderkey // 20')} || '第' || o_orderkey || '号' END AS title,
    CASE o_orderkey % 4 WHEN 0 THEN 'https://gov' || (o_orderkey // 20) || '.example.org/list/n/' || o_orderkey || '.html?id=' || o_orderkey
      WHEN 1 THEN 'https://gov' || (o_orderkey // 20) || '.example.org/abs/' || o_orderkey
      WHEN 2 THEN 'https://x.example.org/' || o_orderkey ELSE 'https://y.example.org/' || o_orderkey END AS url,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE) + 9200, '%Y-%m-%d') END AS publish_date
  FROM orders),
listed AS (SELECT * FROM listing_rows WHERE o_orderkey % 10 NOT IN (3, 5, 7))"""


def listing_pages(spark, sf) -> DataFrame:
    """Page key and size are bounded by the key construction: at most twenty rows each."""
    r = listing_rows(spark, sf)
    link = F.concat(F.lit('<a href="'), "href", F.lit('"'))
    row = (F.when(F.col("kind") == 0, F.concat(F.lit("<li>"), link, F.lit(' title="'), "title", F.lit('">公告…</a><span class="date">'), "day", F.lit("</span>")))
           .when(F.col("kind") == 1, F.concat(F.lit("<tr><td>"), link, F.lit(">"), "title", F.lit("</a><td>"), "day"))
           .otherwise(F.concat(F.lit("<li>"), link, F.lit("> "), "title", F.lit(" </a> "), "day", F.lit("</li>"))))
    rows = r.groupBy("page_no", "kind").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    opening = F.when(F.col("kind") == 1, "<table class='list'><tbody>").otherwise("<ul class='news-list old'>")
    closing = F.when(F.col("kind") == 1, "</tbody></table>").otherwise("</ul>")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>列表</title></head><body><nav><ul><li><a href='/1'>网站导航首页链接</a></ul></nav><div id='main'>"),
        opening, "rows", closing, F.lit("</div><footer><a href='/2'>版权声明与联系方式链接</a></footer></body></html>"))
    number = F.col("page_no").cast("string")
    return rows.select(
        F.concat(F.lit("r"), F.col("kind").cast("string")).alias("rule_id"), "page_no", F.lit(1).alias("page"),
        F.concat(F.lit("https://gov"), number, F.lit(".example.org/list/a/index_"), number, F.lit(".html")).alias("url"),
        page.alias("html"))


def listing_rules(spark) -> DataFrame:
    """The three rules of the listing pages; the selectors of the third match nothing."""
    rows = [("r0", "深圳", "全市", "住房保障中心", "housing", ("div#main ul.news-list li, ul.none li", "a", "a", "span.date, em")),
            ("r1", "北京", "全市", "人社局", "subsidy", ("table.list tr", "a", "a", "td.date")),
            ("r2", "上海", "全市", "政府网", "other", ("ul.missing li", "a", "a", "span"))]
    return spark.createDataFrame(rows, "rule_id string, city string, district string, source_name string, category string, "
                                       "selectors struct<list_item:string,title:string,link:string,date:string>")


@query("s5_rule_listing", f"WITH {LISTING_SQL} SELECT title, url, publish_date, kind = 2 AS from_fallback FROM listed")
def s5(spark, sf):
    return listing.listing_items(listing_pages(spark, sf), listing_rules(spark)).select(
        "title", "url", "publish_date", "from_fallback")


@query("s8_heuristic_listing", f"WITH {LISTING_SQL} SELECT title, url, publish_date FROM listed")
def s8(spark, sf):
    pages = listing_pages(spark, sf).withColumn("nodes", html_nodes.nodes_of(F.col("html")))
    return pages.select(F.inline(listing.heuristic_items(F.col("nodes"), F.col("url")))).select("title", "url", "publish_date")


@query("s8_heuristic_on_pages")
def s8_pages(spark, sf):
    pages = B.table(spark, sf, "pages")
    chrome = [t for t in V.CHROME_TAGS if t != "nav"]
    items = pages.withColumn("nodes", html_nodes.nodes_of(F.col("html"), chrome)).select(
        "page_id", F.inline_outer(listing.heuristic_items(F.col("nodes"), F.col("url"), min_title_chars=2)))
    return items.filter(F.col("title").isNotNull()).select("page_id", "title", "url", "publish_date")


@query("w3_best_container", f"WITH {LISTING_SQL} SELECT page_no, count(*) AS n FROM listed GROUP BY 1")
def w3(spark, sf):
    pages = listing_pages(spark, sf)
    return pages.withColumn("nodes", html_nodes.nodes_of(F.col("html"))).select(
        "page_no", F.size(listing.heuristic_items(F.col("nodes"), F.col("url"))).cast("bigint").alias("n"))


def _count_sql(tag: str) -> str:
    return f"len(regexp_extract_all(html, '<{tag}[ >]'))"


@query("s4_nodes", f"""SELECT page_id, {_count_sql('a')} AS n_a, {_count_sql('p')} AS n_p, {_count_sql('li')} AS n_li, {_count_sql('h1')} AS n_h1,
  trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title FROM pages""")
def s4(spark, sf):
    nodes = html_nodes.nodes_table(B.table(spark, sf, "pages"), chrome_tags=())
    title_id = F.when(F.col("tag") == "title", F.col("node_id"))
    counts = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("a", "p", "li", "h1")]
    is_title = (F.col("tag") == "#text") & (F.col("depth") > 0)
    texts = F.min_by("own_text", F.when(is_title, F.col("node_id")))
    return nodes.groupBy("page_id").agg(*counts, texts.alias("title"))


@query("s4_nodes_in_sql", f"""SELECT page_id, {_count_sql('a')} AS n_a, {_count_sql('p')} AS n_p, {_count_sql('li')} AS n_li, {_count_sql('h1')} AS n_h1,
  len(regexp_extract_all(html, ' href="')) AS n_links FROM pages""")
def s4_sql(spark, sf):
    """Nodes by the table function, in a lateral join."""
    html_nodes.register_nodes_function(spark, chrome_tags=())
    counts = ", ".join(f"count_if(tag = '{t}') AS n_{t}" for t in ("a", "p", "li", "h1"))
    return spark.sql(f"SELECT page_id, {counts}, count_if(map_contains_key(attrs, 'href')) AS n_links "
                     "FROM {pages}, LATERAL html_nodes(html) GROUP BY page_id", pages=B.table(spark, sf, "pages"))


@query("x1_main_text_on_pages")
def x1_pages(spark, sf):
    pages = B.table(spark, sf, "pages").withColumn("nodes", html_nodes.nodes_of(F.col("html")))
    return pages.select("page_id", listing.main_text(F.col("nodes")).alias("main_text"))


_OPEN = ['<div class="x TRS_Editor">', '<div class="body">', "<article>"]
_CLOSE = ["</div>", "</div>", "</article>"]
_HEAD = ('<html><head><title>页面</title><style>p{margin:0}</style></head><body><nav><a href="/">导航</a></nav>'
         '<div class="menu"><a href="/1">栏目一</a><a href="/2">栏目二</a></div>')


@query("x1_main_text", f"""WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '') AS ls FROM documents),
body AS (SELECT doc_id, array_to_string(ls, chr(10)) AS b FROM lines)
SELECT doc_id, {sql_clean("CASE WHEN length(b) >= 120 THEN b ELSE '页面' || chr(10) || '栏目一' || chr(10) || '栏目二' || CASE WHEN b = '' THEN '' ELSE chr(10) || b END END")} AS main_text
FROM body""")
def x1(spark, sf):
    i = F.col("doc_id")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit(_HEAD), B.pick(_OPEN, i), F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"),
                    B.pick(_CLOSE, i), F.lit("</body></html>"))
    docs = B.table(spark, sf, "documents").select("doc_id", html_nodes.nodes_of(page).alias("nodes"))
    return docs.select("doc_id", listing.main_text(F.col("nodes")).alias("main_text"))


# --- link admission, url resolution, list score -----------------------------------------
@query("s6_link_admission", "SELECT o_orderkey, o_orderkey % 10 NOT IN (3, 5, 7) AS admitted FROM orders")
def s6(spark, sf):
    return listing_rows(spark, sf).select("o_orderkey", admission.admitted_by_rule(F.col("title"), F.col("href")).alias("admitted"))


@query("s9_heuristic_admission", "SELECT o_orderkey, o_orderkey % 10 NOT IN (3, 5, 7) AND o_orderkey % 11 <> 0 AS admitted FROM orders")
def s9(spark, sf):
    title = F.when(F.col("o_orderkey") % 22 == 0, F.concat("title", F.lit(" 下一页"))).when(
        F.col("o_orderkey") % 11 == 0, "20240815001").otherwise(F.col("title"))
    return listing_rows(spark, sf).select("o_orderkey", admission.admitted_by_heuristic(title, F.col("href")).alias("admitted"))


@query("s7_resolve_url", r"""WITH parts AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root,
    regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
folders AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM parts)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://z.org/a?b#c' WHEN 1 THEN scheme || '://cdn.org/x' WHEN 2 THEN root || '/abs?x=1'
  WHEN 3 THEN root || path || '?page=9' WHEN 4 THEN root || folder || 'rel/n.html#f'
  ELSE root || regexp_replace(folder, '[^/]+/$', '') || 'up.html' END AS url FROM folders""")
def s7(spark, sf):
    hrefs = ["https://z.org/a?b#c", "//cdn.org/x", "/abs?x=1", "?page=9", "rel/n.html#f", "../up.html"]
    return B.table(spark, sf, "pages").select("page_id", resolve_url(F.col("url"), B.pick(hrefs, F.col("page_id"))).alias("url"))


@query("a3_list_score", f"""WITH {LISTING_SQL}, g AS (SELECT page_no, count(*) AS n, count(publish_date) AS dated, avg(length(title)) AS a,
    var_pop(length(title)) AS v FROM listed GROUP BY 1)
SELECT page_no, round(least(n / 10, 2) + 3.0 * dated / n + CASE WHEN a BETWEEN 12 AND 70 THEN 2 WHEN a < 8 THEN -1.5 ELSE 0 END
  + CASE WHEN v < 400 THEN 1 ELSE 0 END, 6) AS score FROM g""")
def a3(spark, sf):
    rows = listing_rows(spark, sf).filter(admission.admitted_by_rule(F.col("title"), F.col("href")))
    n = F.length("title").cast("double")
    g = rows.groupBy("page_no").agg(
        F.count("*").cast("double").alias("n"), F.count_if(F.col("day") != "未定").cast("double").alias("dated"),
        F.avg(n).alias("a"), F.var_pop(n).alias("v"))
    return g.select("page_no", F.round(listing.list_score_of(F.col("n"), F.col("dated"), F.col("a"), F.col("v")), 6).alias("score"))


# --- JSON listings -------------------------------------------------------------------------
def json_pages(spark, sf) -> DataFrame:
    r = listing_rows(spark, sf)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "title", "href", "day"))), lambda x: F.struct(
        x["title"].alias("name"), x["href"].alias("link"), x["day"].alias("pubDate"), x["o_orderkey"].alias("id")))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.struct(rows.alias("rows")).alias("page")).alias("data")))
    pages = r.groupBy("page_no").agg(body.alias("body"))
    number = F.col("page_no").cast("string")
    return pages.select(
        F.lit("j").alias("rule_id"), F.concat(F.lit("https://gov"), number, F.lit(".example.org/list/a/api")).alias("url"), "body",
        F.struct(F.lit("data.page.rows.more").alias("list"), F.lit("name").alias("title"), F.lit("link").alias("link"),
                 F.lit("pubDate").alias("date"), F.lit(None).cast("string").alias("html")).alias("json_path"))


@query("s10_json_listing", f"""WITH {LISTING_SQL} SELECT title,
  CASE WHEN o_orderkey % 10 = 3 THEN 'javascript:void(0)' WHEN o_orderkey % 10 = 5 THEN 'https://gov' || page_no || '.example.org/f/' || o_orderkey || '.PDF?x=1'
    ELSE url END AS url, publish_date FROM listing_rows WHERE o_orderkey % 10 <> 7""")
def s10(spark, sf):
    return fetched.json_items(json_pages(spark, sf)).select("title", "url", "publish_date")


@query("s11_json_html", f"WITH {LISTING_SQL} SELECT title, url, publish_date FROM listed")
def s11(spark, sf):
    pages = listing_pages(spark, sf)
    responses = pages.select("rule_id", "url", F.to_json(F.struct(F.struct("html").alias("data"))).alias("body"), F.struct(
        F.lit("data.html").alias("html")).alias("json_path"))
    return listing.listing_items(fetched.json_html_pages(responses), listing_rules(spark)).select("title", "url", "publish_date")


# --- bytes ----------------------------------------------------------------------------------
@query("s3_decode", """SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'utf-16le' ELSE 'utf-8' END AS charset, html FROM pages""")
def s3(spark, sf):
    wide = F.col("page_id") % 4 == 1
    raw = B.table(spark, sf, "pages").select(
        "page_id", F.when(wide, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8")).alias("content"),
        F.when(wide, "UTF-16LE").alias("forced_charset"), F.lit("iso-8859-1").alias("header_charset"))
    return fetched.decode_pages(raw).select("page_id", "charset", "html")


CHARSETS = [None, "gbk", "utf-16"]


def page_files(spark, sf) -> str:
    """A new folder with every page as one file, in one of three charsets that only its bytes tell."""
    folder = scratch_path(spark, "page-files")

    def store(batches):
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                charset = CHARSETS[row["page_id"] % 3]
                sub = f"{root}/{row['page_id'] % 64}"
                files.create_dir(sub)
                head = f'<meta charset="{charset}">' if charset == "gbk" else ""
                # a task that runs again writes the same bytes
                with files.open_output_stream(f"{sub}/{row['page_id']}.html") as out:
                    out.write((head + (row["html"] or "")).encode("gb18030" if charset == "gbk" else charset or "utf-8"))
                yield pa.RecordBatch.from_pydict({"page_id": [row["page_id"]]})

    pages = B.table(spark, sf, "pages").select("page_id", "html")
    pages.mapInArrow(store, "page_id long").write.format("noop").mode("overwrite").save()
    return folder


@query("s3_page_files", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gb18030' ELSE 'utf-16' END AS charset,
  CASE WHEN page_id % 3 = 1 THEN '<meta charset="gbk">' || html ELSE html END AS html FROM pages""")
def s3_files(spark, sf):
    files = fetched.page_files(spark, page_files(spark, sf), "*.html")
    number = F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long")
    return fetched.decode_pages(files).select(number.alias("page_id"), "charset", "html")


# --- frontier, dedup within a source, outcomes -------------------------------------------------
@query("s12_contiguous_prefix", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_returnflag = 'A' AND f.l_linenumber <= l.l_linenumber)
GROUP BY 1, 2""")
def s12(spark, sf):
    f = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("failed"))
    return fetched.contiguous_prefix(f, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("w4_first_failure", "SELECT l_orderkey, min(l_linenumber) AS first_failed FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def w4(spark, sf):
    f = B.table(spark, sf, "lineitem").withColumn("failed", F.col("l_returnflag") == "A")
    return fetched.first_failures(f, "l_orderkey", "l_linenumber")


@query("s12_page_frontier", """SELECT 'r' || s_suppkey AS id, p AS page,
  'https://s' || s_suppkey || '.example.org/list/' || CASE WHEN p = 1 THEN 'index.html' ELSE 'index_' || p || '.html' END AS page_url
FROM (SELECT s_suppkey, unnest(range(1, CAST(s_suppkey % 4 + 2 AS BIGINT))) AS p FROM supplier)""")
def s12_frontier(spark, sf):
    return fetched.page_frontier(rules(spark, sf)).select("id", F.col("page").cast("bigint").alias("page"), "page_url")


@query("s13_first_in_source", f"WITH {KEYED_SQL} SELECT city, unique_id, min(notice_id) AS notice_id FROM keyed GROUP BY 1, 2")
def s13(spark, sf):
    return dedup.first_per_key(keyed(spark, sf).select("city", "unique_id", "notice_id", "title"),
                               ["city", "unique_id"], ["notice_id"]).select("city", "unique_id", "notice_id")


@query("w2_first_occurrence", f"WITH {KEYED_SQL} SELECT arg_min(title, notice_id) AS title, unique_id FROM keyed GROUP BY unique_id")
def w2(spark, sf):
    return dedup.first_per_key(keyed(spark, sf).select("unique_id", "notice_id", "title"), ["unique_id"], ["notice_id"]).select(
        "title", "unique_id")


@query("w5_detail_budget", f"WITH {KEPT_SQL} SELECT notice_id FROM (SELECT * FROM kept ORDER BY relevance_score DESC, notice_id LIMIT {V.DETAIL_LIMIT})")
def w5(spark, sf):
    return details.top_by_score(kept(spark, sf), V.DETAIL_LIMIT, "notice_id").select("notice_id")


CODES = [200, 404, 410, 400, 401, 405, 451, 403, 406, 412, 500]


def fetch_log(spark, sf) -> DataFrame:
    i = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(c) for c in CODES]), (i % 11 + 1).cast("int"))
    return B.table(spark, sf, "events").select(
        i, F.when(i % 3 == 0, "json").when(i % 3 == 1, "json_html").otherwise("html").alias("kind"),
        F.when(i % 13 != 0, status).alias("http_status"), F.when((i % 13 == 0) | (i % 17 == 0), "timeout").alias("error"))


@query("s14_fetch_outcome", f"""WITH f AS (SELECT event_id, event_id % 3 < 2 AS js, CASE WHEN event_id % 13 <> 0 THEN {CODES}[event_id % 11 + 1] END AS s,
    event_id % 13 = 0 OR event_id % 17 = 0 AS err FROM events)
SELECT event_id, CASE WHEN s = 200 AND NOT err THEN NULL WHEN js THEN CASE WHEN s IN (400, 401, 404, 405, 410, 451) THEN 'BLOCKED' ELSE 'ERROR' END
  WHEN s IN (404, 410) THEN 'NOT_FOUND' WHEN s IN (400, 401, 405, 451, 403, 406, 412) THEN 'BLOCKED' ELSE 'ERROR' END AS outcome FROM f""")
def s14(spark, sf):
    return fetch_log(spark, sf).select("event_id", fetched.fetch_outcome(F.col("kind"), F.col("http_status"), F.col("error")).alias("outcome"))


# --- rules ---------------------------------------------------------------------------------------
def rules(spark, sf) -> DataFrame:
    s, k = B.table(spark, sf, "supplier"), F.col("s_suppkey")
    text = k.cast("string")
    return s.select(
        F.col("s_suppkey").alias("pos"), F.concat(F.lit("r"), text).alias("id"),
        F.concat(F.lit("CITY_"), F.col("s_nationkey").cast("string")).alias("city"),
        F.when(k % 3 == 0, F.lit("North CITY_1")).otherwise(V.WHOLE_CITY).alias("district"), F.col("s_name").alias("source_name"),
        B.pick(V.CATEGORIES, k).alias("category"),
        F.concat(F.lit("https://s"), text, F.lit(".example.org/list/index.html")).alias("url"),
        F.lit("html").alias("parser_type"), (k % 4 + 1).cast("int").alias("max_pages"), F.lit("index_{page}.html").alias("page_pattern"))


RULES_SQL = f"""
rules AS (SELECT s_suppkey AS pos, 'r' || s_suppkey AS id, 'CITY_' || s_nationkey AS city,
  CASE WHEN s_suppkey % 3 = 0 THEN 'North CITY_1' ELSE '{V.WHOLE_CITY}' END AS district, s_name AS source_name,
  {B.sql_pick(V.CATEGORIES, 's_suppkey')} AS category, 'https://s' || s_suppkey || '.example.org/list/index.html' AS url FROM supplier)"""


def flawed_rules(spark, sf) -> DataFrame:
    p = F.col("pos")
    return rules(spark, sf).withColumns({
        "url": F.when(p % 5 == 0, "").when(p % 5 == 1, F.concat(F.lit("ftp://x/"), p.cast("string"))).otherwise(F.col("url")),
        "city": F.when(p % 7 != 0, F.col("city")), "source_name": F.when(p % 6 == 0, "").otherwise(F.col("source_name")),
        "parser_type": F.when(p % 8 == 0, "XML").when(p % 8 == 1, "JSON").when(p % 8 != 2, "html")})


PROBLEMS_SQL = f"""list_filter([CASE WHEN pos % 5 = 0 THEN '{V.PROBLEM_NO_URL}' WHEN pos % 5 = 1 THEN '{V.PROBLEM_URL_SCHEME}ftp://x/' || pos END,
  CASE WHEN pos % 7 = 0 THEN '{V.PROBLEM_NO_CITY}' END, CASE WHEN pos % 6 = 0 THEN '{V.PROBLEM_NO_SOURCE}' END,
  CASE WHEN pos % 8 = 0 THEN '{V.PROBLEM_PARSER}xml' END], lambda x: x IS NOT NULL)"""


@query("s2_rule_problems", f"WITH {RULES_SQL} SELECT id, array_to_string({PROBLEMS_SQL}, '; ') AS problems FROM rules")
def s2(spark, sf):
    return rule_ops.check_rules(flawed_rules(spark, sf)).select("id", F.array_join("problems", "; ").alias("problems"))


SELECTORS = ["ul.news li", "li:first-child", "a[href]", "#main > p", "td.date, em", ""]


@query("s2_selector_problems", f"""WITH {RULES_SQL} SELECT id, array_to_string({PROBLEMS_SQL}, '; ') AS problems,
  array_to_string(list_filter([CASE WHEN pos % 6 IN (1, 2, 3) THEN 'list_item: ' || {B.sql_pick(SELECTORS, 'pos')} END,
    CASE WHEN pos % 6 IN (0, 1, 2) THEN 'date: ' || {B.sql_pick(SELECTORS, 'pos + 1')} END], lambda x: x IS NOT NULL), '; ') AS selector_problems FROM rules""")
def s2_selectors(spark, sf):
    chosen = F.struct(B.pick(SELECTORS, F.col("pos")).alias("list_item"), F.lit("a").alias("title"), F.lit(None).cast("string").alias("link"),
                      B.pick(SELECTORS, F.col("pos") + 1).alias("date"))
    checked = rule_ops.check_rules(flawed_rules(spark, sf).withColumn("selectors", chosen))
    return checked.select("id", *[F.array_join(c, "; ").alias(c) for c in ("problems", "selector_problems")])


@query("s1_rule_listing", f"WITH {RULES_SQL} SELECT id, city, source_name, count(*) OVER () AS total FROM rules")
def s1(spark, sf):
    path = scratch_path(spark, "rules") + ".jsonl"
    rules(spark, sf).write.json(path)
    r = rule_ops.load_rules(spark, path)
    return r.select("id", "city", "source_name", r.agg(F.count("*").alias("total")).scalar().alias("total"))


@query("j3_source_results", f"""WITH {RULES_SQL},
log AS (SELECT l_suppkey, max(l_partkey) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
first AS (SELECT 'r' || l_suppkey AS id, CASE WHEN m % 7 = 0 THEN 404 WHEN m % 7 = 1 THEN 412 WHEN m % 7 = 2 THEN 500 ELSE 200 END AS s
  FROM log WHERE l_suppkey % 9 <> 4),
items AS (SELECT 'r' || l_suppkey AS id, count(*) AS n, 'item ' || min(l_orderkey) AS sample FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
j AS (SELECT rules.*, {PROBLEMS_SQL} AS problems, s, n, sample,
  CASE WHEN len({PROBLEMS_SQL}) > 0 THEN 'BAD_RULE' WHEN s IS NULL THEN 'ERROR' WHEN s = 404 THEN 'NOT_FOUND' WHEN s = 412 THEN 'BLOCKED'
    WHEN s = 500 THEN 'ERROR' ELSE '' END AS error_type FROM rules LEFT JOIN first USING (id) LEFT JOIN items USING (id))
SELECT id, CASE WHEN error_type = '' THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN error_type = '' THEN coalesce(n, 0) ELSE 0 END AS items_found,
  error_type, CASE WHEN len(problems) > 0 THEN array_to_string(problems, '; ') WHEN s IS NULL THEN 'not fetched' WHEN s <> 200 THEN 'HTTP ' || s END AS error,
  CASE WHEN error_type = '' THEN sample END AS sample_title FROM j""")
def j3(spark, sf):
    line = B.table(spark, sf, "lineitem")
    name = F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("rule_id")
    m = F.col("m") % 7
    log = line.groupBy("l_suppkey", F.col("l_linenumber").alias("page")).agg(F.max("l_partkey").alias("m")).filter(
        F.col("l_suppkey") % 9 != 4).select(
        name, "page", F.lit("html").alias("kind"), F.lit(None).cast("string").alias("error"),
        F.when(m == 0, 404).when(m == 1, 412).when(m == 2, 500).otherwise(200).alias("http_status"))
    items = line.filter(F.col("l_returnflag") == "N").select(
        name, F.concat(F.lit("item "), F.col("l_orderkey").cast("string")).alias("title"), F.col("l_orderkey").alias("pos"))
    return fetched.source_results(flawed_rules(spark, sf), log, items).select(
        "id", "status", "items_found", "error_type", "error", "sample_title")


@query("p5_subscription", f"WITH {RULES_SQL} SELECT id FROM rules WHERE city IN (SELECT 'CITY_' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def p5(spark, sf):
    subs = B.table(spark, sf, "nation").filter(F.col("n_regionkey") == 1).select(
        F.concat(F.lit("CITY_"), F.col("n_nationkey").cast("string")).alias("city"))
    return filters.select_rules_by_subscription(rules(spark, sf), subs).select("id")


@query("p6_city_filter", f"WITH {RULES_SQL} SELECT id FROM rules WHERE contains(city, 'CITY_12') OR contains('CITY_12', city)")
def p6(spark, sf):
    return filters.select_rules_by_city(rules(spark, sf), " CITY_12 ").select("id")


@query("p7_scan_filter", f"""WITH {RULES_SQL} SELECT id FROM rules WHERE contains(city, 'CITY_1') OR contains('CITY_1', city)
  OR contains(district, 'CITY_1') OR contains(source_name, 'CITY_1')""")
def p7(spark, sf):
    return filters.select_rules_for_scan(rules(spark, sf), "CITY_1").select("id")


@query("p10_city_list", f"""WITH {RULES_SQL} SELECT city, pos FROM (SELECT '{V.ALL_CITIES}' AS city, -1 AS pos UNION ALL
  SELECT city, min(pos) FROM rules GROUP BY city)""")
def p10(spark, sf):
    return reports.city_list(rules(spark, sf), "pos")


def changes(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return B.table(spark, sf, "part").select(
        (k + 1).alias("pos"), F.concat(F.lit("https://s"), F.floor(k / 2).cast("string"), F.lit(".example.org/list/index.html")).alias("url"),
        F.concat(F.lit("NEW_"), (k % 50).cast("string")).alias("city"), F.when(k % 3 != 0, "West").alias("district"),
        F.col("p_name").alias("source_name"), F.lit("other").alias("category"))


@query("u4_rule_upsert", f"""WITH {RULES_SQL},
changes AS (SELECT p_partkey + 1 AS pos, 'https://s' || (p_partkey // 2) || '.example.org/list/index.html' AS url, 'NEW_' || (p_partkey % 50) AS city,
  CASE WHEN p_partkey % 3 <> 0 THEN 'West' END AS district, p_name AS source_name, 'other' AS category FROM part),
last AS (SELECT url, min(pos) AS first_pos, max(pos) AS pos FROM changes GROUP BY url),
c AS (SELECT changes.*, first_pos FROM changes JOIN last USING (url, pos))
SELECT coalesce(rules.id, 'rule_' || ((SELECT count(*) FROM rules) + c.first_pos) || '_' || c.city) AS id, coalesce(rules.url, c.url) AS url,
  coalesce(c.city, rules.city) AS city, coalesce(c.district, rules.district) AS district, coalesce(c.source_name, rules.source_name) AS source_name
FROM rules FULL OUTER JOIN c ON rules.url = c.url""")
def u4(spark, sf):
    base = rules(spark, sf).select("pos", "id", "url", "city", "district", "source_name", "category")
    return rule_ops.upsert_rules(base, changes(spark, sf)).select("id", "url", "city", "district", "source_name")


@query("u5_rule_delete", f"WITH {RULES_SQL} SELECT id FROM rules WHERE id NOT IN (SELECT 'r' || s_suppkey FROM supplier WHERE s_acctbal < 2000)")
def u5(spark, sf):
    gone = B.table(spark, sf, "supplier").filter(F.col("s_acctbal") < 2000).select(
        F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("id"))
    return rule_ops.delete_rules(rules(spark, sf), gone).select("id")


@query("u1_union_of_sources", f"""WITH {B.NOTICES_SQL}, {B.OUTBOX_SQL}, u AS (SELECT city, title FROM notices UNION ALL SELECT city, title FROM outbox)
SELECT city, count(*) AS n, sum(length(title)) AS chars FROM u GROUP BY 1""")
def u1(spark, sf):
    both = B.notices(spark, sf).select("city", "title").unionByName(B.outbox(spark, sf).select("city", "title"))
    return both.groupBy("city").agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"))


@query("a10_rule_trial", f"""WITH {JUDGED_SQL}, trial AS (SELECT regexp_extract(source_name, '^src[0-9]+') AS rule_id, reason, notice_id FROM judged),
r AS (SELECT DISTINCT source AS rule_id FROM documents UNION ALL SELECT 'quiet ' || s_suppkey FROM supplier),
g AS (SELECT rule_id, count(*) AS raw, count(*) FILTER (reason = 'kept') AS hit, bool_or(notice_id % 97 = 0) AS fb FROM trial GROUP BY 1)
SELECT rule_id, coalesce(raw, 0) AS total_raw, coalesce(hit, 0) AS total_matched, coalesce(fb, false) AS used_fallback,
  CASE WHEN raw IS NULL THEN {sql_text(V.HINT_NO_ROWS)} WHEN hit = 0 THEN printf({sql_text(V.HINT_NO_MATCH)}, raw)
  ELSE printf({sql_text(V.HINT_OK)}, raw, hit) END AS hint FROM r LEFT JOIN g USING (rule_id)""")
def a10(spark, sf):
    trial = judged(spark, sf).select(F.regexp_extract("source_name", "^src[0-9]+", 0).alias("rule_id"), "reason",
                                     (F.col("notice_id") % 97 == 0).alias("from_fallback"))
    known = B.table(spark, sf, "documents").select(F.col("source").alias("rule_id")).distinct().unionByName(
        B.table(spark, sf, "supplier").select(F.concat(F.lit("quiet "), F.col("s_suppkey").cast("string")).alias("rule_id")))
    return reports.rule_trial(trial, known)


# --- catalogue --------------------------------------------------------------------------------------
TYPES = ["housing", "subsidy", "other"]


def catalog(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return B.table(spark, sf, "nation").select(F.col("n_name").alias("city"), k, F.posexplode(array_of(TYPES)).alias("i", "type")).select(
        (k * 3 + F.col("i")).alias("pos"), "city", "type", F.lit("tag").alias("tag"), F.concat("city", F.lit(" "), "type").alias("title"),
        F.concat("city", F.lit(" office")).alias("source_name"),
        F.when(F.col("i") == 2, "").otherwise(F.concat(F.lit("https://"), F.lower("city"), F.lit(".org/"), "type")).alias("url"),
        F.lit("d").alias("desc"), F.when(F.col("i") == 0, "ul.a li").alias("list_item"), (F.col("i") == 1).alias("verified"))


CATALOG_SQL = """
catalog AS (SELECT n_nationkey * 3 + i AS pos, n_name AS city, ['housing', 'subsidy', 'other'][i + 1] AS type,
  n_name || ' ' || ['housing', 'subsidy', 'other'][i + 1] AS title, n_name || ' office' AS source_name,
  CASE WHEN i = 2 THEN '' ELSE 'https://' || lower(n_name) || '.org/' || ['housing', 'subsidy', 'other'][i + 1] END AS url,
  CASE WHEN i = 0 THEN 'ul.a li' END AS list_item FROM nation, (SELECT unnest([0, 1, 2]) AS i))"""


def regions(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select(
        F.when(k % 97 == 0, " ").when(k % 4 == 0, F.concat(F.lit(" NATION_"), F.col("c_nationkey").cast("string"), F.lit("市")))
         .when(k % 4 == 1, F.concat(F.lit("ION_"), F.col("c_nationkey").cast("string"))).when(k % 4 == 2, F.col("c_mktsegment"))
         .otherwise(F.col("c_name")).alias("region"))


RESOLVED_SQL = CATALOG_SQL + f""",
regions AS (SELECT DISTINCT CASE WHEN c_custkey % 97 = 0 THEN ' ' WHEN c_custkey % 4 = 0 THEN ' NATION_' || c_nationkey || '市'
  WHEN c_custkey % 4 = 1 THEN 'ION_' || c_nationkey WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE c_name END AS region FROM customer),
cleaned AS (SELECT region, replace(trim(region), '市', '') AS clean FROM regions),
best AS (SELECT region, arg_min(city, pos) AS city FROM cleaned JOIN catalog ON contains(clean, city) OR contains(city, clean)
  WHERE clean <> '' GROUP BY 1),
label AS (SELECT region, CASE WHEN trim(region) = '' THEN '未指定区域' ELSE trim(region) END AS name FROM cleaned WHERE region NOT IN (SELECT region FROM best)),
candidates AS (
  SELECT region, type, title, catalog.source_name, url, list_item, true AS listed FROM best JOIN catalog USING (city)
  UNION ALL SELECT region, 'housing', '暂未收录【' || name || '】的住建局数据源', name || '住建局 (待录入)', '', '{V.DEFAULT_LIST_ITEM}', false FROM label
  UNION ALL SELECT region, 'subsidy', '暂未收录【' || name || '】的人社局数据源', name || '人社局 (待录入)', '', '{V.DEFAULT_LIST_ITEM}', false FROM label
  UNION ALL SELECT region, 'other', '暂未收录【' || name || '】的政府门户数据源', name || '人民政府 (待录入)', '', '{V.DEFAULT_LIST_ITEM}', false FROM label)"""


@query("j4_region_sources", f"WITH {RESOLVED_SQL} SELECT region, type, title, source_name, url, listed FROM candidates")
def j4(spark, sf):
    return cat.resolve_sources(regions(spark, sf), catalog(spark, sf)).select("region", "type", "title", "source_name", "url", "listed")


@query("j4_preset_source", f"WITH {RESOLVED_SQL} SELECT region, title FROM candidates WHERE type = 'housing'")
def j4_preset(spark, sf):
    return cat.preset_source(cat.resolve_sources(regions(spark, sf), catalog(spark, sf))).select("region", "title")


@query("j7_synthesized_rules", f"""WITH {RESOLVED_SQL} SELECT 'dyn_' || region || '_' || type AS id, region AS city, url,
  coalesce(list_item, 'ul li') AS list_item FROM candidates WHERE url <> ''""")
def j7(spark, sf):
    made = cat.synthesize_rules(cat.resolve_sources(regions(spark, sf), catalog(spark, sf)))
    return made.select("id", "city", "url", F.col("selectors.list_item").alias("list_item"))


@query("j5_cities_without_rule", f"""WITH {RULES_SQL}, subs AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'CITY_' ELSE 'ITY_1' END || c_nationkey AS city FROM customer)
SELECT city FROM subs WHERE NOT EXISTS (SELECT 1 FROM rules WHERE contains(rules.city, subs.city))""")
def j5(spark, sf):
    subs = B.table(spark, sf, "customer").select(F.concat(
        F.when(F.col("c_custkey") % 2 == 0, "CITY_").otherwise("ITY_1"), F.col("c_nationkey").cast("string")).alias("city"))
    return cat.subscriptions_without_rule(subs, rules(spark, sf))


@query("j6_catalogue_audit", """WITH c AS (SELECT 'NATION_' || s_nationkey AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'subsidy' ELSE 'housing' END AS type,
  s_name AS source_name, 'https://dept' || (s_suppkey % 7) || '.nation' || s_nationkey || '.org/' AS url FROM supplier),
h AS (SELECT n_name AS city, NULL AS type, CASE WHEN n_nationkey % 5 = 0 THEN 'missing.' ELSE 'nation' || n_nationkey || '.' END AS hint FROM nation
  UNION ALL SELECT n_name, 'subsidy', 'dept2' FROM nation UNION ALL SELECT n_name, 'subsidy', 'dept4' FROM nation)
SELECT c.*, 'domain' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.city = c.city AND h.type IS NULL AND contains(url, hint))
UNION ALL SELECT c.*, 'department' FROM c WHERE type = 'subsidy' AND NOT EXISTS (SELECT 1 FROM h WHERE h.city = c.city AND h.type = 'subsidy' AND contains(url, hint))""")
def j6(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    c = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("NATION_"), n).alias("city"), F.when(k % 2 == 0, "subsidy").otherwise("housing").alias("type"), F.col("s_name").alias("source_name"),
        F.concat(F.lit("https://dept"), (k % 7).cast("string"), F.lit(".nation"), n, F.lit(".org/")).alias("url"))
    nation = B.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    hints = nation.select(F.col("n_name").alias("city"), F.lit(None).cast("string").alias("type"), F.when(key % 5 == 0, "missing.").otherwise(
        F.concat(F.lit("nation"), key.cast("string"), F.lit("."))).alias("hint")).unionByName(
        nation.select(F.col("n_name").alias("city"), F.lit("subsidy").alias("type"), F.explode(array_of(["dept2", "dept4"])).alias("hint")))
    return cat.audit(c, hints)
