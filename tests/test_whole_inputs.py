"""Inputs larger than any display limit, and rows that are not as expected."""

from pyspark.sql import functions as F

from noticeboard.functions import facts
from noticeboard.operators import catalog, health
from noticeboard.sources import fetched, html_nodes, listing


def listed(spark, n):
    rows = "".join(f'<li><a href="/n/{i}.html">关于第{i}号项目受理安排的通知</a><span>2026-01-{i % 28 + 1:02d}</span></li>' for i in range(n))
    page = spark.createDataFrame([(f"<body><ul>{rows}</ul></body>", "https://a.example.org/")], "html string, url string")
    nodes = page.withColumn("nodes", html_nodes.nodes_of(F.col("html")))
    return nodes.select(F.inline(listing.heuristic_items(F.col("nodes"), F.col("url")))).collect()


def test_long_lists_are_read_whole(spark):
    assert len(listed(spark, 41)) == 41
    assert len(listed(spark, 130)) == 130


def test_health_looks_at_the_whole_log(spark):
    rows = [(i, "s", "c", "SUCCESS" if i == 0 else "FAILED", 5 if i == 0 else 0, None, f"2026-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(31)]
    log = spark.createDataFrame(rows, "id long, source_name string, city string, status string, items_found int, error_message string, at string")
    got = health.health_report(log.withColumn("created_at", F.to_timestamp("at"))).first()
    assert got.consecutive_failures == 30 and got.last_success_at is not None


def test_charset_behind_a_long_head(spark):
    head = b"<html><!--" + b"x" * 6000 + b"--><meta charset=gbk>"
    rows = [(bytearray(head + "\u4f60".encode("gbk")), None, None)]
    pages = spark.createDataFrame(rows, "content binary, forced_charset string, header_charset string")
    got = fetched.decode_pages(pages).first()
    assert got.charset == "gb18030" and got.html.endswith("\u4f60")


def test_all_amounts_and_labels_are_kept(spark):
    df = spark.createDataFrame([("博士5万元、硕士4万元、本科3万元、大专2万元、技师1万元",)], "t string")
    whole, cut = df.select(facts.tiered_amount(F.col("t")), facts.tiered_amount(F.col("t"), max_parts=2)).first()
    assert whole.count(" / ") == 4 and cut.count(" / ") == 1
    many = spark.createDataFrame([("博士后、硕士、本科、大专、技工、应届高校毕业生、退役军人、留学回国人员、领军人才",)], "t string")
    whole, cut = many.select(facts.audience(F.col("t"), F.lit("")), facts.audience(F.col("t"), F.lit(""), max_labels=2)).first()
    assert whole.count(" / ") >= 5 and cut.count(" / ") == 1


def test_last_attempt_of_a_page_counts(spark):
    rules = spark.createDataFrame([("r", "深圳", "s", "https://a.example.org/", "html")], "id string, city string, source_name string, url string, parser_type string")
    log = spark.createDataFrame([("r", 1, "html", 500, None, 1), ("r", 1, "html", 200, None, 2)],
                                "rule_id string, page int, kind string, http_status int, error string, fetched_at int")
    items = spark.createDataFrame([("r", "t", 1)], "rule_id string, title string, pos int")
    assert [r.status for r in fetched.source_results(rules, log, items).collect()] == ["SUCCESS"]


def test_audit_knows_cities_without_hints_and_hints_without_city(spark):
    rows = [("A", "subsidy", "s1", "https://x.a.org"), ("B", "subsidy", "s2", "https://dept.b.org"), ("C", "housing", "s3", "https://c.org"),
            ("C", "housing", "s3", "https://c.org")]
    cat = spark.createDataFrame(rows, "city string, type string, source_name string, url string")
    hints = spark.createDataFrame([("A", None, "a.org"), (None, None, "b.org"), (None, "subsidy", "dept")], "city string, type string, hint string")
    got = sorted((r.city, r.problem) for r in catalog.audit(cat, hints).collect())
    assert got == [("A", "department"), ("C", "domain"), ("C", "domain")]


def test_pages_of_several_megabytes(spark):
    rows = [(i, "<ul>" + "".join(f'<li><a href="/p/{i}/{j}">link {j}</a> text {j}</li>' for j in range(20000 + i)) + "</ul>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id int, html string").coalesce(1)
    got = {r.page_id: r["count"] for r in html_nodes.nodes_table(pages).filter("tag = 'a'").groupBy("page_id").count().collect()}
    assert got == {i: 20000 + i for i in range(6)}
