"""Plans and steps whose cost must not follow a whole table, a whole batch or a whole page."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.plans import round as rounds
from noticeboard.sources import html_nodes, listing

RULE = ("id string, city string, district string, source_name string, category string, url string, parser_type string, "
        "selectors struct<list_item:string,title:string,link:string,date:string>")


def page(n, around="{}"):
    rows = "".join(f'<li><a href="/n/{i}.html">关于第{i}号项目受理安排的通知</a><span>2026-01-{i % 28 + 1:02d}</span></li>' for i in range(n))
    return f"<body>{around.format(f'<ul>{rows}</ul>')}</body>"


@pytest.fixture
def never_small(spark):
    """No table is small enough to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def inputs(spark, pages=3):
    rules = spark.createDataFrame([("r", "深圳", "全市", "住房保障中心", "housing", "https://h.cn/", "html", ("ul li", "a", "a", "span"))], RULE)
    read = spark.createDataFrame([("r", f"https://h.cn/{i}/", i + 1, page(4)) for i in range(pages)], "rule_id string, url string, page int, html string")
    log = read.select("rule_id", "page", F.lit("html").alias("kind"), F.when(F.col("page") == 3, 404).otherwise(200).alias("http_status"),
                      F.lit(None).cast("string").alias("error"))
    return rounds.Inputs(rules, read, log)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_go_to_the_pages(spark, never_small):
    """s5, s11: few rules must not gather all pages in a task each."""
    i = inputs(spark)
    found = listing.listing_items(i.pages, i.rules.withColumnRenamed("id", "rule_id"))
    assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)
    assert found.count() == 12


def test_a_round_does_not_gather_the_pages_of_a_source(spark, never_small):
    """i9, i10: neither the failures nor the rules move pages."""
    found = rounds.collect(inputs(spark))
    assert "SortMergeJoin" not in plan(found)
    assert {r.page for r in found.select("page").distinct().collect()} == {1}     # the same addresses on every page
    assert found.count() == 4


def test_json_sources_of_a_round_stay_in_place(spark, never_small):
    """i9_every_input: bodies are joined with broadcast rules."""
    i = inputs(spark)
    kind = "struct<list:string,title:string,link:string,date:string,html:string>"
    rules = i.rules.withColumns({"parser_type": F.lit("json"), "json_path": F.lit(None).cast(kind)})
    bodies = i.pages.select("rule_id", "url", "page", F.lit('{"data":[{"title":"关于第1号项目受理安排的通知","url":"/a"}]}').alias("body"))
    found = rounds.collect(rounds.Inputs(rules, i.pages.filter("false"), i.fetch_log, responses=bodies))
    assert "SortMergeJoin" not in plan(found)
    assert [r.title for r in found.collect()] == ["关于第1号项目受理安排的通知"]


def test_nodes_of_a_batch_come_a_few_pages_at_a_time():
    """s8, x1: memory of Python does not follow the number of pages in a batch."""
    batch = pa.array([page(2), None] * 500)
    parts = list(html_nodes.node_arrays(iter([batch, batch.slice(0, 0), batch.slice(0, 3)]), frozenset(V.CHROME_TAGS)))
    assert max(map(len, parts)) <= 64 and sum(map(len, parts)) == 1003
    whole = html_nodes._node_array(batch, frozenset(V.CHROME_TAGS))
    assert pa.concat_arrays(parts).slice(0, 1000).equals(whole)


def test_long_lists_in_nested_containers(spark):
    """w3, s8: a row is read once, whatever the number of its containers, and addresses are not compared in pairs of rows."""
    n = 1200
    made = spark.createDataFrame([(page(n, "<div>" * 6 + "{}" + "</div>" * 6), "https://a.example.org/")], "html string, url string")
    nodes = made.withColumn("nodes", html_nodes.nodes_of(F.col("html")))
    begin = time.monotonic()
    got = nodes.select(F.inline(listing.heuristic_items(F.col("nodes"), F.col("url")))).collect()
    assert time.monotonic() - begin < 8
    assert [r.url for r in got] == [f"https://a.example.org/n/{i}.html" for i in range(n)]


def test_first_by_url_keeps_what_it_kept(spark):
    rows = [([("a", 1), ("b", 2), ("a", 3), ("c", 4)],), ([(None, 1), ("b", 2)],), ([("a", 1), (None, 2), ("b", 3)],), ([],)]
    df = spark.createDataFrame(rows, "x array<struct<url:string,n:int>>")
    assert [[y.n for y in r[0]] for r in df.select(listing.first_by_url(F.col("x"))).collect()] == [[1, 2, 4], [1], [1], []]
