"""Parser types, delivery, alerts and selectors of a round."""

import json

from pyspark.sql import functions as F

from noticeboard.functions import selectors
from noticeboard.operators import filters
from noticeboard.plans import round as rounds
from noticeboard.sources import rules as R
from noticeboard.streaming.batch_log import BatchLog

TITLES = ["深圳市人才公寓第一批配租公告", "深圳市人才住房第二批配租公告", "深圳市青年人才公寓第三批配租公告", "深圳市公共租赁住房第四批配租公告"]
RULE = ("id string, city string, district string, source_name string, category string, url string, parser_type string, "
        "selectors struct<list_item:string,title:string,link:string,date:string>, "
        "json_path struct<list:string,title:string,link:string,date:string,html:string>")


def at(day):
    return F.to_timestamp(F.lit(f"2026-08-{day:02d} 08:00:00"))


def inputs(spark, wide=False):
    def rule(i, kind, path):
        return (i, "深圳", "全市", f"住房保障中心{i}", "housing", "https://h.example.org/", kind, ("ul li", "a", "a", "span"), path)

    rules = spark.createDataFrame([rule("h", "html", None), rule("j", "json", ("rows", "t", "u", "d", None)),
                                   rule("x", "json_html", (None, None, None, None, "data.html"))], RULE)

    def html(i):
        return f'<ul><li><a href="/n/{i}.html">{TITLES[i]}</a><span>2026-08-01</span></li></ul>'

    content = bytearray(html(0).encode("gb18030"))
    pages = spark.createDataFrame([("h", "https://h.example.org/", 1, content, None, "gbk")],
                                  "rule_id string, url string, page int, content binary, header_charset string, forced_charset string")
    body = json.dumps({"rows": [{"t": TITLES[1], "u": "/n/1.html", "d": "2026-08-01"}]}, ensure_ascii=False)
    bodies = spark.createDataFrame([("j", "https://h.example.org/", 1, body), ("x", "https://h.example.org/", 1, json.dumps({"data": {"html": html(2)}})),
                                    ("j", "https://h.example.org/", 2, body.replace(TITLES[1], TITLES[3]).replace("/n/1", "/n/3"))],
                                   "rule_id string, url string, page int, body string")
    log = spark.createDataFrame([("h", 1, "html", 200), ("j", 1, "json", 200), ("j", 2, "json", 200 if wide else 500), ("x", 1, "json_html", 200)],
                                "rule_id string, page int, kind string, http_status int").withColumn("error", F.lit(None).cast("string"))
    return rounds.Inputs(rules, pages, log, responses=bodies)


def test_every_parser_type_delivery_and_alerts(spark, tmp_path):
    ledger, log, outcomes, alerts = (BatchLog(spark, f"{tmp_path}/{n}") for n in ("ledger", "log", "outcomes", "alerts"))
    policy = filters.Policy(today="2026-08-10")
    queue = rounds.run_round(inputs(spark), policy, at(10), ledger, log, 1, cold_start_baseline=False, outcomes=outcomes)
    assert sorted(r.title for r in queue.collect()) == sorted(TITLES[:3])
    failed = spark.createDataFrame([(1, "mail", False, "down")], "channel_pos int, channel string, ok boolean, error string").withColumn("at", at(10))
    rounds.record_delivery(queue, failed, outcomes, 1)
    # the next round finds one more, and what was not delivered waits still
    queue = rounds.run_round(inputs(spark, wide=True), policy, at(11), ledger, log, 2, outcomes=outcomes)
    assert sorted((r.title, r.notify_attempts) for r in queue.collect()) == sorted([(t, 1) for t in TITLES[:3]] + [(TITLES[3], 0)])
    rounds.record_delivery(queue, failed.withColumn("ok", F.lit(True)), outcomes, 2)
    assert rounds.run_round(inputs(spark, wide=True), policy, at(12), ledger, log, 3, outcomes=outcomes).count() == 0
    assert {r.state for r in rounds.current_ledger(ledger, outcomes).collect()} == {1}
    assert log.rows().count() == 9

    due = rounds.alert_due(log, alerts, 3, at(12)).first()
    assert (due.total, due.broken, due.due) == (3, 0, False)
    broken = log.rows().withColumns({"status": F.lit("FAILED"), "items_found": F.lit(0)})
    bad = BatchLog(spark, f"{tmp_path}/bad")
    bad.write(broken, 1)
    assert rounds.alert_due(bad, alerts, 1, at(12)).first().due
    rounds.record_alert(alerts, 1, at(12), delivered=False)
    assert rounds.alert_due(bad, alerts, 2, at(12)).first().due       # nobody got it
    rounds.record_alert(alerts, 2, at(12), delivered=True)
    assert not rounds.alert_due(bad, alerts, 3, at(13)).first().due
    assert rounds.alert_due(bad, alerts, 3, at(14)).first().due
    assert rounds.alert_due(bad, alerts, 3, F.to_timestamp(F.lit("2026-12-01 08:00:00"))).first().total == 0


def test_unsupported_selectors_are_refused(spark):
    good = ["", "li", "ul.news li", "div#main ul.a.b li , p", ".x .y", "#id"]
    bad = ["ul.l li:not(.x)", "li[class]", "li:nth-child(2)", "ul.l > li", "li + li", "*"]
    df = spark.createDataFrame([(s, i < len(good)) for i, s in enumerate(good + bad)], "s string, ok boolean")
    rows = df.select("s", "ok", selectors.is_supported(F.col("s")).alias("got"), R.selector_problems(F.struct(
        F.col("s").alias("list_item"), F.lit("a").alias("title"), F.lit(None).cast("string").alias("link"), F.lit("").alias("date"))).alias("p")).collect()
    assert all(r.ok == r.got and len(r.p) == (0 if r.ok else 1) for r in rows), rows
