"""Operators against small fixtures and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.operators import catalog, dedup, filters, health, outbox, reports
from noticeboard.sources import fetched


def greedy(rows):
    used_u, used_d, kept = set(), set(), []
    for n, u, d in sorted(rows):
        if u not in used_u and d not in used_d:
            used_u.add(u)
            used_d.add(d)
            kept.append(n)
    return kept


@pytest.mark.parametrize("kind", ["chain", "random", "hot", "copies"])
def test_greedy_dedup_equals_the_loop(spark, kind):
    rng = random.Random(7)
    if kind == "chain":  # (u1,d1), (u2,d1), (u2,d2), ...: alternate rows survive
        rows = [(i, f"u{(i + 1) // 2}", f"d{i // 2}") for i in range(24)]
    elif kind == "hot":  # a third of all rows share a key
        rows = [(i, "hot" if i % 3 == 0 else f"u{rng.randrange(60)}", f"d{rng.randrange(90)}") for i in range(300)]
    elif kind == "copies":
        rows = [(i, "u", "d") if i % 3 == 0 else (i, f"u{i}", f"d{i % 50}") for i in range(300)]
    else:
        rows = [(i, f"u{rng.randrange(80)}", f"d{rng.randrange(80)}") for i in range(300)]
    rng.shuffle(rows)
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "n long, unique_id string, dedup_key string").repartition(parts)
        got = sorted(r.n for r in dedup.greedy_first(df, ["n"]).collect())
        assert got == greedy(rows)


def test_two_key_anti_join(spark):
    ledger = spark.createDataFrame([("u1", "d1"), ("u2", None)], "unique_id string, dedup_key string")
    new = spark.createDataFrame([("u1", "x"), ("y", "d1"), ("u3", "d3"), ("u2", "z")], "unique_id string, dedup_key string")
    assert [r.unique_id for r in dedup.not_in_ledger(new, ledger).collect()] == ["u3"]


def box(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, state int, notify_attempts int, notify_error string, notified_at timestamp")


def test_retry_and_abandon(spark):
    ledger = box(spark, [("a", 0, 0, None, None), ("b", 0, 4, "old", None), ("c", 2, 0, None, None), ("d", 0, 5, None, None)])
    tries = spark.createDataFrame(
        [("a", 1, False, "boom", None), ("a", 2, True, None, None), ("b", 1, False, "x" * 900, None)],
        "unique_id string, seq int, ok boolean, error string, at timestamp")
    got = {r.unique_id: r for r in outbox.apply_attempts(ledger, tries).collect()}
    assert (got["a"].state, got["a"].notify_attempts, got["a"].notify_error) == (V.STATE_SENT, 1, None)
    assert (got["b"].state, got["b"].notify_attempts, len(got["b"].notify_error)) == (V.STATE_ABANDONED, 5, 900)
    assert got["c"].state == V.STATE_BASELINE
    assert got["d"].state == V.STATE_ABANDONED


def log_rows(spark, rows):
    return spark.createDataFrame(
        [(i, "s", "c", st, n, None, f"2026-01-01 00:{i:02d}:00") for i, (st, n) in enumerate(rows)],
        "id long, source_name string, city string, status string, items_found int, error_message string, t string").withColumn(
        "created_at", F.to_timestamp("t"))


@pytest.mark.parametrize("runs,streak", [
    ([("FAILED", 0)] * 4, 4), ([("FAILED", 0)] * 3 + [("SUCCESS", 2)], 0), ([("SUCCESS", 0)] * 3, 3),
    ([("SUCCESS", 1)] + [("FAILED", 0)] * 30, 30)])
def test_streaks(spark, runs, streak):
    r = health.health_report(log_rows(spark, runs)).collect()[0]
    assert r.consecutive_failures == streak
    assert r.is_broken == (streak >= 3)
    assert (r.last_success_at is None) == (not any(n for s, n in runs if s == "SUCCESS"))


def test_hot_source_keeps_its_latest_runs(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source_name"),
        F.lit("c").alias("city"), F.lit("SUCCESS").alias("status"), F.lit(1).alias("items_found"),
        F.lit(None).cast("string").alias("error_message"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    got = sorted(r.id for r in health.latest_runs(rows).filter("source_name = 'hot'").collect())
    assert got == [i for i in range(3000) if i % 3 == 0][-20:]


def test_alert_cooldown(spark):
    rows = [("g", f"2026-01-0{d} {h:02d}:00:00", b, ok) for d, h, b, ok in [
        (1, 0, 0, True), (1, 1, 2, False), (1, 2, 1, True), (1, 3, 5, True), (2, 2, 1, True), (2, 3, 1, True), (3, 4, 1, True)]]
    df = spark.createDataFrame(rows, "g string, t string, broken int, delivered boolean").withColumn("round_at", F.to_timestamp("t"))
    got = sorted(str(r.alert_at) for r in health.alert_rounds(df, ["g"]).collect())
    assert got == ["2026-01-01 01:00:00", "2026-01-01 02:00:00", "2026-01-02 03:00:00", "2026-01-03 04:00:00"]


def test_age_boundary_and_funnel(spark):
    policy = filters.Policy(today="2026-08-25")
    rows = [("深圳市人才公寓配租公告", d) for d in ("2026-07-11", "2026-07-10", None, "2027-01-01")] + [
        ("某某采购公告", None), ("无关的通知内容文本", None)]
    df = spark.createDataFrame(rows, "title string, publish_date string").withColumns(
        {"category": F.lit("housing"), "source_name": F.lit("s"), "city": F.lit("c")})
    judged = filters.judge(filters.validated(df), policy)
    assert [r.reason for r in judged.collect()] == ["kept", "stale", "kept", "kept", "blacklisted", "low_score"]
    assert filters.funnel(judged).collect()[0].asDict() == {
        "total": 6, "blacklisted": 1, "stale": 1, "low_score": 1, "kept": 3}


def test_region_candidates(spark):
    cat = spark.createDataFrame(
        [(i, c, t, "tag", f"{c}{t}", "s", f"https://{t}.cn", "d", "ul li", True) for i, (c, t) in enumerate(
            [("深圳", "housing"), ("深圳", "subsidy"), ("北京", "housing")])],
        "pos int, city string, type string, tag string, title string, source_name string, url string, desc string, list_item string, verified boolean")
    names = spark.createDataFrame([("深圳市南山区",), ("京",), ("西宁市",), (" ",), ("北京市",)], "region string")
    got = catalog.resolve_sources(names, cat)
    titles = {r.region: r.title for r in catalog.preset_source(got).collect()}
    assert titles["深圳市南山区"] == "深圳housing"
    assert titles["京"] == titles["北京市"] == "北京housing"
    assert titles["西宁市"] == "暂未收录【西宁市】的住建局数据源"
    assert "未指定区域" in titles[" "]
    assert {r.city for r in catalog.synthesize_rules(got).collect()} == {"深圳市南山区", "京", "北京市"}


def test_wecom_digest_is_cut_at_whole_characters(spark):
    text = "汉" * 2000
    got = spark.range(1).select(reports.cut_to_bytes(F.lit(text), 3800)).collect()[0][0]
    assert got == "汉" * (3800 // 3) + "\n\n…（内容过长已截断）"


def test_empty_batch(spark):
    empty = spark.createDataFrame([], "n long, unique_id string, dedup_key string")
    assert dedup.greedy_first(empty, ["n"]).count() == 0



def test_prefix_with_a_hot_source(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("rule_id"),
                                   F.col("id").alias("page"), (F.col("id") == 150).alias("failed"))
    got = fetched.contiguous_prefix(rows)
    want = [(r.rule_id, r.page) for r in rows.collect() if r.rule_id != "hot" or r.page < 150]
    assert sorted((r.rule_id, r.page) for r in got.collect()) == sorted(want)
