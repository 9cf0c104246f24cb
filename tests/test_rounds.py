"""Rounds, streams and the registered queries."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from noticeboard.operators import filters
from noticeboard.plans import bindings as B
from noticeboard.plans import queries_rounds as Q
from noticeboard.plans import round as rounds
from noticeboard.streaming import streams
from noticeboard.streaming.batch_log import BatchLog
from tests.conftest import SF


def now():
    return F.to_timestamp(F.lit("2026-08-25 08:00:00"))


def test_rounds_lifecycle(spark, tmp_path):
    """Baseline first, then only what is new; a replay of a round changes nothing."""
    rules = spark.createDataFrame(
        [("r", "深圳", "全市", "住房保障中心", "housing", "https://h.cn/", "html", ("ul li", "a", "a", "span"))],
        "id string, city string, district string, source_name string, category string, url string, parser_type string, "
        "selectors struct<list_item:string,title:string,link:string,date:string>")

    def pages(numbers):
        html = "<ul>" + "".join(f'<li><a href="/n/{i}.html?t=9{i}">深圳市人才公寓第{i}批配租公告</a><span>2026-08-{10 + i}</span>' for i in numbers) + "</ul>"
        p = spark.createDataFrame([("r", "https://h.cn/", 1, html)], "rule_id string, url string, page int, html string")
        log = spark.createDataFrame([("r", 1, "https://h.cn/", "html", 200, None)], "rule_id string, page int, url string, kind string, http_status int, error string")
        return rounds.Inputs(rules=rules, pages=p, fetch_log=log.withColumn("error", F.col("error").cast("string")))

    ledger, log = BatchLog(spark, f"{tmp_path}/ledger"), BatchLog(spark, f"{tmp_path}/log")
    policy = filters.Policy(today="2026-08-25")
    # a first round is the baseline whatever its number and however often it runs
    late, late_log = BatchLog(spark, f"{tmp_path}/late"), BatchLog(spark, f"{tmp_path}/late_log")
    for _ in range(2):
        assert rounds.run_round(pages(range(1, 4)), policy, now(), late, late_log, 1).count() == 0
    assert late.rows().filter("state = 2").count() == 3
    assert (late.marker().first_batch, late.marker().row_count) == (1, 3)
    assert rounds.run_round(pages(range(1, 6)), policy, now(), ledger, log, 0).count() == 0
    assert ledger.rows().filter("state = 2").count() == 5
    for _ in range(2):
        queue = rounds.run_round(pages(range(3, 8)), policy, now(), ledger, log, 1)
        assert [r.title for r in queue.collect()] == ["深圳市人才公寓第7批配租公告", "深圳市人才公寓第6批配租公告"]
        assert queue.first().notes == "批次: 第7批"
    assert log.rows().count() == 2
    assert rounds.dry_run(pages(range(1, 3)), policy, now()).count() == 2
    assert ledger.rows().count() == 7


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = f"{tmp_path}/docs"
    docs.repartitionByRange(3, "doc_id").write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = f"{tmp_path}/discover"
    q = streams.discover_stream(B.notices_from(stream), root, ["notice_id"], now)
    q.awaitTermination()
    got = BatchLog(spark, f"{root}/ledger").rows()
    batches = spark.read.parquet(f"{root}/ledger").select("batch").distinct().count()
    assert batches == 3
    for n in range(3):
        part = spark.read.parquet(f"{root}/ledger/batch={n}")
        assert {r.state for r in part.select("state").distinct().collect()} <= ({2} if n == 0 else {0})
    assert got.groupBy("unique_id").count().filter("count > 1").count() == 0
    assert got.groupBy("dedup_key").count().filter("count > 1").count() == 0


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry_module.queries()[name](spark, SF)
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(normal(v) for v in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
    assert got


@pytest.mark.parametrize("name", ["a7_health_report", "u3_greedy_two_key_dedup", "s5_rule_listing", "i3_outbox_state_machine"])
def test_partitioning_does_not_matter(spark, name):
    fn = entry_module.queries()[name]
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(fn(spark, SF).collect(), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
