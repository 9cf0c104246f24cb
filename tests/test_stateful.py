"""Keyed state in streams: several micro-batches, late rows and a restart equal the batch."""

import random

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import health
from noticeboard.plans.queries_rounds import seen_runs
from noticeboard.streaming import streams
from noticeboard.streaming.batch_log import BatchLog

LOG = "id long, city string, source_name string, status string, items_found int, error_message string, created_at timestamp"
HOUR = 3600


def runs(seed, hours=240):
    """(arrival, row) of hourly runs: one source always fails, one never, a city is null; rows arrive up to 20 hours late."""
    rng = random.Random(seed)
    rows, n = [], 0
    for h in range(hours):
        for s, p in (("always", 1.0), ("never", 0.0), ("mostly", 0.85), ("seldom", 0.2)):
            for _ in range(rng.randrange(3)):
                bad = rng.random() < p
                at = h * HOUR + rng.randrange(HOUR)
                n += 1
                rows.append((at + rng.choice([0, 0, 0, 20]) * HOUR * rng.random(),
                             (n, None if s == "seldom" else "a" if n % 2 else "b", s, "FAILED" if bad else "SUCCESS", 0 if bad else n % 4, f"e{n}" if bad else None, at)))
    return [r for _, r in sorted(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], None) for r in rows], LOG).drop("created_at").join(
        spark.createDataFrame([(r[0], r[6]) for r in rows], "id long, s long"), "id").select(
        "id", "city", "source_name", "status", "items_found", "error_message", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("created_at"))


def in_files(spark, path, rows, parts):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        frame(spark, rows[i:i + size]).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(frame(spark, [(1, "", "", "", 0, "", 0)]).schema).option("maxFilesPerTrigger", 1).parquet(path)


def normal(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_streaks_equal_the_report_of_the_whole_log(spark, tmp_path, parts):
    rows, path, root = runs(parts), f"{tmp_path}/in", f"{tmp_path}/out"
    half = len(rows) // 2
    in_files(spark, path, rows[:half], parts)
    streams.streak_stream(stream(spark, path), root, lateness_hours=24).awaitTermination()
    assert normal(streams.streak_report(spark, root)) == normal(health.health_report(frame(spark, rows[:half])))
    # a restart goes on from the stored state
    in_files(spark, path, rows[half:], parts)
    streams.streak_stream(stream(spark, path), root, lateness_hours=24).awaitTermination()
    want = health.health_report(frame(spark, rows))
    assert normal(streams.streak_report(spark, root)) == normal(want)
    assert want.filter("source_name = 'always'").agg(F.min("consecutive_failures")).first()[0] > 100


def test_alerts_come_once_and_equal_the_batch(spark, tmp_path):
    rows, path, root = runs(9), f"{tmp_path}/in", f"{tmp_path}/out"
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        in_files(spark, path, part, 3)
        streams.alert_stream(seen_runs(stream(spark, path)), root, ["city"], lateness="24 hours").awaitTermination()
    got = BatchLog(spark, f"{root}/alerts").rows()
    log = frame(spark, rows)
    closed = log.agg(F.max("created_at") - F.expr("INTERVAL 24 HOURS")).first()[0]
    rounds = seen_runs(log).groupBy("city", F.date_trunc("hour", "at").alias("round_at")).agg(
        F.sum("broken").alias("broken"), F.bool_or("delivered").alias("delivered"))
    over = rounds.filter(F.col("round_at") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed))
    want = health.alert_rounds(over, ["city"])
    assert normal(got) == normal(want) and got.count() > 15
    assert BatchLog(spark, f"{root}/alerts").newest() >= 6
