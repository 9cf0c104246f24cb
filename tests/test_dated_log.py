"""Run log by day: retention by partition, merging, replays, readers that began before."""

import datetime as dt
import os

from pyspark.sql import functions as F

from noticeboard.streaming.dated_log import DatedLog


def day_rows(spark, *days):
    return spark.createDataFrame([(i, None if d is None else dt.datetime(2026, 8, d, 7)) for i, d in enumerate(days)], "id long, created_at timestamp")


def stored_days(path):
    return sorted({d for _, dirs, _ in os.walk(path) for d in dirs if d.startswith("day=")})


def days(df):
    return sorted((r.created_at.day if r.created_at else 0) for r in df.collect())


def test_old_partitions_go_and_earlier_readers_finish(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = DatedLog(spark, path)
    assert log.rows_or_none() is None and log.before(3) is None
    log.write(day_rows(spark, 1, 2, None), 0)
    log.write(day_rows(spark, 2, 3, 4), 1)
    reader = log.rows()
    log.keep_from(dt.date(2026, 8, 2))
    assert days(log.rows()) == [0, 2, 2, 3, 4]
    assert days(reader) == [0, 1, 2, 2, 3, 4]            # its partitions are still there
    log.keep_from(dt.date(2026, 8, 3))
    assert "day=2026-08-01" not in stored_days(path) and "day=2026-08-02" in stored_days(path)
    for _ in range(2):                                  # a replay changes nothing, an earlier day neither
        log.keep_from(dt.date(2026, 8, 3))
        log.keep_from(dt.date(2026, 8, 1))
        assert days(log.rows()) == [0, 3, 4]
    assert days(log.before(1)) == [0]
    log.prune(dt.datetime(2026, 8, 14), 10)
    assert days(log.rows()) == [0, 4] and "day=2026-08-02" not in stored_days(path)


def test_merges_replace_batches_for_later_readers(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = DatedLog(spark, path)
    for n in range(4):
        log.write(day_rows(spark, 1, n + 1), n)
    reader = log.rows()
    log.merge(1)
    assert log.batches() == [0, 1, 2, 3] and days(reader) == days(log.rows()) == [1, 1, 1, 1, 1, 2, 3, 4]
    middle = log.rows()
    log.merge(2)
    assert log.batches() == [2, 3] and log.merges() == [1, 2]
    assert days(middle) == days(log.rows()) == [1, 1, 1, 1, 1, 2, 3, 4]
    log.write(day_rows(spark, 9, 9), 1)                  # merged long ago: the replay changes nothing
    log.merge(2)
    log.merge(1)
    assert days(log.rows()) == [1, 1, 1, 1, 1, 2, 3, 4]
    log.write(day_rows(spark, 5), 3)                     # not merged yet: the replay replaces its batch
    assert days(log.rows()) == [1, 1, 1, 1, 2, 3, 5]
    log.merge(3)
    assert log.merges() == [2, 3] and log.batches() == [3]
    assert days(log.rows()) == [1, 1, 1, 1, 2, 3, 5]


def test_batches_without_rows_and_new_columns(spark, tmp_path):
    log = DatedLog(spark, f"{tmp_path}/log")
    log.write(day_rows(spark, 1).limit(0), 0)
    assert log.rows().columns == ["id", "created_at"] and log.rows().count() == 0
    log.write(day_rows(spark, 1).withColumn("note", F.lit("n")), 1)
    log.write(day_rows(spark, 2).withColumn("note", F.lit("m")).limit(0), 2)
    assert [r.note for r in log.rows().collect()] == ["n"]
    log.merge(2)
    assert [r.note for r in log.rows().collect()] == ["n"]
    log.keep_from(dt.date(2026, 9, 1))
    assert log.rows().count() == 0
