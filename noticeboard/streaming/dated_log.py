"""Append-only parquet log partitioned by day, with retention and merging of batches."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class DatedLog:
    """Rows of one table in ``batches/batch=N/day=D``, merged now and then into ``merged/upto=N/day=D``.

    Readers follow two markers: the newest complete merge, which stands for all
    batches up to its number, and the first day kept.  Both only grow.  What a
    marker makes unreachable is deleted when the *next* marker is set, so a reader
    that began before still finds its files.  Rows are never rewritten in place.

    ``time`` names the timestamp column whose day partitions the log; rows without
    a time lie in Spark's default partition and stay for ever.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "created_at"):
        self.spark, self.path, self.time = spark, path.rstrip("/"), time

    # -- folders and markers
    def _folder(self, *names: object):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _children(self, *names: object, complete: bool = True) -> list[str]:
        """Values of the ``name=value`` folders; only those whose job has ended, unless told otherwise."""
        fs, path = self._folder(*names)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
        return [n.split("=", 1)[1] for n in found if not complete or self._exists(*names, n, "_SUCCESS")]

    def _exists(self, *names: object) -> bool:
        fs, path = self._folder(*names)
        return fs.exists(path)

    def _delete(self, *names: object) -> None:
        fs, path = self._folder(*names)
        fs.delete(path, True)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self._children("batches"))

    def merges(self) -> list[int]:
        return sorted(int(n) for n in self._children("merged"))

    def first_days(self) -> list[dt.date]:
        return sorted(dt.date.fromisoformat(d) for d in self._children("kept"))

    def _schema(self) -> StructType | None:
        """Columns of the newest batch that changed them; a batch without rows leaves no file to tell."""
        known = sorted(int(n) for n in self._children("schema"))[-1:]
        for n in known:
            return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema/batch={n}").first().value))
        return None

    # -- writing
    def write(self, df: DataFrame, batch: int) -> None:
        """Store a batch; one that runs again replaces itself, or changes nothing once it is merged."""
        if self.merges()[-1:] >= [batch]:
            return
        if df.schema != self._schema():
            kept = self.spark.createDataFrame([(df.schema.json(),)], "value string")
            kept.write.mode("overwrite").text(f"{self.path}/schema/batch={batch}")
        day = F.to_date(F.col(self.time))
        df.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batches/batch={batch}")

    def merge(self, upto: int) -> None:
        """Write the rows of all batches up to ``upto`` together, a few files a day instead of some a batch.

        A merge that runs again, or reaches no further than an earlier one, writes nothing.
        """
        done = self.merges()
        if done[-1:] < [upto]:
            rows = self._stored(upto)
            if rows is None:
                return
            # adaptive execution joins small days in a task and splits a large one
            rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/merged/upto={upto}")
        before = [m for m in done if m < upto][-1:]
        for old in before:
            for b in self.batches():
                if b <= old:
                    self._delete("batches", f"batch={b}")
            for m in done:
                if m < old:
                    self._delete("merged", f"upto={m}")

    def keep_from(self, first_day: dt.date) -> None:
        """Rows of earlier days are gone for new readers at once; their partitions go with the next call.

        A first day before the one that holds already changes nothing.
        """
        known = self.first_days()
        if not known or first_day > known[-1]:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/kept/first={first_day.isoformat()}")
        earlier = [d for d in known if d < first_day][-1:]
        for limit in earlier:
            for top, names in (("batches", self._children("batches")), ("merged", self._children("merged"))):
                for n in names:
                    folder = f"{'batch' if top == 'batches' else 'upto'}={n}"
                    for day in self._children(top, folder, complete=False):
                        if day[:1].isdigit() and dt.date.fromisoformat(day) < limit:
                            self._delete(top, folder, f"day={day}")

    def prune(self, now: dt.datetime, keep_days: int) -> None:
        self.keep_from(now.date() - dt.timedelta(days=keep_days))

    # -- reading
    def _stored(self, upto: int | None) -> DataFrame | None:
        """Rows, with ``day``, of the kept days of all batches up to ``upto`` (None: all)."""
        merged = [m for m in self.merges() if upto is None or m <= upto][-1:]
        fresh = [b for b in self.batches() if (upto is None or b <= upto) and [b] > merged]
        if not merged and not fresh:
            return None
        schema = self._schema().add("day", "date")
        parts = None
        for m in merged:
            parts = self.spark.read.schema(schema).parquet(f"{self.path}/merged/upto={m}")
        if fresh:  # one scan
            rows = (self.spark.read.option("basePath", f"{self.path}/batches").schema(schema.add("batch", "long"))
                    .parquet(*[f"{self.path}/batches/batch={b}" for b in fresh]).drop("batch"))
            parts = rows if parts is None else parts.unionByName(rows)
        first = self.first_days()[-1:]
        for day in first:  # a filter on the partition column: earlier days are not opened
            parts = parts.filter(F.col("day").isNull() | (F.col("day") >= F.lit(day)))
        return parts

    def rows_or_none(self) -> DataFrame | None:
        stored = self._stored(None)
        return None if stored is None else stored.drop("day")

    def rows(self) -> DataFrame:
        stored = self.rows_or_none()
        if stored is None:
            raise FileNotFoundError(f"no batch was stored in {self.path}")
        return stored

    def before(self, batch: int) -> DataFrame | None:
        """Kept rows of the batches before ``batch``; None when there is none.

        Merges reach only batches that are over, so call ``merge`` with numbers below
        the one in work.
        """
        stored = self._stored(batch - 1)
        return None if stored is None else stored.drop("day")
