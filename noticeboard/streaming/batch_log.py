"""Append-only parquet log written batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    """Rows of one table in one directory per batch.

    A batch that runs again replaces its own directory and reads only earlier
    ones, so replays after a failure change nothing.  Nothing that is being
    read is ever overwritten, and earlier rows are never rewritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.marker() is None:
            stored = self.only(batch).agg(F.lit(batch).cast("long").alias("first_batch"),
                                          F.current_timestamp().alias("initialised_at"), F.count("*").alias("row_count"))
            stored.coalesce(1).write.mode("overwrite").parquet(self.path + ".initialised")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def marker(self):
        """Row (first_batch, initialised_at, row_count) of the batch that began the log; None before it."""
        stored = self._read(self.path + ".initialised")
        return None if stored is None else stored.first()

    def before(self, batch: int) -> DataFrame | None:
        """Rows of all earlier batches; None when no earlier batch was ever completed.

        The stored marker decides, so the first batch finds no earlier one however
        often it runs, and an earlier batch without rows still counts.
        """
        begun = self.marker()
        if begun is None or begun.first_batch >= batch:
            return None
        return self.spark.read.parquet(self.path).filter(F.col("batch") < batch).drop("batch")

    def newest(self) -> int | None:
        """Number of the newest batch with rows."""
        rows = self._read(self.path)
        return None if rows is None else rows.agg(F.max("batch")).first()[0]

    def only(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={batch}")

    def rows_or_none(self) -> DataFrame | None:
        rows = self._read(self.path)
        return None if rows is None else rows.drop("batch")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")
