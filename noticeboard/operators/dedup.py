"""Duplicate removal on two keys."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.operators.components import components
from noticeboard.session import shared_dir

LOG = logging.getLogger(__name__)


def not_in_ledger(notices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Notices whose unique_id and dedup_key are both unknown to the ledger.

    Two equi-joins instead of one OR condition.  Only the key columns of the
    ledger are read; adaptive execution splits a hot key on the notice side.
    """
    ids = ledger.select("unique_id")
    keys = ledger.select("dedup_key").filter(F.col("dedup_key").isNotNull())
    return notices.join(ids, "unique_id", "left_anti").join(keys, "dedup_key", "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in the given order.

    An aggregate with a partial step, not a window: a key that holds a large
    share of the rows shrinks to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _folded(open_: DataFrame, uid: str, dkey: str) -> DataFrame:
    """The greedy rows of what is left, component by component, in order.

    Rows that share no key, not even through others, do not touch each other:
    each component of rows tied by keys is read in order by one task, as a stream
    of which only the keys already taken are kept.
    """
    tied = open_.select(F.concat(F.lit("u"), F.coalesce(uid, F.lit(""))).alias("a"), F.concat(F.lit("d"), F.coalesce(dkey, F.lit(""))).alias("b"))
    owner = components(tied).withColumnRenamed("node", "_node")
    rows = open_.withColumn("_node", F.concat(F.lit("u"), F.coalesce(uid, F.lit("")))).join(owner, "_node").drop("_node")

    def fold(batches):
        current, ids, keys = None, set(), set()
        for batch in batches:
            taken = []
            for component, u, d in zip(*(batch.column(c).to_pylist() for c in ("component", uid, dkey))):
                if component != current:
                    current, ids, keys = component, set(), set()
                free = u not in ids and d not in keys
                if free:
                    ids.add(u)
                    keys.add(d)
                taken.append(free)
            yield batch.filter(pa.array(taken, pa.bool_()))

    order = rows.repartition("component").sortWithinPartitions("component", "rank")
    return order.mapInArrow(fold, rows.schema).select("rank", uid, dkey)


def greedy_first(notices: DataFrame, order: Sequence[str], uid: str = "unique_id", dkey: str = "dedup_key",
                 max_rounds: int = 6) -> DataFrame:
    """Keep a row, in order, iff neither of its keys belongs to a row already kept.

    ``order`` must be a total order.  A dropped row does not claim its other
    key, so the result is a greedy matching between the two key sets and two
    'first row per key' passes would be wrong.  A null key is a key like others.

    Each round keeps all rows that come first under both of their keys and then
    drops the rows that share a key with one of them.  Rows alone under both keys
    are settled in the first round, and copies that agree in both keys are merged
    before, so groups of copies never travel.  Rows that form long chains, each
    sharing a key with the next, would need a round per two rows: what is left
    after ``max_rounds`` is split into connected components, whose number of jobs
    grows with the logarithm of the longest chain, and each is read in order.
    """
    shared_dir(notices.sparkSession)
    rank = F.struct(*order)
    open_ = notices.groupBy(uid, dkey).agg(F.min(rank).alias("rank")).checkpoint()
    chosen, rounds = None, 0
    while not open_.isEmpty():
        if rounds == max_rounds:
            taken = _folded(open_, uid, dkey).checkpoint()
        else:
            by_uid = open_.groupBy(uid).agg(F.min("rank").alias("rank"))
            by_key = open_.groupBy(dkey).agg(F.min("rank").alias("rank"))
            # ranks are unique, so a rank that is first under both keys is one row
            taken = by_uid.join(by_key, "rank").checkpoint()
        chosen = taken.select("rank") if chosen is None else chosen.unionByName(taken.select("rank"))
        if rounds == max_rounds:
            break
        ids = [F.col(uid).eqNullSafe(F.col("_u"))], taken.select(F.col(uid).alias("_u"))
        keys = [F.col(dkey).eqNullSafe(F.col("_d"))], taken.select(F.col(dkey).alias("_d"))
        open_ = open_.join(ids[1], ids[0], "left_anti").join(keys[1], keys[0], "left_anti").checkpoint()
        rounds += 1
    LOG.info("two-key dedup settled in %d rounds", rounds)
    if chosen is None:
        return notices.limit(0)
    ranked = notices.withColumn("_rank", rank)
    return ranked.join(chosen.select(F.col("rank").alias("_rank")), "_rank", "left_semi").drop("_rank").select(
        *notices.columns)


class KeyIndex:
    """The two keys of a ledger as bucketed tables, joined without moving them.

    ``unique_id`` and ``dedup_key`` are stored apart, each hash-partitioned into
    ``buckets`` files on the key, so an anti-join shuffles the notices of a round
    to the same buckets and reads the ledger where it lies.  ``add`` appends the
    keys of new rows only.  The files lie below ``path``; the tables are entered
    in the session's catalogue when the index is opened, by a later session too.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        name = "index_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_").replace(".", "_")
        self.tables = {key: f"{name}_{key}" for key in ("unique_id", "dedup_key")}
        for key, table in self.tables.items():
            if not spark.catalog.tableExists(table):
                spark.sql(f"CREATE TABLE {table} ({key} STRING) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                          f"INTO {buckets} BUCKETS LOCATION '{path.rstrip('/')}/{key}'")

    def add(self, rows: DataFrame) -> None:
        for key, table in self.tables.items():
            known = rows.select(key).filter(F.col(key).isNotNull()).distinct()
            # one file a bucket: the rows are dealt out as the table is
            known.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).format("parquet").mode("append").saveAsTable(table)

    def unknown(self, notices: DataFrame) -> DataFrame:
        """Notices whose unique_id and dedup_key are both not in the index."""
        out = notices
        for key, table in self.tables.items():
            out = out.join(self.spark.table(table).hint("merge"), key, "left_anti")
        return out.select(*notices.columns)
