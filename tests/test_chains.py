"""Two-key dedup over long chains, components, bucketed keys and segments of alerts."""

import random

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import dedup, health
from noticeboard.operators.components import components
from noticeboard.session import scratch_path

KEYS = "rank long, unique_id string, dedup_key string"


def greedy(rows):
    ids, keys, kept = set(), set(), []
    for r, u, d in sorted(rows):
        if u not in ids and d not in keys:
            ids.add(u)
            keys.add(d)
            kept.append(r)
    return kept


def test_a_chain_of_20000_rows(spark):
    # row i shares its first key with i - 1 and its second with i + 1
    rows = [(i, f"u{(i + 1) // 2}", f"d{i // 2}") for i in range(20_000)]
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    got = dedup.greedy_first(spark.createDataFrame(rows, KEYS).repartition(4), ["rank"])
    assert sorted(r["rank"] for r in got.collect()) == greedy(rows)
    jobs = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert jobs < 600      # a round per two rows would be 10,000 rounds of several jobs


@pytest.mark.parametrize("max_rounds", [0, 1, 6])
def test_random_graphs_and_null_keys(spark, max_rounds):
    rng = random.Random(max_rounds)
    rows = [(i, rng.choice([None, *map(str, range(60))]), rng.choice([None, *map(str, range(60))])) for i in range(300)]
    got = dedup.greedy_first(spark.createDataFrame(rows, KEYS), ["rank"], max_rounds=max_rounds)
    assert sorted(r["rank"] for r in got.collect()) == greedy([(r, u, d) for r, u, d in rows])
    assert dedup.greedy_first(spark.createDataFrame([], KEYS), ["rank"], max_rounds=max_rounds).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 600)] + [(700, 700)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(root)}


def test_the_ledger_is_not_moved(spark):
    path = scratch_path(spark, "index")
    index = dedup.KeyIndex(spark, path, 4)
    notices = spark.createDataFrame([(i, f"u{i % 40}", f"d{i % 7}" if i % 5 else None) for i in range(60)], KEYS)
    assert index.unknown(notices).count() == 60
    index.add(notices.filter("rank < 3"))
    index.add(notices.filter("rank = 11"))
    again = dedup.KeyIndex(spark, path, 4)
    ledger = notices.filter("rank < 3 or rank = 11")
    want = sorted(r["rank"] for r in dedup.not_in_ledger(notices, ledger).collect())
    # a null dedup_key is known to nobody
    assert sorted(r["rank"] for r in again.unknown(notices).collect()) == want and 0 < len(want) < 60
    found = again.unknown(notices)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # one exchange a key, that of the notices; both sides of the ledger are read as they are stored
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2 and plan.count("SortMergeJoin") == 2


def test_segments_equal_the_fold_of_whole_groups(spark):
    rng = random.Random(5)
    rows, at = [], {"a": 0, "b": 0, None: 0}
    for _ in range(400):
        city = rng.choice(list(at))
        at[city] += 3600 * rng.choice([1, 2, 23, 24, 25, 26, 60])
        rows.append((city, at[city], rng.choice([0, 1, 3]), rng.random() < 0.5))
    want, clock = [], {}
    for city, s, broken, delivered in rows:
        if broken and (clock.get(city) is None or s - clock[city] > 86400):
            want.append((city, s, delivered))
            if delivered:
                clock[city] = s
    rounds = spark.createDataFrame(rows, "city string, s long, broken int, delivered boolean").withColumn("round_at", F.timestamp_seconds("s"))
    got = health.alert_rounds(rounds, ["city"]).select("city", F.unix_timestamp("alert_at"), "delivered").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    parts = health._segments(rounds.withColumn("_s", F.col("s")), ["city"], 86400)
    assert parts.select("city", "_segment").distinct().count() > 20
