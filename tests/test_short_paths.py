"""i9_every_input (F1): addresses and dates in plain form are not taken apart, and nothing is worked out twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import dates, keys, urls
from noticeboard.functions.text import bind
from noticeboard.operators import filters
from noticeboard.plans import queries_rounds as Q
from noticeboard.plans import round as rounds
from tests.conftest import SF
from tests.test_large_tables import inputs

FRONTS = ["https://a.cn", "http://a.cn", "HTTPS://a.cn", "https://A.cn", "https://a.cn:443", "https://", "ftp://a.cn", "//a.cn", "", " https://a.cn"]
PATHS = ["", "/", "/a", "/a/", "//a", "/a//b", "/index.html", "/a/INDEX.htm", "/index.html/", "/index.htmlx", "/a/../b", "/a.", "/.a/b", "/a b", "/中文",
         "/a%20b~*;", "a/b", "../n/1.html", "..", "/a\n"]
QUERIES = ["", "?", "?a=1", "?t=1", "?T=1", "?ta=1", "?b=1&a=2", "?a=", "?=1", "?a=b%20c", "?a=b+c", "?a=~*", "?a=/../x", "?a=1#f", "?a=1\n"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def addresses(spark):
    rows = [(a + b + c,) for a in FRONTS for b in PATHS for c in QUERIES] + [(None,)]
    return spark.createDataFrame(rows, "u string").coalesce(4)


def test_plain_addresses_normalize_as_from_their_parts(addresses):
    u = F.col("u")
    whole = F.when(u.isNull() | (u == ""), "").otherwise(urls._rebuilt_url(u, V.VOLATILE_QUERY_KEYS, V.INDEX_FILENAMES))
    plain = u.rlike(urls._canonical_but_scheme(V.VOLATILE_QUERY_KEYS, V.INDEX_FILENAMES))
    rows = addresses.select("u", urls.normalize_url(u).alias("got"), whole.alias("want"), plain.alias("plain")).collect()
    assert [(r.u, r.got) for r in rows if r.got != r.want] == []
    assert 20 < sum(bool(r.plain) for r in rows) < len(rows) / 2


def test_plain_references_resolve_as_from_their_parts(addresses):
    for base in ("https://g.cn/a/b.html", "http://g.cn", "HTTP://G.cn/a/?q=1", "//g.cn/x", "", "https://g.cn/a/./b/../c.html?x=1#f", None):
        page = F.lit(base).cast("string")
        whole = bind(urls.split_base(page), lambda p: urls._merged_url(p, F.col("u")))
        rows = addresses.select("u", urls.resolve_url(page, F.col("u")).alias("got"), whole.alias("want")).collect()
        assert [(base, r.u, r.got) for r in rows if r.got != r.want] == []


def test_very_long_paths(spark):
    long = "https://a.cn/" + "a/" * 100_000 + "x"
    assert spark.range(1).select(F.length(urls.normalize_url(F.concat(F.lit(long), F.col("id").cast("string"))))).first()[0] == len(long) + 1


def test_plain_dates(spark):
    texts = {"2024-02-29": (dt.date(2024, 2, 29), "2024-02-29"), "2023-02-29": (None, "2023-02-29"), "0000-01-01": (None, None),
             "0001-01-01": (dt.date(1, 1, 1), None), "1999-12-31": (dt.date(1999, 12, 31), None), "2100-01-01": (dt.date(2100, 1, 1), "2100-01-01"),
             "2024-13-01": (None, None), "2024-1-5": (dt.date(2024, 1, 5), "2024-01-05"), "2024-01-05\n": (dt.date(2024, 1, 5), "2024-01-05"),
             "x 2024-01-05": (dt.date(2024, 1, 5), "2024-01-05"), "": (None, None), None: (None, None)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", dates.publish_date(F.col("t")).alias("d"), dates.parse_date_text(F.col("t")).alias("p")).collect()
    assert {r.t: (r.d, r.p) for r in got} == texts


def test_an_address_is_worked_out_once(spark):
    """The address of a notice is costly to resolve; its key must not repeat that."""
    df = spark.createDataFrame([("/a", "b")], "href string, other string")
    made = df.select(keys.unique_id(urls.resolve_url(F.lit("https://a.cn/"), F.concat("href", F.lit("MARK"), "other"))).alias("uid"))
    assert plan(made).count("MARK") == 1
    assert made.first()[0] == df.select(F.md5(F.lit("https://a.cn/aMARKb"))).first()[0]


def test_keys_of_addresses_are_taken_once_a_round(spark):
    """Cleaning titles leaves addresses and dates as they are."""
    planned = rounds.plan_round(inputs(spark), filters.Policy(today="2026-08-10", threshold=0.0, max_age_days=None), F.to_timestamp(F.lit("2026-08-10 08:00:00")))
    text = plan(planned.judged) + plan(planned.relevant)
    assert "url_encode" not in text.lower() and "UrlCodec" not in text
    rows = planned.relevant.select("url", "unique_id", "dedup_key", "city", "title").collect()
    again = {r.url: r for r in keys.with_keys(planned.relevant.drop("unique_id", "dedup_key")).collect()}
    assert rows and all((again[r.url].unique_id, again[r.url].dedup_key) == (r.unique_id, r.dedup_key) for r in rows)


def test_details_are_read_from_one_store_by_both_rounds(spark, monkeypatch):
    class Seen(Exception):
        pass

    def look(read, *args, **more):
        files = read.details.inputFiles()
        assert files and not any("orders" in f for f in files)
        assert sorted(read.details.collect()) == sorted(Q.every_input(spark, SF).details.collect())
        raise Seen

    monkeypatch.setattr(rounds, "run_round", look)
    with pytest.raises(Seen):
        Q.i9_every(spark, SF)
