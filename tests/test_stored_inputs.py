"""Pages as files, page nodes in SQL, rules as JSON lines, ledgers of several schema versions."""

from pyspark.sql import functions as F

from noticeboard.operators import outbox
from noticeboard.sources import fetched, html_nodes, rules

PAGE = "<html><body><ul><li class='a b'><a href='/x'>深圳公告</a></li></ul><nav><a href='/n'>导航</a></nav></body></html>"


def test_files_tell_their_charset(spark, tmp_path):
    stored = {"u": PAGE.encode(), "b": b"\xef\xbb\xbf" + PAGE.encode(), "w": PAGE.encode("utf-16"), "be": b"\xfe\xff" + PAGE.encode("utf-16-be"),
              "g": b"<meta charset=gb2312>" + PAGE.encode("gb18030"), "empty": b""}
    (tmp_path / "deep").mkdir()
    for name, content in stored.items():
        (tmp_path / ("deep" if name == "g" else "") / f"{name}.html").write_bytes(content)
    (tmp_path / "note.txt").write_bytes(b"other")
    read = fetched.decode_pages(fetched.page_files(spark, str(tmp_path), "*.html"))
    got = {r.path.rsplit("/", 1)[1][:-5]: (r.charset, r.html) for r in read.collect()}
    assert got == {"u": ("utf-8", PAGE), "b": ("utf-8-sig", PAGE), "w": ("utf-16", PAGE), "be": ("utf-16", PAGE),
                   "g": ("gb18030", "<meta charset=gb2312>" + PAGE)}  # an empty file is no page


def test_nodes_in_sql_equal_the_nodes_table(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "text only")], "page_id int, html string")
    html_nodes.register_nodes_function(spark)
    got = spark.sql("SELECT page_id, n.* FROM {p}, LATERAL html_nodes(html) n", p=pages)
    want = html_nodes.nodes_table(pages)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("page_id = 1").count() > 3


def test_rules_as_json_lines(spark, tmp_path):
    path = f"{tmp_path}/rules.jsonl"
    spark.createDataFrame([("a", "深圳", "ul li"), ("b", "北京", "ul > li")], "id string, city string, item string").select(
        "id", "city", F.lit("s").alias("source_name"), F.lit("https://x.org").alias("url"), F.struct(F.col("item").alias("list_item")).alias("selectors")
    ).write.json(path)
    checked = rules.check_rules(rules.load_rules(spark, path))
    assert sorted((r.id, r.problems, len(r.selector_problems)) for r in checked.collect()) == [("a", [], 0), ("b", [], 1)]


def test_versions_of_a_ledger_are_united(spark, tmp_path):
    rows = spark.createDataFrame([(1, "https://X.org:443/a", "深圳", "公告")], "id int, url string, city string, title string")
    rows.write.parquet(f"{tmp_path}/l/batch=0")
    rows.withColumns({"id": F.lit(2), "notes": F.lit("n"), "dedup_key": F.lit("k"), "canonical_url": F.lit("c"), "notify_attempts": F.lit(3)}).write.parquet(f"{tmp_path}/l/batch=1")
    full = outbox.backfill(outbox.stored_versions(spark, f"{tmp_path}/l"), {"notes": "string", "notify_attempts": "int"}, {"notify_attempts": 0})
    old, new = full.orderBy("id").collect()
    assert (old.notes, old.notify_attempts, old.canonical_url) == (None, 0, "https://x.org/a") and old.dedup_key
    assert (new.notes, new.notify_attempts, new.canonical_url, new.dedup_key) == ("n", 3, "c", "k")
