"""The corpus pipeline and the registered queries."""

import __spark_entry__ as entry_module
import corpus_pipeline
from noticeboard.llm.common import written
from tests.llm.helpers import LABELS, ROWS, documents


def test_all_queries_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_no_text_is_lost_with_an_id_that_has_two(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    docs = documents(spark, [(3, b, "en", "x", 0), (5, a, "en", "x", 0), (5, b, "en", "x", 0), (9, a, "en", "x", 0)])
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, b), (5, a)]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 0, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (None, []):
        docs = documents(spark, rows)
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, str(tmp_path)), f"test-{name}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        # the texts without words, the repeated row once, and every other document; mixing takes its share of them
        assert docs.count() == 0 if not rows and rows is not None else 0 < docs.count() <= 2 * len(ROWS)


def test_decisions_take_effect(spark):
    secret = "password=abcdef1234567890"
    rows = [(i, f"satz nummer {i} steht hier ganz allein und ohne kopie {'x' * i} {secret if i == 9 else ''}", "de", "src1", 0) for i in range(30)]
    rows += [(100 + i, "one two three four five six seven eight nine ten", "en", "src1", 0) for i in range(20)]
    rows += [(7, None, "de", "src2", 0), (None, "ohne nummer", "de", "src1", 0), (100, "one two three four five six seven eight nine ten", "en", "src1", 0)]
    docs = documents(spark, rows)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted([*range(30), 100, 7]) and kept.filter("doc_id is null").count() == 1
    clean = corpus_pipeline.without_secrets(spark, docs, "")
    assert clean.count() == len(rows) and clean.filter("contains(text, 'password')").count() == 0
    marked = clean.filter("doc_id = 9").first()
    assert "[SECRET]" in marked.text and marked.n_chars == len(marked.text)
