"""From raw documents to token counts of a mixture: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``, whatever others it has; they read ``doc_id``, ``text``,
``lang`` and ``source`` only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.llm import bayes_join, bpe_automaton, budget_mix, char_cnn_secrets, weak_toxicity
from noticeboard.llm.common import read, written

REMEMBERED = 100_000    # words a worker keeps while other stages run in it


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half; a null or empty text stays."""
    model = weak_toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return docs.filter(weak_toxicity.toxicity(docs, model) < 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; texts without words stay."""
    return bayes_join.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every secret in their text replaced by a mark and ``n_chars`` counted anew."""
    clean = docs.withColumn("text", char_cnn_secrets.redacted(docs, char_cnn_secrets.fit_scanner(docs)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen by the budgets of their leaf, as often as the epochs take them."""
    return budget_mix.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe_automaton.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"), REMEMBERED)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]
ORACLE_SQL = None  # trained stages have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
