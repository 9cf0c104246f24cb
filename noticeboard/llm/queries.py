"""The registered queries of the corpus operators, with SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from noticeboard.llm import (
    aho_search, bayes_join, bpe_automaton, budget_mix, char_cnn_secrets, ftrl_langid, hypergeometric_shards, knn_quality,
    overlap_resampling, tput_search, url_shift_and, vp_search, weak_toxicity)
from noticeboard.llm.common import read

QUERIES, ORACLES = {}, {}
VOCABULARY = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_knn_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return knn_quality.quality_scores(docs, knn_quality.fit_quality(docs, read(spark, sf, "labels")))


@query
def op2_weak_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return weak_toxicity.toxicity_scores(docs, weak_toxicity.fit_toxicity(docs, read(spark, sf, "labels")))


@query
def op3_tput_search(spark: SparkSession, sf: str) -> DataFrame:
    return tput_search.exact_top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op3_tput_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5"""


@query
def op4_vp_search(spark: SparkSession, sf: str) -> DataFrame:
    return vp_search.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_char_cnn_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return char_cnn_secrets.secret_findings(docs, char_cnn_secrets.fit_scanner(docs))


@query
def op6_budget_mix(spark: SparkSession, sf: str) -> DataFrame:
    return budget_mix.mixed_copies(read(spark, sf, "documents")).select("doc_id", *budget_mix.LEVELS, "copies")


ORACLES["op6_budget_mix"] = budget_mix.mix_sql()


@query
def op7_ftrl_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return ftrl_langid.languages_of(docs, ftrl_langid.fit_languages(docs))


@query
def op8_bayes_join(spark: SparkSession, sf: str) -> DataFrame:
    return bayes_join.near_duplicates(read(spark, sf, "documents"))


ORACLES["op8_bayes_join"] = bayes_join.near_duplicates_sql()


@query
def op9_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_automaton.bpe_digests(read(spark, sf, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op10_url_shift_and(spark: SparkSession, sf: str) -> DataFrame:
    return url_shift_and.filtered_pages(read(spark, sf, "pages"))


ORACLES["op10_url_shift_and"] = url_shift_and.filtered_pages_sql()


@query
def op11_overlap_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_resampling.importance_ranks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


ORACLES["op11_overlap_resampling"] = overlap_resampling.importance_sql()


@query
def op12_hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hypergeometric_shards.shard_digests(read(spark, sf, "documents"))


@query
def op13_aho_search(spark: SparkSession, sf: str) -> DataFrame:
    return aho_search.lexical_top(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


ORACLES["op13_aho_search"] = aho_search.lexical_sql()
