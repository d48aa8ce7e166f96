"""Problem 9: abusive, hateful and sexually explicit language in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.abuse import THRESHOLD, clause_scores, clause_table, fit_models, read_corpus, score_texts, text_scores
from tracewright.session import spread, table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return score_texts(docs, "text", "doc_id", table(spark, sf_dir, "abuse_labels")).select("doc_id", "source", "score")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = read_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id")
    clauses = clause_table(corpus)
    models = fit_models(table(spark, sf_dir, "abuse_labels"), clauses)
    return text_scores(corpus, clause_scores(clauses, models, THRESHOLD)).select(F.col("key").alias("doc_id"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score", F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).alias("is_case"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and rate per source, documents without a source among them."""
    case = F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).cast("long")
    grouped = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(case).alias("n_cases"))
    return grouped.withColumn("rate", F.col("n_cases") / F.col("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
