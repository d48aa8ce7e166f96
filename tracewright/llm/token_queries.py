"""Problems 7 and 8: token ids of all documents, and the mix of sources in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.mixing import mix
from tracewright.llm.tokenizer import encode_corpus
from tracewright.operators.skew import lookup_join
from tracewright.session import spread, table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_corpus(docs, "text").select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sized = encode_corpus(docs, "text", ids=None, count="n_tokens").drop("text")
    return mix(sized, table(spark, sf_dir, "mix_targets"), id_col="doc_id", source_col="source", size_col="n_tokens")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The use made of each document, with the target and actual share of its source; one that takes no part has 0 copies."""
    use, shares = _mix(spark, sf_dir)
    per_source = shares.select("source", "target_share", "max_repeats", "actual_share")
    return lookup_join(use, per_source, "source", "left").select(
        "doc_id", "source", "n_tokens", "copies", "rate", "max_repeats", "target_share", "actual_share"
    )


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source; a source that cannot take part has a null rate and nothing used."""
    _, shares = _mix(spark, sf_dir)
    named = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    none = F.lit(0).cast("long")
    numbers = ["documents", "tokens", "used_documents", "used_copies", "used_tokens"]
    return named.join(shares.drop("target_share", "max_repeats"), "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "rate",
        *(F.coalesce(c, none).alias(c) for c in numbers),
        F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"),
    )


QUERIES = {"p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
