"""Problem 5: matched files that were not written by hand for their tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.codeorigin import code_origins, origin
from tracewright.operators.skew import lookup_join
from tracewright.session import cut, table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file named in file_matches with its origin, by content where source_files has one."""
    matches = table(spark, sf_dir, "file_matches")
    named = matches.select(F.col("rel_path_a").alias("rel_path")).unionByName(matches.select(F.col("rel_path_b").alias("rel_path")))
    named = named.where("rel_path is not null").distinct()
    named = cut(named)
    asked = lookup_join(table(spark, sf_dir, "source_files").select("rel_path", "content", "scanned_at"), named, "rel_path", "left_semi")
    known = code_origins(asked, "rel_path", "content", "scanned_at")
    # a file that no scan holds has neither content nor row, and is judged by its path
    return named.join(known.withColumn("seen", F.lit(True)), "rel_path", "left").withColumn(
        "origin", F.when(F.col("seen"), F.col("origin")).otherwise(origin(F.col("rel_path"), F.col("layout")))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("origin is not null").select("rel_path")


def p5_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named file with its origin (hand-written if none) and layout statistics."""
    return _judged(spark, sf_dir).select("rel_path", F.coalesce("origin", F.lit("hand-written")).alias("origin"), "layout.*")


QUERIES = {"p5_found": p5_found, "p5_origins": p5_origins}
SQL: dict[str, str] = {}
