"""Fingerprints of documents as they arrive, matched against an index that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions.fingerprints import K, W, fingerprints
from tracewright.functions.tokens import tokens


def postings(docs: DataFrame, doc: str, text: str, k: int = K, w: int = W) -> DataFrame:
    """``doc, h, n``: the distinct hashes of each document and their number; works on batch and streaming frames."""
    hashes = F.array_distinct(F.transform(fingerprints(tokens(F.col(text)), k, w), lambda f: f["h"]))
    sized = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), hashes.alias("hs"))
    return sized.select("doc", F.explode("hs").alias("h"), F.size("hs").cast("long").alias("n"))


def index_stream(docs: DataFrame, doc: str, text: str, index: str, matches: str, checkpoint: str, threshold: float = 0.05) -> StreamingQuery:
    """Start a query that, for each batch, writes matches of new with known documents to ``matches`` and adds the batch to ``index``.

    Both tables are partitioned by batch and a batch overwrites its own part only, so a batch that runs again after a failure changes
    nothing. New documents are matched with earlier batches and among themselves (smaller with larger key).
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new = new.persist()
        part = f"{index}/batch={number}"
        new.write.mode("overwrite").parquet(part)
        known = spark.read.parquet(index).where(F.col("batch") <= number).select(F.col("doc").alias("doc_b"), "h", F.col("n").alias("n_b"), "batch")
        both = new.select(F.col("doc").alias("doc_a"), "h", F.col("n").alias("n_a")).join(known, "h")
        pairs = both.where((F.col("batch") < number) | (F.col("doc_a") < F.col("doc_b"))).where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") * (1 - 1e-9))
        shared = pairs.groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
        found = shared.select("doc_a", "doc_b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= threshold)
        found.write.mode("overwrite").parquet(f"{matches}/batch={number}")
        new.unpersist()

    return postings(docs, doc, text).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
