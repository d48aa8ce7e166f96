"""Sizes of a comparison before it runs, and rough seconds by fixed rules of thumb."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds per matched pair, bytes a second of hashing, seconds per product of megabytes, bounds of the measured speed.
PAIR_S, LEAST_S, DEEP_BYTES_S, PRODUCT_S, SHOW_S, SLOWEST, FASTEST = 0.05, 1.0, 20 * (1 << 20), 8.0, 0.1, 5.0, 0.2


def prescan(a: DataFrame, b: DataFrame) -> dict:
    """Files and bytes of both sides, pairs of equal paths and the sum of their products in megabytes; sides have ``rel_path, length``."""
    sized = [side.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first() for side in (a, b)]
    both = a.select("rel_path", F.col("length").alias("la")).join(b.select("rel_path", F.col("length").alias("lb")), "rel_path")
    mb = float(1 << 20)
    pairs, product = both.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("la") / mb * (F.col("lb") / mb)), F.lit(0.0))).first()
    return {"files_a": sized[0][0], "bytes_a": sized[0][1], "files_b": sized[1][0], "bytes_b": sized[1][1], "pairs": pairs, "complexity": product}


def first_phase_seconds(scan: dict, deep: bool = True) -> float:
    return max(LEAST_S, PAIR_S * scan["pairs"]) + (deep and (scan["bytes_a"] + scan["bytes_b"]) / DEEP_BYTES_S)


def second_phase_seconds(scan: dict, measured_first: float, deep: bool = True) -> float:
    """Scaled by how the first phase compared with its estimate, within bounds."""
    speed = min(SLOWEST, max(FASTEST, measured_first / first_phase_seconds(scan, deep)))
    return (PRODUCT_S * scan["complexity"] + SHOW_S * scan["pairs"]) * speed
