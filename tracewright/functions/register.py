"""The functions of this package for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tracewright.functions.comments import strip_comments_udf
from tracewright.functions.fingerprints import K, W, Winnower, fnv_mod
from tracewright.functions.text import indel_ratio_udf
from tracewright.functions.tokens import lexed_udf


def register_functions(spark: SparkSession) -> None:
    """``tw_strip_comments(text, ext)``, ``tw_indel_ratio(a, b)``, ``tw_fnv(token)``, ``tw_lex(text, ext)``, and the table functions
    ``tw_winnow(text, k, w)`` and ``tw_opcodes(a, b)``."""
    from tracewright.session import ship

    ship(spark)
    for name, function in (("tw_strip_comments", strip_comments_udf()), ("tw_indel_ratio", indel_ratio_udf), ("tw_fnv", fnv_mod), ("tw_lex", lexed_udf)):
        spark.udf.register(name, function)

    @udtf(returnType="h bigint, pos int")
    class Winnow:
        def eval(self, text: str, k: int, w: int):
            import regex

            parts = regex.findall(r"[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x85\p{Z}]", text or "")
            for f in Winnower(k or K, w or W).fingerprints(parts):
                yield f["h"], f["pos"]

    @udtf(returnType="tag string, i1 int, i2 int, j1 int, j2 int")
    class Opcodes:
        def eval(self, a: str, b: str):
            from tracewright.operators.diffs import diff

            for c in diff(a or "", b or "")["opcodes"]:
                yield c["tag"], c["i1"], c["i2"], c["j1"], c["j2"]

    spark.udtf.register("tw_winnow", Winnow)
    spark.udtf.register("tw_opcodes", Opcodes)
