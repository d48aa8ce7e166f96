"""Line and word differences of pairs of texts, moved blocks, and folded rows for display.

The matching of sequences is the standard library's, row by row in Arrow batches; what follows from its opcodes is
relational. Metrics and opcodes are separate columns, so that a query for ratios computes no rows.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tracewright.functions.text import collapse_line, is_boilerplate

_EOL = re.compile(r"\r\n|\r|\n")
_BLANKS = re.compile(r"[ \t]+")

OPCODE = "struct<tag:string,i1:int,i2:int,j1:int,j2:int>"
DIFF = f"struct<ratio:double,additions:bigint,deletions:bigint,units_a:bigint,units_b:bigint,opcodes:array<{OPCODE}>>"


def lines_of(text: str) -> list[str]:
    """Lines by CRLF, CR or LF only, without one empty last element."""
    parts = _EOL.split(text)
    if parts[-1] == "":
        parts.pop()
    return parts


def even_ws(text: str) -> str:
    return "".join(_BLANKS.sub(" ", line).lstrip(" ") for line in text.splitlines(keepends=True))


def units_of(text: str, by_word: bool, normalize_ws: bool) -> list[str]:
    if normalize_ws:
        text = even_ws(text)
    return text.split() if by_word else lines_of(text)


def diff(a: str, b: str, *, by_word: bool = False, autojunk: bool = True, normalize_ws: bool = False) -> dict:
    """Ratio, counters and opcodes of two texts."""
    x, y = units_of(a, by_word, normalize_ws), units_of(b, by_word, normalize_ws)
    matcher = difflib.SequenceMatcher(None, x, y, autojunk)
    codes = matcher.get_opcodes()
    changed = [c for c in codes if c[0] != "equal"]
    return {
        "ratio": matcher.ratio(),
        "additions": sum(j2 - j1 for _, _, _, j1, j2 in changed),
        "deletions": sum(i2 - i1 for _, i1, i2, _, _ in changed),
        "units_a": len(x),
        "units_b": len(y),
        "opcodes": [dict(zip(("tag", "i1", "i2", "j1", "j2"), c, strict=True)) for c in codes],
    }


def diff_column(a: Column, b: Column, *, by_word: bool = False, autojunk: bool = True, normalize_ws: bool = False) -> Column:
    @F.pandas_udf(DIFF)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["ratio", "additions", "deletions", "units_a", "units_b", "opcodes"]
        for left, right in batches:
            rows = [diff(x or "", y or "", by_word=by_word, autojunk=autojunk, normalize_ws=normalize_ws) for x, y in zip(left, right, strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return of(a, b)


def moved_blocks(pairs: DataFrame, key: str, lines_a: str, lines_b: str, opcodes: str, *, min_lines: int = 3, rare: int = 3, gap: int = 1) -> DataFrame:
    """``key, move_id, a_lines, b_lines``: blocks of lines deleted in one place and inserted in another, line numbers from 0.

    Deleted and inserted lines join on what they say; lines that are blank, mere punctuation or ``rare`` times or more among the deleted
    of their pair stay out. Pairs of lines at one distance are cut into runs where more than ``gap`` lines are missing. Where runs
    claim the same line, the longest has it; a run needs ``min_lines`` lines of its own. Only that choice sees the runs of a pair together.
    """
    spans = pairs.select(F.col(key).alias("_key"), F.col(lines_a).alias("_a"), F.col(lines_b).alias("_b"), F.explode(opcodes).alias("_op")).where("_op.tag != 'equal'")

    def changed(low: str, high: str, lines: str, number: str) -> DataFrame:
        some = spans.where(F.col(f"_op.{low}") < F.col(f"_op.{high}"))
        each = F.transform(F.sequence(f"_op.{low}", F.col(f"_op.{high}") - 1), lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("line")))
        rows = some.select("_key", F.explode(each).alias("_x")).where(~is_boilerplate(F.col("_x.line")))
        return rows.select("_key", collapse_line(F.col("_x.line")).alias("_line"), F.col("_x.i").alias(number))

    deleted = changed("i1", "i2", "_a", "_i")
    deleted = deleted.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("_key", "_line"))).where(F.col("_times") < rare)
    met = deleted.join(changed("j1", "j2", "_b", "_j"), ["_key", "_line"]).select("_key", "_i", "_j", (F.col("_j") - F.col("_i")).alias("_far"))
    along = Window.partitionBy("_key", "_far")
    down = along.orderBy("_i")
    breaks = F.coalesce(F.col("_i") - F.lag("_i").over(down) > gap + 1, F.lit(False)).cast("int")
    runs = met.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(down)).withColumn("_first", F.min(F.struct("_j", "_i")).over(along))
    runs = runs.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("_key", "_far", "_run"))).where(F.col("_size") >= min_lines)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_size", "_first_j", "_first_i", "_run", "_i"], ascending=[False, True, True, True, True])
        i, j = rows["_i"].to_numpy(), rows["_j"].to_numpy()
        taken_a, taken_b = np.zeros(i.max() + 1, bool), np.zeros(j.max() + 1, bool)
        edges = np.flatnonzero(np.diff(rows["_far"].to_numpy()) | np.diff(rows["_run"].to_numpy())) + 1
        blocks = []
        for own in np.split(np.arange(len(rows)), edges):
            own = own[~(taken_a[i[own]] | taken_b[j[own]])]
            if len(own) >= min_lines:
                taken_a[i[own]] = taken_b[j[own]] = True
                blocks.append((rows["_key"].iloc[0], len(blocks), i[own].tolist(), j[own].tolist()))
        return pd.DataFrame(blocks, columns=["_key", "move_id", "a_lines", "b_lines"])

    flat = runs.select("_key", "_far", "_run", "_size", F.col("_first._j").alias("_first_j"), F.col("_first._i").alias("_first_i"), "_i", "_j")
    kind = pairs.schema[key].dataType.simpleString()
    return flat.groupBy("_key").applyInPandas(settle, f"_key {kind}, move_id int, a_lines array<int>, b_lines array<int>").withColumnRenamed("_key", key)


@F.pandas_udf(ArrayType(StructType().add("tag", "string").add("words_a", "string").add("words_b", "string")))
def word_marks_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Word differences of two lines."""
    rows = []
    for x, y in zip(left, right, strict=True):
        a, b = (x or "").split(), (y or "").split()
        codes = difflib.SequenceMatcher(None, a, b, False).get_opcodes()
        rows.append([{"tag": t, "words_a": " ".join(a[i1:i2]), "words_b": " ".join(b[j1:j2])} for t, i1, i2, j1, j2 in codes])
    return pd.Series(rows, dtype=object)


def diff_rows(pairs: DataFrame, key: str, lines_a: str, lines_b: str, opcodes: str, context: int = -1) -> DataFrame:
    """``key, span, seq, tag, line_a, text_a, line_b, text_b``: rows of a side-by-side view, from opcodes and arrays of lines.

    With a ``context`` of 0 or more, rows of an equal span that are farther from its ends are left out (one row
    ``fold`` tells how many); spans no longer than twice the context stay whole. Line numbers start at 1; a side without a line is null.
    """
    spans = pairs.select(key, lines_a, lines_b, F.posexplode(opcodes).alias("span", "op"))
    n_a, n_b = F.col("op.i2") - F.col("op.i1"), F.col("op.j2") - F.col("op.j1")
    rows = F.greatest(n_a, n_b)
    spans = spans.withColumn("n", rows).where("n > 0")
    rows = spans.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    if context >= 0:
        inner = (F.col("op.tag") == "equal") & (F.col("n") > 2 * context) & (F.col("seq") >= context) & (F.col("seq") < F.col("n") - context)
        rows = rows.withColumn("folded", inner).where(~F.col("folded") | (F.col("seq") == context))
    else:
        rows = rows.withColumn("folded", F.lit(False))
    shown = lambda n, x: F.when(~F.col("folded") & (F.col("seq") < n), x)
    at_a, at_b = F.col("op.i1") + F.col("seq"), F.col("op.j1") + F.col("seq")
    return rows.select(
        key,
        "span",
        "seq",
        F.when(F.col("folded"), F.lit("fold")).otherwise(F.col("op.tag")).alias("tag"),
        shown(n_a, at_a + 1).alias("line_a"),
        F.when(F.col("folded"), F.format_string("%d lines", F.col("n") - 2 * context)).otherwise(shown(n_a, F.get(lines_a, at_a))).alias("text_a"),
        shown(n_b, at_b + 1).alias("line_b"),
        shown(n_b, F.get(lines_b, at_b)).alias("text_b"),
    )
