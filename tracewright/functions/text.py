"""Text expressions that stay in the JVM: lines, words, white space, sort keys, escapes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
EOL = r"\r\n|\r|\n"


def normalize_ws(text: Column) -> Column:
    """Runs of blanks and tabs to one blank, none at the start of a line; line ends stay."""
    runs = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(runs, r"(^|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ])[ ]+", "$1")


def squash_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(\n[ \t]*){3,}", "\n\n")


def split_lines(text: Column) -> Column:
    """Lines by CRLF, CR or LF only, without one empty last element; none for an empty text."""
    parts = F.split(text, EOL, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def collapse_line(line: Column) -> Column:
    return F.array_join(words(line), " ")


def is_boilerplate(line: Column) -> Column:
    """Only brackets, punctuation and white space."""
    return line.rlike(r"\A[\s\x0B\x1C-\x1F\x85\p{Z}{}\[\]();,.:]*\z")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; none for names that begin with their only dot or end in one."""
    return F.lower(F.regexp_extract(basename(path), r"^.*[^.].*?(\.[^.]+)$|^[^.]+(\.[^.]+)$", 1))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers, without regard to case."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\D*\d*"), F.lit(0))

    def piece(x: Column) -> Column:
        digits = F.regexp_extract(x, r"(\d*)$", 1)
        return F.struct(
            F.regexp_extract(x, r"^(\D*)", 1).alias("t"), F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(F.lit(None)).alias("n")
        )

    return F.transform(F.filter(pieces, lambda x: x != ""), piece)


def md_escape(text: Column) -> Column:
    escaped = F.regexp_replace(text, r"([\\`|])", r"\\$1")
    return F.replace(F.replace(escaped, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def wrap_cjk(html: Column) -> Column:
    """Runs of CJK letters of text nodes in a span, so that a fallback font can be set."""
    cjk = r"([ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿]+)(?![^<]*>)"
    return F.regexp_replace(html, cjk, '<span class="cjk">$1</span>')


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - indel distance / summed length), by dynamic programming over the longest common subsequence; 100 for two empty names."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(y, lambda _: F.lit(0))

    def row(held: Column, c: Column) -> Column:
        # one row of the table of common lengths, from the row before
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("corner"))
        cells = F.zip_with(y, held, lambda d, up: F.struct(d.alias("d"), up.alias("up")))
        done = F.aggregate(
            cells,
            start,
            lambda s, k: F.struct(
                F.concat(s["row"], F.array(F.when(k["d"] == c, s["corner"] + 1).otherwise(F.greatest(s["left"], k["up"])))).alias("row"),
                F.when(k["d"] == c, s["corner"] + 1).otherwise(F.greatest(s["left"], k["up"])).alias("left"),
                k["up"].alias("corner"),
            ),
        )
        return done["row"]

    common = F.element_at(F.aggregate(x, zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        F.lit(100.0) * (F.lit(1.0) - (total - 2 * common) / total)
    )


def common_length(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence, a word operation per letter: ``masks`` has the places of each letter of a text of length n."""
    full = (1 << n) - 1
    free = full
    for c in other:
        hit = free & masks.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return n - free.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same as ``indel_ratio``, for many pairs."""
    masks: dict[str, dict[str, int]] = {}
    for left, right in batches:
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            if a not in masks:
                if len(masks) > 50_000:
                    masks.clear()
                places: dict[str, int] = {}
                for i, c in enumerate(a):
                    places[c] = places.get(c, 0) | 1 << i
                masks[a] = places
            total = len(a) + len(b)
            out.append(100.0 * (1.0 - (total - 2 * common_length(masks[a], len(a), b)) / total) if total else 100.0)
        yield pd.Series(out, dtype="float64")
