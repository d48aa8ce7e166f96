"""Tokens of source code, raw and with identifiers flattened."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewright.functions.languages import COMMON_KEYWORDS, REGISTRY, Registry

TOKEN = r"[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x85\p{Z}]"


def tokens(text: Column) -> Column:
    """Numbers with one decimal point, words, and single other characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def flatten(raw: Column, keywords=COMMON_KEYWORDS) -> Column:
    """Identifiers to ID, numbers to LIT, quotes to STR; keywords and the rest stay."""
    kept = F.array(*(F.lit(k) for k in keywords))
    return F.transform(
        raw,
        lambda t: F.when(F.array_contains(kept, t), t)
        .when(t.rlike(r"^[\p{L}_]"), F.lit("ID"))
        .when(t.rlike(r"^\p{Nd}"), F.lit("LIT"))
        .when(t.isin('"', "'", "`"), F.lit("STR"))
        .otherwise(t),
    )


def flatten_by_language(raw: Column, extension: Column, registry: Registry = REGISTRY) -> Column:
    """The same with the keywords of each row's language; an unknown extension keeps those of all languages."""
    known = F.create_map(*(x for e in registry.extensions() for x in (F.lit(e), F.array(*(F.lit(k) for k in sorted(registry.keywords(e)))))))
    every = F.array(*(F.lit(k) for k in sorted(registry.keywords(None))))
    kept = F.coalesce(F.element_at(known, extension), every)
    return F.transform(
        raw,
        lambda t: F.when(F.array_contains(kept, t), t)
        .when(t.rlike(r"^[\p{L}_]"), F.lit("ID"))
        .when(t.rlike(r"^\p{Nd}"), F.lit("LIT"))
        .when(t.isin('"', "'", "`"), F.lit("STR"))
        .otherwise(t),
    )


def lexed(text: str, extension: str) -> list[str] | None:
    """Flattened tokens by the language's lexer; None if there is no lexer or it fails."""
    try:
        from pygments.lexers import get_lexer_for_filename
        from pygments.token import Token
    except ImportError:
        return None
    kinds = ((Token.Name, "ID"), (Token.Literal.Number, "LIT"), (Token.Literal.String, "STR"))
    out = []
    try:
        for kind, value in get_lexer_for_filename("a" + extension).get_tokens(text):
            value = value.strip()
            if value and kind not in Token.Comment:
                out.append(value if kind in Token.Keyword else next((name for base, name in kinds if kind in base), value))
    except Exception:  # noqa: BLE001 - a lexer may raise anything; one file must not end the run
        return None
    return out


@F.pandas_udf(ArrayType(StringType()))
def lexed_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, extensions in batches:
        yield pd.Series([None if t is None or not e else lexed(t, e) for t, e in zip(texts, extensions, strict=True)], dtype=object)


def has_lexers() -> bool:
    return importlib.util.find_spec("pygments") is not None


def token_channel(text: Column, *, normalize: bool = False, extension: Column | None = None, lang_aware: bool = False) -> Column:
    """Tokens of a channel: raw, flattened by common keywords, or by the language's lexer; its keywords where there is no lexer."""
    if not normalize:
        return tokens(text)
    if not lang_aware or extension is None:
        return flatten(tokens(text))
    by_keywords = flatten_by_language(tokens(text), extension)
    return F.coalesce(lexed_udf(text, extension), by_keywords) if has_lexers() else by_keywords
