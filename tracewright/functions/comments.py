"""Comment removal. Strings, templates and regular expressions stay; the number of lines stays; comment text is deleted.

A scanner that jumps between the places where something can begin or end, instead of stepping through characters. For markup
without quotes (HTML, XML, CSS) there is also an expression that stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewright.functions.languages import REGISTRY, Grammar, Registry

# What may stand before a regular expression literal.
_REGEX_AFTER = frozenset("(,;{}[=+-*%&|^!~<>?:")
_REGEX_AFTER_WORDS = frozenset("return typeof instanceof in of new delete void do else yield await case".split())

_IF_ZERO = re.compile(r"\s*#\s*if\s+0\s*$")
_DEEPER = re.compile(r"\s*#\s*if\b")
_CLOSER = re.compile(r"\s*#\s*endif\b")
_BLANKS = re.compile(r"(\n[ \t]*){3,}")
_STRING_STOP = {d: re.compile(r"\\|" + re.escape(d)) for q in "\"'`" for d in (q, q * 3)}
_REGEX_STOP = re.compile(r"[\\\[\]/]")
_LAST_WORD = re.compile(r"[\w$]*\Z")


def blank_if_zero(text: str) -> str:
    """Lines of ``#if 0`` blocks become empty. Only ``#if`` nests; an ``#else`` does not end the block."""
    depth, out = 0, []
    for line in text.split("\n"):
        if depth:
            depth += 1 if _DEEPER.match(line) else -1 if _CLOSER.match(line) else 0
            out.append("")
        elif _IF_ZERO.match(line):
            depth = 1
            out.append("")
        else:
            out.append(line)
    return "\n".join(out)


class _Scanner:
    """Removes comments of one grammar from one text; holds what carries over from line to line."""

    CODE, STRING, TEMPLATE, REGEX, BLOCK = range(5)

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.start, self.end = grammar.block or ("", "")
        marks = [*grammar.quotes, *grammar.templates, *grammar.line, *(m for m in (self.start, self.end) if m)]
        if grammar.regex_literals:
            marks.append("/")
        self.trigger = re.compile("|".join(map(re.escape, marks)))
        stops = [*grammar.quotes, *grammar.templates, "}", *(["/"] if grammar.regex_literals else []), *(m for m in (self.start,) if m), *grammar.line]
        self.stop = re.compile("|".join(map(re.escape, stops)))
        self.template_stop = re.compile("|".join([r"\\", r"\$\{", *map(re.escape, grammar.templates)]))

    def strip(self, text: str) -> str:
        self.mode, self.delimiter, self.escape, self.depth = self.CODE, "", False, 0
        self.before, self.word, self.inside = "", "", False  # last code character, last word, whether it goes on
        return "\n".join(map(self.line, text.split("\n")))

    def value_ends(self) -> None:
        self.mode, self.before, self.word, self.inside = self.CODE, ")", "", False

    def saw(self, code: str) -> None:
        """Remember the end of plain code, to tell a regular expression from a division."""
        if not self.g.regex_literals or not code:
            return
        solid = code.rstrip()
        if not solid:
            self.inside = False
            return
        tail = _LAST_WORD.search(solid)[0]
        goes_on = self.inside and len(tail) == len(solid)
        self.word = self.word + tail if goes_on else tail
        self.before, self.inside = solid[-1], bool(tail) and len(solid) == len(code)

    def line(self, line: str) -> str:
        if self.mode == self.CODE and not self.trigger.search(line):
            if self.g.regex_literals and (solid := line.rstrip()):
                self.before, self.word, self.inside = solid[-1], _LAST_WORD.search(solid)[0], False
            return line
        kept: list[str] = []
        at = 0
        while at < len(line):
            at = (self.code, self.string, self.template, self.regex, self.block)[self.mode](line, at, kept)
        if self.mode == self.STRING and len(self.delimiter) == 1:
            self.mode = self.CODE  # an unclosed string ends with its line; a pending escape does not
        elif self.mode == self.REGEX:
            self.value_ends()
        return "".join(kept)

    def code(self, line: str, at: int, kept: list[str]) -> int:
        found = self.stop.search(line, at)
        to = found.start() if found else len(line)
        kept.append(line[at:to])
        self.saw(line[at:to])
        if not found:
            return to
        c = line[to]
        if c in self.g.quotes:
            self.delimiter = c * 3 if line.startswith(c * 3, to) else c
            kept.append(self.delimiter)
            self.mode = self.STRING
            return to + len(self.delimiter)
        if c in self.g.templates:
            kept.append(c)
            self.mode = self.TEMPLATE
            return to + 1
        if c == "}" and self.depth:
            self.depth -= 1
            kept.append(c)
            self.mode = self.TEMPLATE
            return to + 1
        if c == "/" and self.g.regex_literals and line[to + 1 : to + 2] not in ("/", "*") and self.expects_value():
            kept.append(c)
            self.mode, self.in_class = self.REGEX, False
            return to + 1
        if self.start and line.startswith(self.start, to) and (to == 0 or not self.g.block_at_line_start):
            self.mode = self.BLOCK
            return to + len(self.start)
        if any(line.startswith(m, to) for m in self.g.line):
            return len(line)
        kept.append(c)
        self.saw(c)
        return to + 1

    def expects_value(self) -> bool:
        return self.word in _REGEX_AFTER_WORDS or self.before == "" or self.before in _REGEX_AFTER

    def escaped(self, line: str, at: int, kept: list[str]) -> int:
        self.escape = False
        kept.append(line[at])
        return at + 1

    def string(self, line: str, at: int, kept: list[str]) -> int:
        if self.escape:
            return self.escaped(line, at, kept)
        found = _STRING_STOP[self.delimiter].search(line, at)
        if not found:
            kept.append(line[at:])
            return len(line)
        kept.append(line[at : found.end()])
        if found[0] == "\\":
            self.escape = True
        else:
            self.value_ends()
        return found.end()

    def template(self, line: str, at: int, kept: list[str]) -> int:
        if self.escape:
            return self.escaped(line, at, kept)
        found = self.template_stop.search(line, at)
        if not found:
            kept.append(line[at:])
            return len(line)
        kept.append(line[at : found.end()])
        if found[0] == "\\":
            self.escape = True
        elif found[0] == "${":
            self.depth += 1
            self.mode, self.before, self.word, self.inside = self.CODE, "{", "", False
        else:
            self.value_ends()
        return found.end()

    def regex(self, line: str, at: int, kept: list[str]) -> int:
        if self.escape:
            return self.escaped(line, at, kept)
        found = _REGEX_STOP.search(line, at)
        if not found:
            kept.append(line[at:])
            return len(line)
        kept.append(line[at : found.end()])
        c = found[0]
        if c == "\\":
            self.escape = True
        elif c == "/":
            if not self.in_class:
                self.value_ends()
        else:
            self.in_class = c == "["
        return found.end()

    def block(self, line: str, at: int, kept: list[str]) -> int:
        if self.g.block_at_line_start:
            to = 0 if at == 0 and line.startswith(self.end) else -1
        else:
            to = line.find(self.end, at)
        if to < 0:
            return len(line)
        self.mode = self.CODE
        return to + len(self.end)


@lru_cache(maxsize=64)
def _scanner(grammar: Grammar) -> _Scanner:
    return _Scanner(grammar)


def strip_comments(text: str, extension: str, squash_blanks: bool = False, grammars: dict[str, Grammar] | None = None) -> str:
    """Text without comments by the grammar of ``extension`` (lower case, with its dot); unchanged if unknown."""
    grammar = REGISTRY.grammar(extension) if grammars is None else grammars.get(extension)
    if grammar is None or not (grammar.line or grammar.block):
        return text
    if grammar.if_zero:
        text = blank_if_zero(text)
    text = _scanner(grammar).strip(text)
    return _BLANKS.sub("\n\n", text) if squash_blanks else text


def strip_comments_udf(registry: Registry = REGISTRY):
    """The function of (text, extension) for the cluster, with the grammars that are registered now."""
    grammars = registry.grammars()

    @F.pandas_udf(StringType())
    def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, extensions in batches:
            yield pd.Series([None if t is None else strip_comments(t, e or "", grammars=grammars) for t, e in zip(texts, extensions, strict=True)], dtype=object)

    return strip


def _without(text: Column, segments: str, opening: str) -> Column:
    drop = lambda s: F.when(F.startswith(s, F.lit(opening)), F.regexp_replace(s, r"[^\n]", "")).otherwise(s)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(segments), F.lit(0)), drop), "")


def strip_markup_comments(text: Column) -> Column:
    """HTML, XML and SVG, in the JVM."""
    return _without(text, r"(?s)<!--.*?(?:-->|\z)|[^<]+|<", "<!--")


def strip_css_comments(text: Column) -> Column:
    return _without(text, r"(?s)/\*.*?(?:\*/|\z)|[^/]+|/", "/*")


def clean(text: Column, extension: Column) -> Column:
    """Text without comments; markup stays in the JVM, other languages go through Arrow, which gets nothing of the rest."""
    tags, sheet = extension.isin(".html", ".htm", ".xml", ".svg"), extension == ".css"
    other = F.when(~F.coalesce(tags | sheet, F.lit(False)), text)
    return F.when(tags, strip_markup_comments(text)).when(sheet, strip_css_comments(text)).otherwise(strip_comments_udf()(other, extension))
