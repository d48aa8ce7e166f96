"""A directory tree as a DataFrame, by a Python data source.

Spark's own binary file source leaves out empty files and names or folders that begin with ``_`` or ``.``, and follows
symbolic links. This one keeps the former, refuses the latter and says so, prunes ignored folders during the walk, and reads file
contents in parallel tasks. Folders must be visible to all executors.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rel_path string, length bigint, mtime timestamp, content binary, error string"
FILES_PER_TASK = 500
# What a scan leaves out unless told otherwise.
DEFAULT_IGNORES = tuple("node_modules dist build .next .nuxt __pycache__ *.py[cod] *$py.class .venv venv env *.class target .gradle .DS_Store Thumbs.db .vscode .idea .git".split())


def _anywhere(pattern: str) -> bool:
    return "/" not in pattern and "**" not in pattern


def ignore_regexes(patterns: Sequence[str]) -> list[tuple[bool, str]]:
    """(whether it applies to each name of a path, regular expression) of the patterns that are not blank or comments."""
    kept = [p.strip() for p in patterns]
    return [(_anywhere(p), fnmatch.translate(p if _anywhere(p) else p.strip("/"))) for p in kept if p and not p.startswith("#")]


def should_ignore(rel_path: str, patterns: Sequence[str]) -> bool:
    """Whether a pattern ignores this file or folder itself. A star also crosses slashes."""
    name = rel_path.rsplit("/", 1)[-1]
    for anywhere, regex in ignore_regexes(patterns):
        if re.match(regex, name if anywhere else rel_path):
            return True
        if not anywhere and re.match(regex, rel_path + "/") or not anywhere and any(re.match(regex, p) for p in _parents(rel_path)):
            return True
    return False


def _parents(rel_path: str) -> list[str]:
    parts = rel_path.split("/")[:-1]
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def ignored(rel_path: Column, patterns: Sequence[str]) -> Column:
    """The same for whole paths as an expression: a file goes if it, or a folder that holds it, is ignored."""
    out = F.lit(False)
    for pattern in (p.strip() for p in patterns):
        if not pattern or pattern.startswith("#"):
            continue
        anywhere = _anywhere(pattern)
        body = _java(pattern if anywhere else pattern.strip("/"))
        # a name at any depth, or the path from its start; and whatever lies below
        out = out | rel_path.rlike(rf"(^|/){body}(/|$)" if anywhere else rf"^{body}(/|$)")
    return out


def _java(pattern: str) -> str:
    """Glob to regular expression: ``*`` crosses slashes except within a bare name, as a name holds none."""
    star = "[^/]*" if _anywhere(pattern) else ".*"
    out = ""
    for piece in re.findall(r"\*+|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern):
        out += star if piece[0] == "*" else "." if piece == "?" else "[" + piece[1:].replace("!", "^", 1) if len(piece) > 1 and piece[0] == "[" else re.escape(piece)
    return out


def walk(root: str, patterns: Sequence[str] = ()) -> tuple[list[str], list[tuple[str, str]]]:
    """(sorted relative paths of regular files, what could not be read with the reason)."""
    found: list[str] = []
    skipped: list[tuple[str, str]] = []
    for folder, folders, names in os.walk(root, onerror=lambda e: skipped.append((os.path.relpath(e.filename, root), str(e.strerror)))):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        under = lambda name, base=base: name if base == "." else f"{base}/{name}"
        folders[:] = sorted(d for d in folders if not should_ignore(under(d), patterns))
        for name in names:
            path = under(name)
            if should_ignore(path, patterns):
                continue
            full = os.path.join(folder, name)
            if os.path.islink(full):
                skipped.append((path, "symbolic link"))
            elif os.path.isfile(full):
                found.append(path)
    return sorted(found), sorted(skipped)


class _Files(InputPartition):
    def __init__(self, paths: list[str], skipped: list[tuple[str, str]]):
        self.paths, self.skipped = paths, skipped


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.patterns = [p for p in options.get("ignore", "").split("\n") if p]
        self.cap = int(options.get("maxBytes", "0"))

    def partitions(self) -> list[InputPartition]:
        paths, skipped = walk(self.root, self.patterns)
        parts = [_Files(paths[i : i + FILES_PER_TASK], []) for i in range(0, len(paths), FILES_PER_TASK)]
        return [*parts, _Files([], skipped)]

    def read(self, partition) -> Iterator[tuple]:
        for path, reason in partition.skipped:
            yield path, None, None, None, reason
        for path in partition.paths:
            full = os.path.join(self.root, path)
            try:
                state = os.stat(full)
                when = datetime.fromtimestamp(state.st_mtime, timezone.utc)
                data = None
                if not self.cap or state.st_size <= self.cap:
                    with open(full, "rb") as held:
                        data = held.read()
                yield path, state.st_size, when, data, None
            except PermissionError:
                yield path, None, None, None, "Access Denied (PermissionError)"
            except OSError as e:
                yield path, None, None, None, str(e)


class SourceTree(DataSource):
    """``spark.read.format("srctree").option("ignore", "a\\nb").load(folder)``; contents above ``maxBytes`` stay null."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, folder: str, ignore: Sequence[str] = (), max_bytes: int = 0) -> DataFrame:
    """Files of a folder, and in ``error`` rows what could not be read or is not followed."""
    from tracewright.session import ship

    ship(spark)
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("srctree").option("ignore", "\n".join(ignore))
    return (reader.option("maxBytes", str(max_bytes)) if max_bytes else reader).load(folder)


def load_ignores(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def decode_bytes(data: bytes | None, encoding: str | None = None) -> str | None:
    """Text of a file, or None if it is binary. Without an encoding the best guess, then the usual ones in turn."""
    if data is None:
        return None
    if not data:
        return ""
    if encoding:
        try:
            return data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            return None
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None and best.chaos <= 0.3:
            return str(best)
    except ImportError:
        if b"\x00" in data:
            return None
    for name in ("utf-8", "euc-kr", "cp949"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def decoded(content: Column, encoding: str | None = None) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode_bytes(x, encoding) for x in batch], dtype=object)

    return of(content)
