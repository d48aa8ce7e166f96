"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Frequent words of the corpus are compiled, with their ids as outputs, into a minimal acyclic transducer: a
shared-suffix automaton over bytes whose transitions carry numbers that add up to a word's place in the table of outputs. It is
written once to the shared folder and memory-mapped by every worker. A batch is split into words; its distinct
words run through the automaton together, one byte per vector step; words it lacks are merged exactly, pair by pair
in the order of the ranks. The lexicon is a cache only: ids do not depend on what it holds.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import shared_dir

TOKENIZER_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words compiled into the lexicon at most, and bytes of the longest: they bound its size at any corpus size.
LEXICON_WORDS = 40_000
LEXICON_BYTES = 32
#: Distinct unseen words whose merges a worker remembers.
MEMO_WORDS = 200_000
MAGIC = 0x54574C58


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging: always the pair of lowest rank, the leftmost of equal ones. O(n log n) for any length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    right = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = right[i]
        if not alive[i] or middle >= n or right[middle] != end:
            continue  # one of the two parts has changed since
        alive[middle] = False
        right[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : right[end]])) is not None:
                heapq.heappush(heap, (r, i, right[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : right[i]]] for i in range(n) if alive[i]]


class Lexicon:
    """Minimal acyclic transducer from words to id lists, as flat arrays.

    A state's transitions are ``first[s]:first[s+1]``, sorted by byte; each has a target and the number of
    words that sort before those behind it. ``final`` marks states where a word ends. The sum along a word's path
    is its rank among all words; ``offsets`` and ``ids`` hold the outputs by rank.
    """

    FIELDS = ("first", "byte", "target", "skip", "final", "offsets", "ids")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.longest = LEXICON_BYTES
        self.keys = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + self.byte

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words: a state is frozen, or replaced by an equal one, once no later word can pass it."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...)) of frozen states, targets before sources

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states: final, transitions
        last = b""
        for word in order:
            common = 0
            while common < min(len(last), len(word)) and last[common] == word[common]:
                common += 1
            for at in range(len(last), common, -1):
                done = freeze(path.pop())
                path[-1][1].append((last[at - 1], done))
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
        for at in range(len(last), 0, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[at - 1], done))
        freeze(path.pop())

        behind = [0] * len(states)
        first, byte, target, skip = [0], [], [], []
        for s, (final, moves) in enumerate(states):
            n = int(final)
            for b, t in moves:
                byte.append(b)
                target.append(t)
                skip.append(n)
                n += behind[t]
            behind[s] = n
            first.append(len(byte))
        outputs = [words[w] for w in order]
        return cls(
            first=np.array(first, np.int64),
            byte=np.array(byte, np.int64),
            target=np.array(target, np.int64),
            skip=np.array(skip, np.int64),
            final=np.array([f for f, _ in states], np.int64),
            offsets=np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64),
            ids=np.array([i for o in outputs for i in o], np.int64),
        )

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 if it is not held. All words step through the automaton together."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(live) or not len(self.keys):
            return out
        text = np.zeros((len(live), self.longest), np.uint8)
        joined = np.frombuffer(b"".join(words[i] for i in live), np.uint8)
        size = lengths[live]
        row = np.repeat(np.arange(len(live)), size)
        text[row, np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)] = joined
        state = np.full(len(live), len(self.first) - 2, np.int64)  # the root was frozen last
        rank = np.zeros(len(live), np.int64)
        at = np.arange(len(live))
        for step in range(int(size.max())):
            go = at[size[at] > step]
            key = state[go] * 256 + text[go, step]
            move = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[move] == key
            rank[go[~fits]] = -1
            state[go[fits]] = self.target[move[fits]]
            rank[go[fits]] += self.skip[move[fits]]
            at = at[(size[at] <= step) | (rank[at] >= 0)]
            if not (size[at] > step + 1).any():
                break
        ended = np.zeros(len(live), bool)
        ended[at] = (rank[at] >= 0) & (self.final[state[at]] == 1)
        out[live[ended]] = rank[ended]
        return out

    def save(self, path: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, name), np.int64) for name in self.FIELDS]
        head = np.array([MAGIC, *(len(a) for a in arrays)], np.int64)
        with open(path + ".part", "wb") as out:
            for a in (head, *arrays):
                out.write(a.tobytes())
        os.replace(path + ".part", path)

    @classmethod
    def load(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, "r")
        sizes = whole[1 : 1 + len(cls.FIELDS)]
        if whole[0] != MAGIC or len(whole) != 1 + len(cls.FIELDS) + int(sizes.sum()):
            raise ValueError(f"{path} is no lexicon")
        at, arrays = 1 + len(cls.FIELDS), {}
        for name, n in zip(cls.FIELDS, sizes.tolist(), strict=True):
            arrays[name] = whole[at : at + n]
            at += n
        return cls(**arrays)


class Encoder:
    """Ids of texts; one per worker process, see ``encoder``."""

    def __init__(self, rank_path: str, lexicon: Lexicon | None):
        self.ranks, self.lexicon = ranks_of(rank_path), lexicon
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[bytes, list[int]] = {}

    def word(self, word: bytes) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            ids = merge_word(word, self.ranks)
            if len(word) <= 64:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, concatenated; none for null and empty texts."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.split(text)
                counts[i] = len(found)
                words += found
        if not words:
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64)
        code, distinct = pd.factorize(np.array(words, object))
        raw = [w.encode("utf-8", "surrogatepass") for w in distinct]
        place = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1, np.int64)
        missing = np.flatnonzero(place < 0)
        merged = [self.word(raw[i]) for i in missing]
        pool = [self.lexicon.ids] if self.lexicon else []
        held = len(self.lexicon.ids) if self.lexicon else 0
        length = np.empty(len(raw), np.int64)
        start = np.empty(len(raw), np.int64)
        if self.lexicon:
            known = place >= 0
            start[known] = self.lexicon.offsets[place[known]]
            length[known] = self.lexicon.offsets[place[known] + 1] - start[known]
        size = np.fromiter(map(len, merged), np.int64, len(merged))
        start[missing] = held + np.cumsum(size) - size
        length[missing] = size
        pool.append(np.fromiter((x for ids in merged for x in ids), np.int64, int(size.sum())))
        pool = np.concatenate(pool)
        n = length[code]
        ends = np.cumsum(n)
        ids = pool[np.repeat(start[code] - (ends - n), n) + np.arange(int(ends[-1]))]
        of_words = np.concatenate([[0], ends])
        return of_words[np.concatenate([[0], np.cumsum(counts)])], ids


_held: dict[tuple, Encoder] = {}


def encoder(rank_path: str, lexicon_path: str | None, lexicon_bytes=None) -> Encoder:
    """The process's encoder; the lexicon is mapped from the shared folder or, if that is no file system, from a copy of its bytes."""
    key = (rank_path, lexicon_path)
    if key not in _held:
        lexicon = None
        if lexicon_path and os.path.exists(lexicon_path):
            lexicon = Lexicon.load(lexicon_path)
        elif lexicon_bytes is not None:
            with tempfile.NamedTemporaryFile(delete=False) as out:
                out.write(lexicon_bytes.value)
            lexicon = Lexicon.load(out.name)
            os.unlink(out.name)
        _held.clear()
        _held[key] = Encoder(rank_path, lexicon)
    return _held[key]


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word`` (binary), ``n``: occurrences in all texts of each word up to ``LEXICON_BYTES`` bytes, counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        held: Counter = Counter()

        def out():
            pairs = [(w.encode("utf-8", "surrogatepass"), n) for w, n in held.items()]
            pairs = [(w, n) for w, n in pairs if len(w) <= LEXICON_BYTES]
            return pa.record_batch([pa.array([w for w, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(split(t))
            if len(held) > 200_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.select(F.col(text).alias("t")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, texts: DataFrame, text: str, *, rank_path: str, words: int = LEXICON_WORDS):
    """Count the words of all texts, compile the most frequent ones and place the file in the shared folder. Returns (path, bytes or None)."""
    ranks = ranks_of(rank_path)
    top = word_counts(texts, text).orderBy(F.desc("n"), "word").limit(words).collect()
    lexicon = Lexicon.build({bytes(r["word"]): merge_word(bytes(r["word"]), ranks) for r in top})
    folder = shared_dir(spark)
    local = folder[len("file:") :] if folder.startswith("file:") else folder
    if "://" not in local or folder.startswith("file:"):
        local = "/" + local.lstrip("/")
        os.makedirs(local, exist_ok=True)
        spot = os.path.join(local, f"lexicon-{uuid.uuid4().hex}.tmp")
        lexicon.save(spot)
        with open(spot, "rb") as held:
            path = os.path.join(local, f"lexicon-{hashlib.file_digest(held, 'sha256').hexdigest()[:32]}.bin")
        os.replace(spot, path)  # named by its content: the same corpus leaves one file, however often it is encoded
        return path, None
    with tempfile.TemporaryDirectory() as spot:
        lexicon.save(os.path.join(spot, "x"))
        with open(os.path.join(spot, "x"), "rb") as held:
            return f"lexicon-{uuid.uuid4().hex}", spark.sparkContext.broadcast(held.read())


def encode_corpus(
    df: DataFrame, text: str, *, ids: str | None = "ids", count: str | None = None, rank_path: str = f"{TOKENIZER_DIR}/{RANK_FILE}", lexicon=None
) -> DataFrame:
    """``df`` with the token ids of column ``text`` (array of int) in ``ids`` and their number (bigint) in ``count``.

    Null and empty texts give an empty list and 0. Text that looks like a special token is encoded as ordinary text.
    Columns of the same name are replaced; all others pass through, as do repeated rows; an empty table gives none.
    ``lexicon`` is what ``compile_lexicon`` returned; without it, it is compiled from the texts first.
    """
    path, copy = lexicon or compile_lexicon(df.sparkSession, df, text, rank_path=rank_path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(rank_path, path, copy)
        for batch in batches:
            parts: list = []
            for some in _bounded(batch.tolist()):
                offsets, all_ids = e.batch(some)
                narrow = all_ids.astype(np.int32)
                parts.extend(narrow[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            yield pd.Series(parts)

    @F.pandas_udf("bigint")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(rank_path, path, copy)
        for batch in batches:
            yield pd.Series(np.concatenate([np.diff(e.batch(some)[0]) for some in _bounded(batch.tolist())] or [np.empty(0, np.int64)]))

    if ids:
        df = df.withColumn(ids, encode(F.col(text)))
        return df.withColumn(count, F.size(ids).cast("long")) if count else df
    return df.withColumn(count, measure(F.col(text)))


def _bounded(texts: list, characters: int = 2_000_000) -> Iterator[list]:
    """Runs of texts of at most so many characters, or of one text."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t or "") > characters:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t or "")
    if held:
        yield held
