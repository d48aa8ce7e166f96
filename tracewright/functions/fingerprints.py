"""Winnowed fingerprints of token sequences.

One Arrow UDF per row, without any shuffle: tokens are hashed once per distinct token of a batch, k-grams are summed
from precomputed powers, and windows take their right-most minimum by vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# FNV-1a 64, and base and modulus of the rolling hash.
FNV_OFFSET, FNV_PRIME, BASE, MODULUS = 0xCBF29CE484222325, 0x100000001B3, 257, (1 << 61) - 1
K, W = 5, 4
_MEMO = 500_000


def fnv1a(token: str) -> int:
    h = FNV_OFFSET
    for byte in token.encode("utf-8", "surrogatepass"):
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


class Winnower:
    def __init__(self, k: int = K, w: int = W):
        if k < 1 or w < 1:
            raise ValueError("k and w must be at least 1")
        self.k, self.w = k, w
        self.codes: dict[str, int] = {}
        self.rows: list[list[int]] = []

    def code(self, token: str) -> int:
        c = self.codes.get(token)
        if c is None:
            h = fnv1a(token)
            c = self.codes[token] = len(self.rows)
            self.rows.append([h * pow(BASE, self.k - 1 - j, MODULUS) % MODULUS for j in range(self.k)])
        return c

    def kgrams(self, tokens) -> np.ndarray:
        """Polynomial hash of each run of k tokens; empty for fewer."""
        n = len(tokens) - self.k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        if len(self.rows) > _MEMO:
            self.codes, self.rows = {}, []
        codes = np.fromiter((self.code(t) for t in tokens), np.int64, len(tokens))
        distinct, place = np.unique(codes, return_inverse=True)
        powers = np.array([self.rows[c] for c in distinct], np.int64)
        total = np.zeros(n, np.int64)
        for j in range(self.k):
            total = (total + powers[place[j : j + n], j]) % MODULUS
        return total

    def winnow(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the right-most minimum of each window, each once."""
        n = len(hashes)
        if n == 0:
            return np.empty(0, np.int64)
        if n <= self.w:
            return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
        windows = np.lib.stride_tricks.sliding_window_view(hashes, self.w)
        return np.unique(np.arange(n - self.w + 1) + self.w - 1 - np.argmin(windows[:, ::-1], axis=1))

    def fingerprints(self, tokens) -> list[dict]:
        hashes = self.kgrams(tokens)
        return [{"h": int(hashes[p]), "pos": int(p)} for p in self.winnow(hashes)]


def fingerprints(tokens: Column, k: int = K, w: int = W) -> Column:
    """array<struct<h bigint, pos int>> of an array of tokens; null for null."""
    Winnower(k, w)

    @F.pandas_udf("struct<h:array<bigint>,pos:array<int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        winnower = Winnower(k, w)
        for batch in batches:
            hashes, positions = [], []
            for t in batch:
                h = None if t is None else winnower.kgrams(t)
                at = None if t is None else winnower.winnow(h)
                hashes.append(None if t is None else h[at])
                positions.append(None if t is None else at.astype(np.int32))
            yield pd.DataFrame({"h": pd.Series(hashes, dtype=object), "pos": pd.Series(positions, dtype=object)})

    found = of(tokens)
    return F.arrays_zip(found["h"], found["pos"]).cast("array<struct<h:bigint,pos:int>>")


def kgram_hashes(tokens: Column, k: int = K) -> Column:
    """array<bigint> of the rolling hashes."""
    Winnower(k, 1)

    @F.pandas_udf("array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        winnower = Winnower(k, 1)
        for batch in batches:
            yield pd.Series([None if t is None else winnower.kgrams(t) for t in batch], dtype=object)

    return of(tokens)


@F.pandas_udf(LongType())
def fnv_mod(token: pd.Series) -> pd.Series:
    """FNV-1a of a token modulo 2^61 - 1, which fits a signed 64-bit integer."""
    return pd.Series([None if t is None else fnv1a(t) % MODULUS for t in token], dtype="Int64")
