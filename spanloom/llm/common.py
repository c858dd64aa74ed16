"""Helpers shared by the training-data operators: samples, word splitting,
stable hashing and shingles.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.operators.scratch import materialize, release, shared_dir, small_side  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Java's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8

_RANGE = 1 << 53
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- tables and samples -------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *cols: Column | str) -> DataFrame:
    """The rows of ``docs`` as one struct ``_row`` beside some columns, so that no
    name of theirs clashes with what an operator adds; ``_row.*`` gives them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *cols)


def least_hashed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows of ``df``: those of the least hashes of the columns
    ``by``; rows that agree in all of these count once.

    A first cut at four times the expected hash keeps the search for the n-th
    hash small; only that one number reaches the driver.
    """
    own = df.withColumn("_h", F.pmod(F.xxhash64(*by, F.lit(13)), F.lit(_RANGE)))
    total = own.count()
    if total > n:
        near = own.where(F.col("_h") < min(_RANGE, _RANGE * 4 * n // total + 1)).select("_h").distinct()
        last = near.orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
        own = own.where(F.col("_h") <= F.lit(last).cast("long"))
    return own.dropDuplicates(["_h"]).drop("_h")


# --- words and hashes -----------------------------------------------------------


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, _inverse(base), np.uint64)
        up[0] = down[0] = 1
        held = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return held[0][:n], held[1][:n]


def rolling(h: np.ndarray, width: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` word hashes.

    With S the prefix sums of h[i] * base**-i, the window at i has
    (S[i+width] - S[i]) * base**(i+width-1); everything is modulo 2**64.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * down[: len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * up[width - 1 : width - 1 + n])


def occurrence(h: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones stand before it."""
    out = np.zeros(len(h), np.uint64)
    if len(h) < 2:
        return out
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    runs = np.diff(np.r_[new, len(s)])
    if len(new) < len(s):
        out[order] = (np.arange(len(s)) - np.repeat(new, runs)).astype(np.uint64)
    return out


def plain_shingles(tokens: list[str], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of word shingles in text order.

    A text of 1 to ``width - 1`` words is one shingle; an empty one has none.
    """
    if not tokens:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    return rolling(h, min(width, len(h)))


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes, each labelled with its occurrence number."""
    return mix(s + occurrence(s) * _ODD)


def labelled_shingles(tokens: list[str], width: int = SHINGLE_WORDS) -> np.ndarray:
    """``plain_shingles``, each labelled with its occurrence number."""
    return labelled(plain_shingles(tokens, width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
