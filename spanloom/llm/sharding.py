"""Operator 7: sharding along a Hilbert curve.

Source, language and the logarithm of the size are quantised to ``BITS`` bits
each and mapped to their index on a Hilbert curve, so that near values of all
of them lie in near runs and files can be pruned by any.  The curve order is
cut into runs of equal counts (law ``rows``): shard = rank * shards div rows.

Groups of equal texts stay together: they share the least curve index of their
rows (copies may differ in source or language) and lie side by side on it.  The
law of equal counts comes first: a group is cut only where a shard is full, so
at most ``shards`` - 1 cuts fall into groups.

Ranks need no total sort: rows are counted per bin (curve index, and a hash of
the text that splits large cells), one running sum over the bins gives offsets,
and a bin numbers its own rows.  Bins hold about ``BIN`` rows, more only where
the table would have over ``MOST_BINS``; a group of copies larger than that has
bins of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import materialize, small_side

BITS = 5
SHARDS = 24
BIN = 400
#: Bins that one window task may sum up; beyond them bins grow.
MOST_BINS = 500_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (n, d) with coordinates of ``bits``
    bits: Gray-code transform of the axes, then their bits interleaved."""
    x = np.array(axes, np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _curve(a: Column, b: Column, c: Column) -> Column:
    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.c_[a.to_numpy(), b.to_numpy(), c.to_numpy()]))

    return index(a, b, c)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _level(c: Column) -> Column:
    """A name's place on its axis; null has its own."""
    return F.coalesce((F.crc32(c) % ((1 << BITS) - 1) + 1).cast("int"), F.lit(0))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve).

    One row per row.  Size is the text's UTF-8 bytes plus 8; a null text
    counts as empty.  Shard counts differ by one at most; ``slot`` numbers a
    shard's rows without gaps from 0; equal rows share neither.  Ties on the
    curve go by text, then by hash of doc_id and doc_id.  ``grown_shard`` is null
    under this law.  Extra columns are ignored; an empty table gives an empty
    result.
    """
    text = F.col("text").cast("string")
    size = text_bytes(text) + 8
    rows = docs.select(
        F.col("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("g"),
        _curve(_level(F.col("source").cast("string")), _level(F.col("lang").cast("string")), F.least(F.floor(F.log2(size)), F.lit((1 << BITS) - 1)).cast("int")).alias("curve"),
    )
    rows = materialize(rows, "curve")
    # groups of equal texts: the least curve index and, where they are large, bins of their own
    groups = rows.groupBy("g", "text_crc32", "size").agg(F.count("*").alias("n"), F.min("curve").alias("least"), F.max("curve").alias("most"))
    groups = materialize(groups.where("n > 1"), "groups")
    total = rows.count()
    each = max(BIN, -(-total // MOST_BINS))
    moved = groups.where((F.col("least") < F.col("most")) | (F.col("n") > each)).select("g", "text_crc32", "size", "least", F.when(F.col("n") > each, F.ceil(F.col("n") / each)).cast("long").alias("own"))
    rows = rows.join(small_side(moved, moved.count()), ["g", "text_crc32", "size"], "left").withColumn("curve", F.coalesce("least", "curve")).drop("least")
    rows = materialize(rows, "grouped")
    cells = rows.groupBy("curve").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / each))
    # at most 2**(3 * BITS) = 32,768 cells
    cells = materialize(cells, "cells")
    salted = rows.join(small_side(cells.select("curve", "salts"), 1 << 3 * BITS, 1 << 3 * BITS), "curve")
    # small groups fall into a bin by hash; a large one lies behind these, split by row
    place = F.when(F.col("own").isNull(), F.pmod("g", F.col("salts"))).otherwise(F.col("salts") + F.pmod("g", F.lit(1 << 40)))
    split = F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("own"))).cast("long")
    salted = materialize(salted.withColumns({"bin": place, "part": split}).drop("salts", "own"), "bins")
    key = ["curve", "bin", "part"]
    bins = salted.groupBy(*key).agg(F.count("*").alias("n"))
    run = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = materialize(bins.select(*key, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total")), "offsets")
    own = F.row_number().over(Window.partitionBy(*key).orderBy("g", "text_crc32", "size", F.xxhash64("doc_id"), "doc_id"))
    ranked = salted.withColumn("own", own - 1).join(small_side(offsets, offsets.count()), key).withColumn("rank", F.col("own") + F.col("before"))
    shard = F.expr(f"rank * {shards} DIV total")
    # the first rank r with r * shards >= shard * total
    start = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
