"""Interval algebra by key: union, uncovered measure, cover, clipping, overlap.

Intervals are [a, b) in integer or floating seconds.  Every function takes the
key columns that bound a timeline, so that timelines run in parallel; nothing
here needs all rows of the corpus together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators.joins import asof_join, interval_join

#: Seconds of a time bucket.
BUCKET = 60


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite (Spark's NaN equals itself and exceeds
    everything, so comparisons need this first)."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def same(left: Column, right: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(left - right) <= tolerance


def overlap(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Length that two intervals share, 0 if they do not meet."""
    return F.greatest(F.lit(0), F.least(b1, b2) - F.greatest(a1, a2))


def clip(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that meet the window, cut to it; the extents they had stay in
    ``source_a`` and ``source_b``, and ``clipped`` tells whether they differ."""
    inside = df.where((F.col("b") > start) & (F.col("a") < end) & (F.col("b") > F.col("a")))
    cut = inside.withColumns({"source_a": F.col("a"), "source_b": F.col("b")})
    cut = cut.withColumns({"a": F.greatest("source_a", start), "b": F.least("source_b", end)})
    return cut.withColumn("clipped", (F.col("a") != F.col("source_a")) | (F.col("b") != F.col("source_b")))


def slice_with_context(df: DataFrame, total: Column, start: Column, duration: Column, context: float) -> DataFrame:
    """Requested and actual window of a slice with context on both sides,
    clamped to [0, total]."""
    lo, hi = start - F.lit(context), start + duration + F.lit(context)
    return df.withColumns({
        "requested_start": start, "requested_end": start + duration,
        "actual_start": F.greatest(F.lit(0), lo), "actual_end": F.least(total, hi),
        "clamped_start": lo < 0, "clamped_end": hi > total,
    })


def islands(df: DataFrame, key: list[str], slack: float = 0) -> DataFrame:
    """``df`` with ``island``, a number per key: intervals that overlap or
    touch (``a <= greatest end before + slack``) share one."""
    before = Window.partitionBy(*key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_reach", F.max("b").over(before))
    new = F.when(F.col("_reach").isNull() | (F.col("a") > F.col("_reach") + F.lit(slack)), 1).otherwise(0)
    return marked.withColumn("_new", new).withColumn("island", F.sum("_new").over(upto)).drop("_reach", "_new")


def union(df: DataFrame, key: list[str], slack: float = 0) -> DataFrame:
    """Maximal intervals (key, a, b, n) of the union; empty intervals go."""
    real = df.where(F.col("b") > F.col("a"))
    return islands(real, key, slack).groupBy(*key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("island")


def uncovered(df: DataFrame, key: list[str], ident: str, covers: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """(key, ident, a, b, uncovered): the length of each interval of ``df`` that
    no interval of ``covers`` (key, a, b) covers; the two meet in buckets."""
    solid = union(covers, key).select(*key, F.col("a").alias("_ca"), F.col("b").alias("_cb"))
    own = df.select(*key, ident, "a", "b")
    met = interval_join(own, solid, key, bucket, ("a", "b"), ("_ca", "_cb"))
    part = met.groupBy(*key, ident, "a", "b").agg(F.sum(overlap(F.col("a"), F.col("b"), F.col("_ca"), F.col("_cb"))).alias("_c"))
    left = F.greatest(F.lit(0), F.col("b") - F.col("a") - F.coalesce("_c", F.lit(0)))
    return own.join(part, [*key, ident, "a", "b"], "left").select(*key, ident, "a", "b", left.alias("uncovered"))


def covered(df: DataFrame, key: list[str], ident: str, covers: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(key, ident, covered): whether one interval of the union of ``covers``,
    joined over gaps up to ``slack``, holds the whole interval.  The last of
    these that starts by its start is the only one that can (an as-of join)."""
    solid = union(covers, key, slack).select(*key, F.col("a").cast("double").alias("_ca"), F.col("b").alias("_cb"))
    own = df.select(*key, ident, (F.col("a") + slack).cast("double").alias("_at"), (F.col("b") - slack).alias("_to"))
    met = asof_join(own, solid, key, "_at", "_ca")
    return met.select(*key, ident, F.coalesce(F.col("_cb") >= F.col("_to"), F.lit(False)).alias("covered"))


def complement(df: DataFrame, key: list[str], total: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, a, b): what sorted disjoint spans leave of [0, n), ``total`` (key, n)."""
    w = Window.partitionBy(*key).orderBy(a)
    ends = total.select(*key, F.col("n").alias(a), F.col("n").alias(b))
    marks = df.select(*key, a, b).union(ends)
    out = marks.withColumn("_from", F.coalesce(F.lag(b).over(w), F.lit(0)))
    return out.where(F.col("_from") < F.col(a)).select(*key, F.col("_from").alias("a"), F.col(a).alias("b"))
