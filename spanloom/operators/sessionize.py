"""Ordered operators on timelines: runs, pauses, coalescing, activity classes."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators import intervals
from spanloom.operators.joins import interval_join

PAUSE_SCORE, PAUSE_SECONDS = 0.35, 0.16
ANCHOR_SECONDS, MERGE_GAP_SECONDS, EXPOSED = 2.5, 0.35, 1e-9
#: Seconds of a time bucket: about the length of an event.
BUCKET = 60


def runs(df: DataFrame, key: list[str], index: str, condition: Column) -> DataFrame:
    """Rows that meet the condition with ``run``, equal for neighbours by
    ``index`` (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(index)
    return df.where(condition).withColumn("run", F.col(index) - F.row_number().over(w))


def pause_runs(frames: DataFrame, totals: DataFrame, rate: int, key: str = "rec") -> DataFrame:
    """Runs of low scores, long enough: (key, a, b, frames, n, midpoint, edge, id).

    ``frames``: (key, frame_idx, start_sample, end_sample, probability);
    ``totals``: (key, samples).  Low is strictly under .35, long is at least
    ceil(.16 * rate) samples; runs at an end are edges and have no id.
    """
    low = runs(frames, [key], "frame_idx", F.col("probability") < PAUSE_SCORE)
    found = low.groupBy(key, "run").agg(
        F.min("start_sample").alias("a"), F.max("end_sample").alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_list("frame_idx")).alias("frames")
    )
    least = ceil(round(PAUSE_SECONDS * rate, 9))
    kept = found.where(F.col("b") - F.col("a") >= least).join(totals, key)
    kept = kept.withColumn("edge", (F.col("a") == 0) | (F.col("b") == F.col("samples"))).withColumn("midpoint", F.expr("(a + b) DIV 2"))
    order = Window.partitionBy(key, "edge").orderBy("a")
    return kept.withColumn("id", F.when(~F.col("edge"), F.row_number().over(order) - 1)).drop("run", "samples")


def contiguity_violations(df: DataFrame, key: list[str], order: list[str], start: str, end: str, first: int = 0, total: str | None = None) -> DataFrame:
    """Rows that do not start where the one before ended (the first at
    ``first``), or of which the last does not end at ``total``."""
    w = Window.partitionBy(*key).orderBy(*order)
    want = F.coalesce(F.lag(end).over(w), F.lit(first))
    last = F.lead(start).over(w).isNull()
    out = df.withColumns({"expected": want, "_last": last})
    bad = F.col(start) != F.col("expected")
    if total:
        bad = bad | F.col("_last") & (F.col(end) != F.col(total))
    return out.where(bad).drop("_last")


def _blocked(df: DataFrame, key: str, speaker: str, gap: float, bucket: int) -> DataFrame:
    """``df`` with ``_pm``, the speaker's greatest end before, and ``_blk``,
    whether another speaker is active in the mergeable gap since then."""
    own = Window.partitionBy(key, speaker).orderBy("a", "b", "id").rowsBetween(Window.unboundedPreceding, -1)
    m = df.withColumn("_pm", F.max("b").over(own))
    asks = m.where((F.col("a") > F.col("_pm")) & (F.col("a") - F.col("_pm") <= gap)).select(key, F.col("id").alias("_id"), F.col(speaker).alias("_s"), F.col("_pm").alias("_ga"), F.col("a").alias("_gb"))
    hits = interval_join(asks, df.select(key, speaker, "a", "b"), [key], bucket, ("_ga", "_gb"), ("a", "b")).where(F.col(speaker) != F.col("_s"))
    hits = hits.select(key, F.col("_id").alias("id")).distinct().withColumn("_blk", F.lit(True))
    return m.join(hits, [key, "id"], "left").withColumn("_blk", F.coalesce("_blk", F.lit(False)))


def coalesce_activity(df: DataFrame, gap: float = MERGE_GAP_SECONDS, key: str = "rec", speaker: str = "spk", bucket: int = BUCKET) -> DataFrame:
    """``df`` (key, id, spk, a, b) with ``grp``: events of one speaker that
    overlap, touch, or are at most ``gap`` apart with nobody else active
    between them."""
    m = _blocked(df, key, speaker, gap, bucket)
    new = F.col("_pm").isNull() | (F.col("a") > F.col("_pm")) & ((F.col("a") - F.col("_pm") > gap) | F.col("_blk"))
    w = Window.partitionBy(key, speaker).orderBy("a", "b", "id").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("grp", F.sum(new.cast("long")).over(w)).drop("_pm", "_blk")


def activity_candidates(df: DataFrame, gap: float = MERGE_GAP_SECONDS, anchor: float = ANCHOR_SECONDS, key: str = "rec", speaker: str = "spk", bucket: int = BUCKET) -> DataFrame:
    """Groups with their class: (key, spk, grp, a, b, n, speech, single, activity).

    ``speech`` is the group's own union, ``single`` the part of it in which no
    other speaker is active.  Source extents (``source_a``, ``source_b``, where
    present) count for speech, clipped ones for the rest.  ``activity`` is
    sustained (speech >= anchor), brief (some single) or unresolved.
    """
    clipped = "source_a" in df.columns
    g = coalesce_activity(df, gap, key, speaker, bucket)
    own = intervals.islands(g, [key, speaker, "grp"]).groupBy(key, speaker, "grp", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    other = df.select(key, F.col(speaker).alias("_os"), F.col("a").alias("_oa"), F.col("b").alias("_ob"))
    met = interval_join(own, other, [key], bucket, ("a", "b"), ("_oa", "_ob")).where(F.col("_os") != F.col(speaker))
    cut = met.select(key, speaker, "grp", "island", F.greatest("a", "_oa").alias("x"), F.least("b", "_ob").alias("y"))
    w = Window.partitionBy(key, speaker, "grp", "island").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("y") - F.greatest("x", F.coalesce("reach", F.col("x"))))
    seen = cut.withColumn("reach", F.max("y").over(w)).groupBy(key, speaker, "grp", "island").agg(F.sum(fresh).alias("foreign"))
    own = own.join(seen, [key, speaker, "grp", "island"], "left").withColumn("single", F.col("b") - F.col("a") - F.coalesce("foreign", F.lit(0)))
    per = own.groupBy(key, speaker, "grp").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum(F.col("b") - F.col("a")).alias("speech"), F.sum("single").alias("single"))
    n = g.groupBy(key, speaker, "grp").agg(F.count("*").alias("n"))
    per = per.join(n, [key, speaker, "grp"])
    if clipped:
        wide = intervals.union(g.select(key, speaker, "grp", F.col("source_a").alias("a"), F.col("source_b").alias("b")), [key, speaker, "grp"])
        full = wide.groupBy(key, speaker, "grp").agg(F.sum(F.col("b") - F.col("a")).alias("_full"))
        per = per.join(full, [key, speaker, "grp"]).withColumn("speech", F.col("_full")).drop("_full")
    kind = F.when(F.col("speech") >= anchor, "sustained").when(F.col("single") > EXPOSED, "brief").otherwise("unresolved")
    return per.withColumn("activity", kind)


def uncertain_boundaries(groups: DataFrame, events: DataFrame, key: str = "rec", speaker: str = "spk", bucket: int = BUCKET) -> DataFrame:
    """(key, spk, grp, side, at, from, until, n, speakers): group starts and ends that fall
    strictly inside another speaker's event.  The range is that of the events,
    cut to the group; unresolved groups have none."""
    own = groups.where("activity <> 'unresolved'") if "activity" in groups.columns else groups
    ends = own.select(key, speaker, "grp", F.col("a").alias("_a"), F.col("b").alias("_b"), F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("a").alias("at")), F.struct(F.lit("end").alias("side"), F.col("b").alias("at")))).alias("e")).select(key, speaker, "grp", "_a", "_b", "e.*")
    other = events.select(key, F.col(speaker).alias("_os"), F.col("a").alias("_oa"), F.col("b").alias("_ob"))
    met = interval_join(ends, other, [key], bucket, ("at", "at"), ("_oa", "_ob")).where(F.col("_os") != F.col(speaker))
    return met.groupBy(key, speaker, "grp", "side", "at").agg(F.min(F.greatest("_a", "_oa")).alias("from"), F.max(F.least("_b", "_ob")).alias("until"), F.count("*").alias("n"), F.array_sort(F.collect_set("_os")).alias("speakers"))


def major_turns(df: DataFrame, key: str, order: list[str], speaker: str) -> DataFrame:
    """Neighbours of one speaker collapsed: (key, turn, speaker, n, first and
    last of each ordering column's start)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = (~F.lag(speaker).over(w).eqNullSafe(F.col(speaker))).cast("long")
    turn = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", changed).withColumn("turn", turn - 1).drop("_new")


def transitions(turns: DataFrame, key: str, speaker: str) -> DataFrame:
    """(key, id, from_speaker, to_speaker, at) between turns (key, turn,
    speaker, a, b) that follow one another; ``at`` is where the next starts."""
    w = Window.partitionBy(key).orderBy("turn")
    out = turns.withColumns({"from_speaker": F.lag(speaker).over(w), "prev_end": F.lag("b").over(w)})
    return out.where(F.col("from_speaker").isNotNull()).select(key, (F.col("turn") - 1).alias("id"), "from_speaker", F.col(speaker).alias("to_speaker"), F.col("a").alias("at"), "prev_end")


def conflicts(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with ``conflict``: the value does not exceed the one before, or
    the one after does not exceed it."""
    w = Window.partitionBy(key).orderBy(order)
    down = F.coalesce(F.lag(value).over(w) >= F.col(value), F.lit(False))
    return df.withColumn("conflict", down | F.coalesce(F.col(value) >= F.lead(value).over(w), F.lit(False)))
