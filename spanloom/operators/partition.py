"""Bounded partitions of a timeline: at pauses first, at quiet samples else."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_SECONDS, SEARCH_SECONDS, LEAST_SECONDS, WINDOW_SECONDS = 180.0, 5, 10, 0.1
# Names of boundaries, and of one that a recording without a signal gets.
PREFERRED, EARLY, FORCED, NO_SIGNAL = "vad_pause_preferred", "vad_pause_early", "forced_low_energy_no_vad_pause", "forced_maximum_without_signal"
PLAN_SCHEMA = "part int, a long, b long, boundary string"


def limits(rate: int, max_seconds: float = MAX_SECONDS) -> tuple[int, int, int]:
    """(maximum, search, energy window) in samples."""
    if rate <= 0 or not max_seconds > LEAST_SECONDS or max_seconds == float("inf"):
        raise ValueError(f"rate must be positive and max_seconds finite and over {LEAST_SECONDS}")
    top = floor(max_seconds * rate)
    if top <= LEAST_SECONDS * rate:
        raise ValueError("max_seconds is too small in samples")
    return top, SEARCH_SECONDS * rate, max(4, int(WINDOW_SECONDS * rate))


def quiet_cut(x: np.ndarray, left: int, right: int, width: int, target: int) -> tuple[int, str]:
    """The least sample of the least window sum of |x| in [left, right);
    the first of equals."""
    if right - left <= width:
        return target, "target_search_too_short"
    m = np.abs(x[left:right].astype(np.float64))
    # one running sum in order, as exact comparisons of near ties need
    steps = np.concatenate([[m[:width].sum()], m[width:] - m[:-width]])
    first = int(np.argmin(np.cumsum(steps)))
    return left + first + int(np.argmin(m[first : first + width])), "minimum_window_then_sample"


def energy_plan(x: np.ndarray, rate: int, max_seconds: float = MAX_SECONDS) -> list[tuple[int, int, str]]:
    """Contiguous parts (a, b, boundary) of at most max_seconds."""
    top, search, width = limits(rate, max_seconds)
    if not np.isfinite(x).all():
        raise ValueError("the signal holds a nonfinite sample")
    parts, at, n = [], 0, len(x)
    while n - at > top:
        target = at + top - search
        cut, kind = quiet_cut(x, max(at, target - search), min(n, target + search), width, target)
        parts.append((at, cut, kind))
        at = cut
    return [*parts, (at, n, "input_end")]


def pause_plan(mids: list[int], n: int, rate: int, max_seconds: float = MAX_SECONDS, x: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Parts that end at the latest pause midpoint in their second half, else
    at the latest early one, else at the quietest place near the maximum; only
    without a signal ``x`` at the maximum itself."""
    top, search, width = limits(rate, max_seconds)
    if x is not None and (len(x) != n or not np.isfinite(x).all()):
        raise ValueError("the signal must be finite and as long as the recording")
    early = ceil(min(SEARCH_SECONDS * rate, top / 4))
    parts, at = [], 0
    while n - at > top:
        half = at + (top + 1) // 2
        cut, kind = None, ""
        for lo, hi, name in ((half, at + top, PREFERRED), (at + early, half - 1, EARLY)):
            i = bisect_right(mids, hi)
            if i > bisect_left(mids, lo):
                cut, kind = mids[i - 1], name
                break
        if cut is None and x is not None:
            target = at + top - search
            # what is left counts up to one sample past the maximum
            cut, _ = quiet_cut(x, max(at, target - search), min(at + top + 1, target + search), width, target)
            kind = FORCED
        elif cut is None:
            cut, kind = at + top, NO_SIGNAL
        parts.append((at, cut, kind))
        at = cut
    return [*parts, (at, n, "input_end")]


def partition_at_pauses(pauses: DataFrame, totals: DataFrame, rate: int, max_seconds: float = MAX_SECONDS, signals: DataFrame | None = None) -> DataFrame:
    """(rec, part, a, b, boundary) of each recording: ``totals`` (rec, samples),
    its pauses (rec, midpoint) and, for cuts where there are none, ``signals``
    (rec, pcm binary of float32).  Cuts depend on the cut before, so each
    recording is walked once, recordings in parallel."""
    mids = pauses.groupBy("rec").agg(F.array_sort(F.collect_list("midpoint")).alias("mids"))
    met = totals.select("rec", "samples").join(mids, "rec", "left")
    met = met.withColumn("pcm", F.lit(None).cast("binary")) if signals is None else met.join(signals.select("rec", "pcm"), "rec", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [
                (rec, i, *part)
                for rec, n, m, pcm in zip(p["rec"], p["samples"], p["mids"], p["pcm"])
                for i, part in enumerate(pause_plan([] if m is None else [int(v) for v in m], int(n), rate, max_seconds, None if pcm is None else np.frombuffer(pcm, "<f4")))
            ]
            yield pd.DataFrame(rows, columns=["rec", "part", "a", "b", "boundary"])

    return met.mapInPandas(run, f"rec {dict(totals.dtypes)['rec']}, {PLAN_SCHEMA}")


def partition_by_energy(signals: DataFrame, rate: int, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """(rec, part, a, b, boundary) from (rec, pcm binary of float32)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(rec, i, *part) for rec, pcm in zip(p["rec"], p["pcm"]) for i, part in enumerate(energy_plan(np.frombuffer(pcm, "<f4"), rate, max_seconds))]
            yield pd.DataFrame(rows, columns=["rec", "part", "a", "b", "boundary"])

    return signals.select("rec", "pcm").mapInPandas(run, f"rec {dict(signals.dtypes)['rec']}, {PLAN_SCHEMA}")
