"""Operator 6: removal of repeated word windows by Rabin-Karp hashing.

Every window of 20 words is hashed with a rolling Rabin-Karp hash.  Counting
all of them would shuffle one row per word of the corpus, so windows are first
counted in bundles: each window is represented by its anchor, the least of its
13 Rabin-Karp hashes of eight words.  Equal windows have equal anchors, so a
window whose anchor occurs once in the corpus is proven unique; one row per
anchor is a seventh of the windows.  The windows of repeated anchors are then
counted by their own 96-bit hashes, and those that start earlier elsewhere
become removal intervals that merge per document; inside one document 64 of
these bits tell its windows apart.

Rows of one doc_id are one document: windows that they share are not removed
for that.  Null doc_ids sort last and count as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import materialize, release, rolling, signed, small_side, word_hashes, words

WINDOW = 20
ANCHOR = 8
_SECOND = 0xDA942042E4DD58B5
_LAST = (1 << 63) - 1


def anchor_starts(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes by position, and for each window where its anchor starts."""
    width = min(ANCHOR, window)
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = rolling(h, width)
    return g, sliding_window_view(g, window - width + 1).argmin(axis=1) + np.arange(len(h) - window + 1)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g, starts = anchor_starts(word_hashes(words(text.as_py())), window)
                if len(starts):
                    p = starts[np.r_[True, starts[1:] != starts[:-1]]]
                    hs.append(signed(g[p]))
                    at.append(p.astype(np.int32))
                    ids.append(np.full(len(p), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, at)], names=["h", "id", "at"])

    return run


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for i, text, flagged in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                h = word_hashes(words(text.as_py()))
                _, starts = anchor_starts(h, window)
                hot = np.zeros(len(h) + 1, bool)
                where = flagged.values.to_numpy()
                hot[where[where < len(hot)]] = True
                take = np.flatnonzero(hot[starts])
                if len(take):
                    a = signed(rolling(h, window))[take]
                    a, first = np.unique(a, return_index=True)
                    b = (rolling(h, window, _SECOND)[take[first]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    one.append(a)
                    two.append(b)
                    ids.append(np.full(len(a), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (one, two, ids)], names=["h1", "h2", "id"])

    return run


def removed_words(n: int, hashes: np.ndarray, later: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words covered by a window that starts earlier, in this
    document or (``later``) in another."""
    gone = np.zeros(len(hashes), bool)
    if len(hashes):
        _, first = np.unique(hashes, return_index=True)
        if len(first) < len(hashes):
            gone[:] = True
            gone[first] = False
        if len(later):
            gone |= np.isin(hashes, later)
    edge = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(gone)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def _apply(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, cut, out = [], [], []
            for text, later, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ws = words(text.as_py())
                if len(ws) < window:
                    kept, gone = ws, 0
                elif copy:
                    kept, gone = [], len(ws)
                else:
                    mask = removed_words(len(ws), signed(rolling(word_hashes(ws), window)), later.values.to_numpy() if later.is_valid else np.empty(0, np.int64), window)
                    gone = int(mask.sum())
                    kept = [w for w, m in zip(ws, mask.tolist(), strict=True) if not m] if gone else ws
                total.append(len(ws))
                cut.append(gone)
                joined = " ".join(kept)
                out.append(hashlib.sha256(joined.encode()).hexdigest() if digest else joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(cut, pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
            )

    return run


def exact_copies(docs: DataFrame) -> DataFrame:
    """(id, m) of the texts that an earlier document has whole; ``docs`` has
    (id, m) with m the digest of a row's text."""
    # distinct before the join, as after it the join's exchange would serve both, and AQE then leaves it whole
    hashed = docs.select("id", "m").where("m IS NOT NULL").distinct()
    first = materialize(hashed.groupBy("m").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "firsts")
    return hashed.join(first.hint("shuffle_hash"), "m").where("id > first").select("id", "m")


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (id, later array<long>): the windows of each document that start
    in an earlier one.  ``docs`` has (id, text)."""
    anchors = materialize(docs.mapInArrow(_anchors(window), "h long, id long, at int"), "anchors")
    # written, as a count and a join in one stage share an exchange, and AQE then
    # does not split a hot anchor
    repeated = materialize(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    flags = materialize(anchors.join(repeated.hint("shuffle_hash"), "h", "left_semi").groupBy("id").agg(F.collect_list("at").alias("flags")), "flags")
    release(anchors)
    release(repeated)
    met = docs.join(flags, "id").select("id", "text", "flags")
    found = materialize(met.mapInArrow(_candidates(window), "h1 long, h2 int, id long"), "windows")
    first = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    first = materialize(first, "first")
    later = materialize(found.join(first.hint("shuffle_hash"), ["h1", "h2"]).where("id > first").groupBy("id").agg(F.collect_set("h1").alias("later")), "later")
    release(found)
    release(first)
    return later


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text or kept_sha256), one per row.

    Words are maximal runs of characters other than space and U+0009..U+000D;
    a null text has none.  A word goes if some window of ``window`` words that
    covers it also starts earlier: in a document of smaller doc_id, or earlier
    in its own.  Windows are judged on the input.  Shorter texts lose nothing;
    extra columns are ignored; an empty table gives an empty result.

    Copies of an earlier text lose every window, so only first texts are
    hashed: no window of a copy is first anywhere.  Copies are known by id and
    digest, so that other rows of their id are hashed and judged as any.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("m", F.md5(F.col("text").cast("binary")))
    copies = materialize(exact_copies(own), "copies")
    n = copies.count()
    later = later_windows(own.join(small_side(copies, n), ["id", "m"], "left_anti").select("id", "text"), window)
    marked = own.join(small_side(copies.withColumn("copy", F.lit(True)), n), ["id", "m"], "left")
    joined = marked.join(later, "id", "left")
    kind = "kept_sha256" if digest else "kept_text"
    return joined.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "text", "later", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _apply(window, digest), f"doc_id long, n_words long, n_removed long, {kind} string"
    )
